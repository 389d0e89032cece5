"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands), bytes are summed per slot, and a
versioned map assigns slots to shards. The map is small and fixed in size (one entry per slot), so it is
edited on the driver and stored as a table; records only ever see it through a join on their slot.
Version 0 deals the slots out in turn; rebalancing edits that map into the next version, moving as few slots as it takes
for shard sizes to come out near equal (law ``bytes``).

Defined results: a null text has size 1 (no bytes, plus 1), a text of any length all its bytes; null ids are hashed like any
value; rows equal in id and text fall into one slot and are numbered one after the other, which are the only ties; further
columns, whatever their names, are not looked at; an empty table gives an empty table.
Equal texts with different ids are spread over slots, so a hot text does not fill one of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored, text_of

SLOTS = 4096
SHARDS = 16
#: Parts in which the rows of one slot are numbered, so that no task has to sort a whole slot: so many, and more once
#: a part would pass so many rows.
PARTS = 8
PART_ROWS = 1_000_000


def keyed(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, digest and virtual slot of each record."""
    size = (F.octet_length(text_of("text")) + 1).cast("long")
    crc = F.crc32(text_of("text").cast("binary"))
    digest = F.xxhash64("doc_id", "text_crc32", "size")
    rows = documents.select("doc_id", size.alias("size"), crc.alias("text_crc32")).withColumn("digest", digest)
    return rows.withColumn("vslot", F.pmod("digest", F.lit(slots)).cast("int"))


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes of each virtual slot that has records; at most one row a slot."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 0: slot i belongs to shard i modulo the number of shards."""
    return [i % shards for i in range(slots)]


def rebalanced(old: list[int], sizes: dict[int, int], shards: int = SHARDS) -> list[int]:
    """The next version of a map: an edit that moves slots from the fullest shard to the emptiest, one at a time.

    The slot that goes is the one whose bytes come nearest to half of what lies between the two. Each move brings the shards
    closer; the edit ends when none would. All other slots, and slots without bytes, stay where they are.
    """
    new, load = list(old), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, size in sizes.items():
        load[old[slot]] += size
        insort(held[old[slot]], (size, slot))
    while shards > 1:
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        at = bisect_left(held[full], (gap // 2, -1))
        near = [c for c in held[full][max(at - 1, 0) : at + 1] if 0 < c[0] < gap]
        if not near:
            break
        size, slot = min(near, key=lambda c: (abs(2 * c[0] - gap), c[1]))
        held[full].remove((size, slot))
        insort(held[empty], (size, slot))
        load[full], load[empty], new[slot] = load[full] - size, load[empty] + size, empty
    return new


def map_frame(spark: SparkSession, slot_map: list[int]) -> DataFrame:
    """Slot map as a table, made on the JVM from one literal."""
    shards = F.split(F.lit(",".join(map(str, slot_map))), ",")
    return spark.range(1).select(F.posexplode(shards).alias("vslot", "shard")).select("vslot", F.col("shard").cast("int").alias("shard"))


def store_map(spark: SparkSession, slot_map: list[int], folder: str, version: int) -> str:
    """Adds a version to a stored map; earlier versions stay readable."""
    path = f"{folder.rstrip('/')}/version={version}"
    map_frame(spark, slot_map).coalesce(1).write.parquet(path)
    return path


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/version={version}")


def shard(documents: DataFrame, slots: int = SLOTS, shards: int = SHARDS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (its place in the shard, gapless from 0), grown_shard, vslot.

    ``folder`` gets the versions of the slot map; by default a new one in the shared folder.
    """
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "slotmap")
    records = stored(keyed(documents, slots), "shard-keys")
    found = slot_bytes(records).collect()  # one row for each of the fixed slots at most
    sizes = {r.vslot: r.bytes for r in found}
    parts = max(PARTS, -(-max((r.n for r in found), default=0) // PART_ROWS))
    first = first_map(slots, shards)
    store_map(spark, first, folder, 0)
    store_map(spark, rebalanced(first, sizes, shards), folder, 1)
    # A fixed number of slots bounds the map: thousands of rows of two integers.
    placed = records.join(F.broadcast(load_map(spark, folder, 1)), "vslot")
    return numbered(placed.withColumn("part", F.pmod(F.shiftrightunsigned("digest", 40), F.lit(parts)).cast("int")))


def numbered(placed: DataFrame) -> DataFrame:
    """Numbers the rows of each shard without gaps: the counts of its (slot, part) cells give each cell's first
    number, and rows are ordered within their cell only."""
    counts = placed.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("vslot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    cell = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    rows = placed.withColumn("place", F.row_number().over(cell) - 1)
    return rows.join(starts, ["vslot", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )


def grown(slot_map: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """A map for one more shard: slots move into the new shard only, from the fullest shards, until it has its
    even part of the bytes. All other records stay."""
    load = [0] * (shards + 1)
    for slot, b in sizes.items():
        load[slot_map[slot]] += b
    even = sum(load) / (shards + 1)
    new = list(slot_map)
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        here, b = new[slot], sizes[slot]
        if load[shards] + b <= even and load[here] - b >= even * 0.98:
            load[here] -= b
            load[shards] += b
            new[slot] = shards
    return new

