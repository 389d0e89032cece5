"""Mixing sources to target weights by a low-discrepancy schedule.

1. The words of each source are summed; targets share the budget by weight and stop at ``max_repeat`` times a
   source's words, the excess being shared again by weight.
2. Each source's documents are shuffled by hash and laid end to end; that stream, repeated, is cut into blocks
   of equally many words.
3. Slot i of the schedule takes point i of the van der Corput sequence and maps it through the cumulative targets
   to a source, which gives its next block: slots are ranked within their source. There are as many points as blocks in the
   budget, and they alone decide how many blocks a source gives, and where in the mix each stands.
4. A document's copy, which is its place in one round of its source's stream, meets the slot of the block that it begins in,
   by a join on (source, block number). Slot and place in the block are its position in the mix, which no other copy has.

The discrepancy of the sequence keeps each source within some log(n) blocks of its share at any point of the
mix, so also at its end. Blocks have ``BLOCK_WORDS`` words, or fewer in a small mix, which has ``SLOTS`` of them at least.

Defined results: a null text has size 0; the null source is a source of its own, last in order; documents of
size 0 are taken 0 times; rows equal in id and text lie next to each other in their stream, in either order; there are no
other ties, as streams are ordered by hash, id and size; a text of any length is one document, taken in part where its
source's blocks end in it; an empty table gives an empty table; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 8192
SLOTS = 1 << 18
#: Buckets of each source in which documents are ordered, by so many hexadecimal digits of their hash; the order of the
#: buckets makes up the stream. One more digit once a bucket would pass so many rows.
DIGITS = 3
BUCKET_ROWS = 1_000_000
#: Cells of [0, 1) in which slots meet the ranges of sources.
GRID = 1024
#: Slots that are ranked in one piece.
RANKED = 65536
#: Binary digits of the sequence: it repeats after 2 ** 48 slots.
BITS = 48


def dice(doc_id: Column, text: Column) -> Column:
    """The shuffle key: a hash of id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_of(text)).cast("binary"))


def source_of(source: Column) -> Column:
    """The source as a value that is never null and orders null last."""
    return F.struct(source.isNull().alias("absent"), F.coalesce(source, F.lit("")).alias("name"))


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, src, size and dice of each document."""
    key = dice(F.col("doc_id"), F.col("text"))
    return documents.select("doc_id", source_of(F.col("source")).alias("src"), n_words(text_of("text")).alias("size"), key.alias("dice"))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds ``weight`` and ``target`` to (src, source_size): one row a source, so one task holds them all.

    With sources by rising cap over weight, the first k are capped where the rest's common rate, what is left
    of the budget over the rest's weights, does not exceed the next source's cap over weight.
    """
    rank = Window.orderBy("src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(max_repeat))
    t = t.withColumn("budget", F.sum("source_size").over(every) * share)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    t = t.withColumn("rate", left / rest)
    # The rate at the first source that is not capped; sources before it are below it and so capped.
    t = t.withColumn("rate", F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "src", "rate"))).over(every)["rate"])
    target = F.coalesce(F.least("cap", F.col("rate") * F.col("weight")), F.col("cap"))
    return t.select("src", "source_size", "weight", target.alias("target"))


def van_der_corput(i: Column) -> Column:
    """Point i of the base-2 sequence, in [0, 1)."""
    digits = F.reverse(F.lpad(F.bin(i), BITS, "0"))
    return F.conv(digits, 2, 10).cast("double") / float(2**BITS)


def schedule(goals: DataFrame, slots: int, sequence=van_der_corput) -> DataFrame:
    """src, turn, slot: the sources of slots 0 to ``slots - 1`` by their points, and which block of its source each is.

    ``goals`` has src and target, one row a source.
    """
    # Ranges of [0, 1) by source, and the grid cells that each touches: points meet them by cell, in equal parts.
    upto = F.sum("target").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(Window.partitionBy())
    ranges = goals.where("target > 0").select("src", ((upto - F.col("target")) / whole).alias("lo"), (upto / whole).alias("hi"))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1).cast("long")))))
    points = goals.sparkSession.range(slots).select(F.col("id").alias("slot"), sequence(F.col("id")).alias("x"))
    hits = points.withColumn("cell", F.floor(F.col("x") * GRID)).join(ranges, "cell").where("x >= lo AND x < hi")
    hits = hits.select("src", "slot", F.floor(F.col("slot") / RANKED).alias("chunk"))
    # Ranks within a source: counts of each run of slots, then row numbers inside the run.
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = hits.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = hits.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["src", "chunk"])
    return ranked.select("src", (F.col("first") + F.col("place")).alias("turn"), "slot")


def streams(
    documents: DataFrame, block: int | None = None, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, sequence=van_der_corput
) -> tuple[DataFrame, DataFrame, int]:
    """The documents in their sources' streams, the schedule, and the words of a block.

    Of each document: doc_id, dice, src, size, source_size, target, ``given`` (the words that its source gives) and start (its
    place in its source's stream).
    """
    records = stored(sized(documents), "mix-sizes")
    rows, digits = records.count(), DIGITS
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    records = records.withColumn("bucket", F.left("dice", F.lit(digits)))
    cells = records.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    goals = stored(targets(cells.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, max_repeat), "mix-targets")
    words = goals.agg(F.sum("target")).first()[0] or 0.0
    block = block or max(1, min(BLOCK_WORDS, int(words // SLOTS)))
    drawn = stored(schedule(goals, -int(-words // block), sequence), "mix-schedule")
    blocks = drawn.groupBy("src").agg(F.count("*").alias("blocks"))
    # No document more than max_repeat times, whatever the points.
    given = F.least(F.coalesce("blocks", F.lit(0)) * block, F.col("source_size") * max_repeat)
    goals = goals.join(blocks, "src", "left").select("src", "source_size", "target", given.alias("given"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("dice", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = records.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts.join(goals, "src"), ["src", "bucket"])
    placed = placed.select("doc_id", "dice", "src", "size", "source_size", "target", "given", (F.col("before") + F.col("inside")).alias("start"))
    return placed, drawn, block


def part_in(round_: Column) -> Column:
    """Words that the mix takes of a document in a round of its source's stream."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("given") - round_ * F.col("source_size") - F.col("start")))


def planned(documents: DataFrame, max_repeat: int = MAX_REPEAT, **options) -> DataFrame:
    """One row per document: doc_id, dice, src, size, source_size, target, start (its place in its source's stream), taken and
    first_slot (of its first copy; null if the mix takes nothing of it)."""
    placed, drawn, block = streams(documents, max_repeat=max_repeat, **options)
    taken = sum((part_in(F.lit(r)) for r in range(max_repeat)), F.lit(0)).cast("long")
    placed = placed.withColumn("taken", taken).withColumn("turn", F.when(F.col("taken") > 0, F.floor(F.col("start") / block)))
    met = placed.join(drawn.withColumnRenamed("slot", "first_slot"), ["src", "turn"], "left")
    return met.select("doc_id", "dice", "src", "size", "source_size", "target", "start", "taken", "first_slot")


def mix(documents: DataFrame, max_repeat: int = MAX_REPEAT, **options) -> DataFrame:
    """The mixed documents in the order of the mix: each copy of which the mix takes half or more, at its position.

    Repeated rows are told apart by numbering them on both sides of the join; rows equal in id, text and source may swap places.
    """
    placed, drawn, block = streams(documents, max_repeat=max_repeat, **options)
    same = Window.partitionBy("id", "dice", "src")
    keyed = placed.withColumn("id", F.coalesce("doc_id", F.lit(-1))).withColumn("copy", F.row_number().over(same.orderBy("start")))
    copies = keyed.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    at = F.col("round") * F.col("source_size") + F.col("start")
    copies = copies.where(part_in(F.col("round")) * 2 >= F.col("size")).withColumns({"at": at, "turn": F.floor(at / block)})
    copies = copies.join(drawn, ["src", "turn"]).select("id", "dice", "src", "copy", (F.col("slot") * block + F.col("at") - F.col("turn") * block).alias("position"))
    rows = documents.select(
        F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-1)).alias("id"), dice(F.col("doc_id"), F.col("text")).alias("dice"), source_of(F.col("source")).alias("src")
    )
    rows = rows.withColumn("copy", F.row_number().over(same.orderBy(F.lit(0))))
    met = rows.join(copies, ["id", "dice", "src", "copy"])
    return met.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
