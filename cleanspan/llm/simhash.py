"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its image is the vector of their bit counts. The
Manhattan distance of two images never exceeds the fingerprints' Hamming distance, so fingerprints within
``RADIUS`` bits have images within ``RADIUS``.

The range join lays a grid of unit cells over the images. A range search around a point would have to visit
thousands of neighbour cells in 32 dimensions; instead the axes are split into eight groups of four. Images
within distance 4 agree on four whole groups at least, so in one of the 70 projections onto four groups
both lie in the same cell. Fingerprints (distinct ones only) are sorted by cell; those that share a cell are
compared by Manhattan distance, then by Hamming distance, and each batch of cells returns a spanning forest of
its links rather than all pairs. Cells with more than ``CELL`` fingerprints are cut into blocks, and every
pair of blocks is compared by a task of its own.

Components come from alternating large-star and small-star steps over the links, with a checkpoint each.

Defined results: a null or empty text has fingerprint zero, a text of any length is hashed whole; rows with one fingerprint
are linked whatever their ids; null ids never name a component unless all its ids are null; of rows that tie for the least id
the one of the least hash of id and text stays, and of repeated rows any; an empty table gives an empty table; further columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import string
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

SHINGLE = 4
RADIUS = 4
GROUPS = 8
CELL = 2048
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        even = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxh64_intdigest(even[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], ">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash (of id and text) and fp (the fingerprint as a signed 64-bit integer) of each document."""

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "row_hash", "fp"])

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    return rows.mapInArrow(score, "doc_id long, row_hash long, fp long")


# --- Grid range join --------------------------------------------------------------------------------

PROJECTIONS = np.array(list(combinations(range(GROUPS), GROUPS - RADIUS)))
#: Image of a byte, four segments of two bits, as one number in base 3.
IMAGE = np.array([sum(((b >> 2 * i) & 3).bit_count() * 3**i for i in range(4)) for b in range(256)])


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the images of fingerprints."""
    even = np.uint64(0x5555555555555555)
    x = (a & even) + ((a >> np.uint64(1)) & even)
    y = (b & even) + ((b >> np.uint64(1)) & even)
    # Two-bit fields hold 0 to 2; |x - y| is summed over the fields by their bits.
    high = np.uint64(0xAAAAAAAAAAAAAAAA)
    differ = x ^ y
    two = differ & high & ~((differ & even) << np.uint64(1))  # 0 against 2
    one = differ & even  # 0 against 1, 1 against 2
    return np.bitwise_count(one) + 2 * np.bitwise_count(two)


def cells_of(fps: np.ndarray) -> np.ndarray:
    """The cell of each fingerprint in each projection: shape (len(fps), projections)."""
    groups = IMAGE[fps.astype(">u8").view(np.uint8).reshape(-1, GROUPS)]
    out = np.zeros((len(fps), len(PROJECTIONS)), np.int64) + np.arange(len(PROJECTIONS))
    for k in range(PROJECTIONS.shape[1]):
        out = out * 81 + groups[:, PROJECTIONS[:, k]]
    return out


class Forest:
    """Union-find over the fingerprints of a batch; keeps the links that join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        if (x := self.find(a)) != (y := self.find(b)):
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are linked: by the lower bound first, then exactly."""
    ok = np.nonzero(manhattan(a, b) <= radius)[0]
    return ok[hamming(a[ok], b[ok]) <= radius]


def links_in_runs(cells: np.ndarray, fps: np.ndarray, forest: Forest, radius: int) -> None:
    """Links between fingerprints of one cell; both arrays are in the order of cells.

    Rows that are connected already are not compared again, so a dense cell costs few comparisons.
    """
    live = np.nonzero(cells[1:] == cells[:-1])[0]
    tree = np.arange(len(cells))
    lag = 1
    while len(live):  # pairs that lie ``lag`` apart in one cell
        apart = live[tree[live] != tree[live + lag]]
        hits = apart[near(fps[apart], fps[apart + lag], radius)]
        for i in hits.tolist():
            x, y = _root(tree, i), _root(tree, i + lag)
            if x != y:
                tree[max(x, y)] = min(x, y)
                forest.join(int(fps[i]), int(fps[i + lag]))
        if len(hits):
            while (up := tree[tree]).tobytes() != tree.tobytes():
                tree = up
        lag += 1
        live = live[live + lag < len(cells)]
        live = live[cells[live] == cells[live + lag]]


def _root(tree: np.ndarray, i: int) -> int:
    while (up := int(tree[i])) != i:
        i = up
    return i


def links_between(a: np.ndarray, b: np.ndarray, forest: Forest, radius: int) -> None:
    """Links between two blocks of one cell, which may be the same block."""
    tree = np.arange(len(b))  # of the fingerprints of b; those of a only connect them
    for x in a:
        hits = near(np.full(len(b), x), b, radius)
        first = hits[np.unique(tree[hits], return_index=True)[1]]
        for y in b[first].tolist():
            if y != int(x):
                forest.join(int(x), y)
        if len(first) > 1:
            tree[np.isin(tree, tree[first])] = tree[first[0]]


LINKS = "a long, b long, cell long"


def grid_links(distinct: DataFrame, radius: int = RADIUS, cell_size: int = CELL) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` bits; ``distinct`` has one column fp."""
    if radius != RADIUS:
        raise ValueError("the projections are laid out for one radius")

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                some = fps[at : at + 4096]
                cells = cells_of(some.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1)), pa.array(np.repeat(some, cells.shape[1]))], ["cell", "fp"])

    def out(links, cells=None):
        import pyarrow as pa

        a = np.array([x for x, _ in links], np.uint64).astype(np.int64)
        b = np.array([y for _, y in links], np.uint64).astype(np.int64)
        c = pa.nulls(len(a), pa.int64()) if cells is None else pa.array(np.asarray(cells, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), c], ["a", "b", "cell"])

    def sweep(batches):
        """Cells come in order. A cell that a batch cuts off is held back; a hot one is handed on row by row."""
        held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.concatenate([held_c, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)])
            yield from settle(cells, fps, False, hot)
            last = int(np.searchsorted(cells, cells[-1]))
            if cells[-1] == hot or len(cells) - last > cell_size:
                if cells[-1] != hot:
                    last_rows = fps[last:]
                    yield out([(x, x) for x in last_rows.tolist()], cells[last:])
                hot, held_c, held_f = int(cells[-1]), cells[:0], fps[:0]
            else:
                held_c, held_f = cells[last:], fps[last:]
        yield from settle(held_c, held_f, True, hot)

    def settle(cells, fps, ended, hot):
        if not len(cells):
            return
        starts = np.concatenate([[0], np.nonzero(cells[1:] != cells[:-1])[0] + 1, [len(cells)]])
        sizes = np.diff(starts)
        big = (sizes > cell_size) | (cells[starts[:-1]] == (hot if hot is not None else -1))
        complete = np.ones(len(sizes), bool)
        complete[-1] = ended
        handed = np.repeat(big & (complete | (cells[starts[:-1]] == (hot if hot is not None else -1))), sizes)
        if handed.any():
            yield out([(x, x) for x in fps[handed].tolist()], cells[handed])
        swept = np.repeat(~big & complete, sizes)
        forest = Forest()
        links_in_runs(cells[swept], fps[swept], forest, radius)
        if forest.links:
            yield out(forest.links)

    rows = distinct.select("fp").mapInArrow(project, "cell long, fp long")
    found = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(sweep, LINKS)
    found = stored(found, "simhash-links")
    return found.where("cell IS NULL").select("a", "b").unionByName(hot_links(found.where("cell IS NOT NULL").select("cell", F.col("a").alias("fp")), radius, cell_size))


def hot_links(rows: DataFrame, radius: int, cell_size: int) -> DataFrame:
    """Links inside cells of many fingerprints: blocks of about ``cell_size``, each pair of blocks a task's group."""

    def compare(key, table):
        import pyarrow as pa

        fps = table.column("fp").to_numpy().astype(np.uint64)
        block = table.column("block").to_numpy()
        forest = Forest()
        i, j = key[1].as_py(), key[2].as_py()
        left, right = fps[block == i], fps[block == j]
        links_between(left, right, forest, radius)
        a = np.array([x for x, _ in forest.links], np.uint64).astype(np.int64)
        b = np.array([y for _, y in forest.links], np.uint64).astype(np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / cell_size).alias("blocks"))
    blocked = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    other = blocked.withColumn("o", F.explode(every))
    pairs = other.select("cell", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "fp")
    return pairs.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


# --- Components -------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node that has a link."""
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = spread_join(large, least, "u", "v")
        small = down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "cc")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal marks mean equal edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def clusters(documents: DataFrame) -> DataFrame:
    """doc_id, row_hash, fp and ``best``: the component's least (id missing, doc_id, row_hash)."""
    rows = stored(fingerprints(documents), "simhash")
    own = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row_hash")
    per_fp = stored(rows.groupBy("fp").agg(F.min(own).alias("best")), "simhash-distinct")
    roots = components(grid_links(per_fp.select("fp")))
    members = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "simhash-members")
    met = per_fp.join(members.withColumnRenamed("node", "fp"), "fp", "left")
    # A component may have a third of all fingerprints; most fingerprints are alone and are not joined again.
    together = met.where("root IS NOT NULL")
    leads = together.groupBy("root").agg(F.min("best").alias("lead"))
    together = spread_join(together.select("fp", "root"), leads, "root", "fp").select("fp", F.col("lead").alias("best"))
    best = met.where("root IS NULL").select("fp", "best").unionByName(together)
    return rows.join(best, "fp")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (least doc_id of all that can be reached)."""
    return clusters(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents with one of each component: that of the least doc_id, of repeated rows one."""
    best = clusters(documents).select("best.*").distinct()
    kept = best.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("row_hash").alias("hash"))
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    keyed = documents.select(F.struct("*").alias("row"), id_of.alias("id"), F.xxhash64("doc_id", "text").alias("hash"))
    return keyed.join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
