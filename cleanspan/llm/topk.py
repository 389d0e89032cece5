"""Exact top-k inner products by the threshold algorithm.

Candidates are cut into blocks; a block keeps, for each dimension, its vectors' order by that component. The
threshold algorithm walks all lists in step, from the end that helps: after t entries of each list every vector
seen has been scored exactly, and no other can score more than the sum over the dimensions of the query's
component times the component at depth t. It stops for a query once that bound is below the query's k-th
score, or below a score that k vectors of a sample reach, which all blocks share: most blocks are left after few steps. Depth is
doubled from step to step, and the queries of a block that are still open share the walk, since
their lists are the same: both ends of each dimension.

Queries are blocked, too; each pair of a query block and a candidate block is one group, so neither side is ever
sent whole to one place, and the k best of each pair are merged by query.

Defined results: a null vector, or one with a null or non-finite component, takes no part, nor does a null
vec_id; vectors of unequal length score over the components that both have; rows that repeat a vec_id are
candidates each, but never for a query of their own id; a query that is repeated row by row is answered once; equal scores
are ranked by rising vec_id; further columns, whatever their names, are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
EVERY = 50
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
FIRST_DEPTH = 32
#: Candidates whose scores give each query its first bound.
SAMPLE = 1024


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: components as integers, of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False)
    )
    return vectors.where("vec_id IS NOT NULL").where(sound).select(F.col("vec_id").cast("long"), whole.alias("v"))


def blocked(rows: DataFrame, size: int, name: str, count: int) -> DataFrame:
    blocks = max(1, -(-count // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), blocks


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, known: np.ndarray | None = None):
    """Scores and ids of the k best of one block for each query, by the threshold algorithm.

    ``known`` are scores that k candidates of each query reach somewhere: a block whose bound is below it has none of the k.
    """
    n, dims = vectors.shape
    known = np.full(len(queries), -np.inf) if known is None else known
    order = np.argsort(vectors, axis=0, kind="stable")  # rising; the falling lists are its reverse
    seen = np.zeros(n, bool)
    best_scores = np.full((len(queries), k), -np.inf)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    # Before any list is walked: the ends of all lists bound every score of the block.
    bound = np.maximum(queries, 0) @ vectors.max(axis=0) + np.minimum(queries, 0) @ vectors.min(axis=0)
    open_rows = np.nonzero(bound >= known)[0]
    depth = 0
    while len(open_rows) and depth < n:
        depth = min(n, max(FIRST_DEPTH, depth * 2))
        ends = np.unique(np.concatenate([order[:depth].ravel(), order[n - depth :].ravel()]))
        new = ends[~seen[ends]]
        seen[new] = True
        q = queries[open_rows]
        if len(new):
            scores = q @ vectors[new].T
            scores[ids[new][None, :] == query_ids[open_rows][:, None]] = -np.inf
            best_scores[open_rows], best_ids[open_rows] = merged(best_scores[open_rows], best_ids[open_rows], scores, ids[new], k)
        if seen.all():
            break
        low, high = vectors[order[depth - 1], np.arange(dims)], vectors[order[n - depth], np.arange(dims)]
        bound = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
        # A tie with the k-th score could still win by its id, so only a lower bound ends the walk.
        open_rows = open_rows[bound >= np.maximum(best_scores[open_rows, -1], known[open_rows])]
    return best_scores, best_ids


def merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int):
    """The k best of both by falling score, then rising id."""
    if more.shape[1] > k:
        # Everything at or above the k-th score stays, so ties are settled by id below.
        edge = -np.partition(-more, k - 1, axis=1)[:, k - 1]
        keep = max(int((more >= edge[:, None]).sum(axis=1).max()), k)
        ordered = np.argsort(more_ids, kind="stable")
        more, more_ids = more[:, ordered], more_ids[ordered]
        top = np.argsort(-more, axis=1, kind="stable")[:, :keep] if keep > 4 * k else np.argpartition(-more, keep - 1, axis=1)[:, :keep]
        more, more_ids = np.take_along_axis(more, top, 1), more_ids[top]
    else:
        more_ids = np.broadcast_to(more_ids, more.shape)
    scores, ids = np.concatenate([scores, more], axis=1), np.concatenate([ids, more_ids], axis=1)
    at = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)


def known_scores(queries: DataFrame, candidates: DataFrame, k: int, sample: int = SAMPLE) -> DataFrame:
    """Adds ``known`` to the queries: the k-th best score among ``sample`` candidates, a lower bound of the k-th best of all.

    The sample is of a fixed number of vectors, the first by hash, and serves the bound only: no candidate is left out for it.
    """
    chosen = candidates.select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).collect()
    ids = np.array([r.vec_id for r in chosen], np.int64)
    dims = max((len(r.v) for r in chosen), default=0)
    vectors = np.zeros((len(chosen), dims))
    for row, r in zip(vectors, chosen, strict=True):
        row[: len(r.v)] = r.v

    def bound(batches):
        import pyarrow as pa

        for batch in batches:
            own, of = batch.column(0).to_numpy(), batch.column(1)
            known = np.full(len(own), -np.inf)
            if len(own) and len(ids) > k:
                wide = max(dims, max(map(len, of.to_pylist())))
                q = matrix(of, wide)[:, :dims]
                scores = q @ vectors.T
                scores[ids[None, :] == own[:, None]] = -np.inf
                known = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known)], [*batch.schema.names, "known"])

    return queries.mapInArrow(bound, "vec_id long, v array<double>, known double")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by ``every``."""
    rows = quantized(vectors, scale)
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    queries = known_scores(rows.where(F.col("vec_id") % every == 0).distinct(), rows, k)
    queries, query_blocks = blocked(queries, query_block, "qb", counts.q)
    candidates, candidate_blocks = blocked(rows, candidate_block, "cb", counts.n)
    queries = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))))
    candidates = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(key, left, right):
        import pyarrow as pa

        names = ["query_id", "q_hash", "vec_id", "score"]
        empty = pa.table({c: pa.array([], pa.int64()) for c in names})
        if not left.num_rows or not right.num_rows:
            return empty
        dims = max(len(v) for t in (left, right) for v in t.column("v"))
        q, v = matrix(left.column("v"), dims), matrix(right.column("v"), dims)
        query_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        scores, found = best_of_block(q, query_ids, v, ids, k, left.column("known").to_numpy())
        ok = np.isfinite(scores)
        out = [np.repeat(query_ids, ok.sum(axis=1)), np.repeat(left.column("q_hash").to_numpy(), ok.sum(axis=1)), found[ok], scores[ok].astype(np.int64)]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, out, strict=True)})

    queries = queries.select("vec_id", "v", "known", "qb", "cb", F.xxhash64("v").alias("q_hash"))
    pairs = queries.groupBy("qb", "cb").cogroup(candidates.select("vec_id", "v", "qb", "cb").groupBy("qb", "cb"))
    local = pairs.applyInArrow(search, "query_id long, q_hash long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def matrix(column, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with 0, which adds nothing to a product."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if hasattr(flat, "num_chunks"):
        import pyarrow as pa

        flat = pa.concat_arrays(flat.chunks)
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(x) for x in lengths]) if len(lengths) else []] = values
    return out
