"""Packing documents into sequences by cutting-stock column generation.

A document is first cut at fixed places: as many whole sequences as it fills, then a part that is a multiple of
``QUANTUM`` ids, then the rest. So every piece has one of some 160 lengths. The counts of pieces by length are
a cutting-stock problem: patterns of pieces that fit a sequence, as few sequences as possible. Its linear
program starts from one-length patterns; a knapsack dynamic program over the dual prices finds the next
pattern to enter, until none pays. Rounded pattern counts, and first-fit-decreasing sequences for what
rounding left, are a plan of bounded size: it depends on the lengths only, not on the documents. The k-th
piece of a length, in the order of document ids, takes the k-th place that the plan has for that length.

Defined results: a null text is an empty one and still has its end id; a text of any length is cut into as many pieces as it
takes; null ids come first in their length's order; rows equal in id and text are packed once each, in either order, which are
the only ties; further columns, whatever their names, are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_tokenizer, encoder, raw_texts

CAPACITY = 4096
QUANTUM = 128
END_ID = 2
#: The pricing stops when the best new pattern would save less than this share of a sequence.
TOLERANCE = 1e-6
#: Rounds of the simplex for each length, at most, and how often its inverse is made anew.
ROUNDS = 60
REFACTOR = 64
#: Pieces of one length are numbered in parts, by document: so many, and more once a part would pass so many rows.
PARTS = 64
PART_ROWS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int = CAPACITY, quantum: int = QUANTUM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    whole = n // capacity
    pieces = [(i * capacity, capacity) for i in range(whole)]
    at = whole * capacity
    for part in ((n - at) // quantum * quantum, (n - at) % quantum):
        if part:
            pieces.append((at, part))
            at += part
    return pieces


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, quantum: int = QUANTUM, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document, with the checksum of its ids."""
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        encode = encoder(path).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, quantum):
                    for column, value in zip(out, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


# --- The plan: driver-side, on counts by length only ------------------------------------------------


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the room: the pattern of highest price that fits.

    A length is taken in for all rooms at once: rooms that differ by whole multiples of it make a column, in which the best
    number of pieces is a running maximum of the price before it less the pieces passed.
    """
    best = np.zeros(capacity + 1)
    paying = np.nonzero(prices > 0)[0]
    for i in paying[np.argsort(lengths[paying], kind="stable")].tolist():
        length = int(lengths[i])
        rows = capacity // length + 1
        grid = np.full(rows * length, -np.inf)
        grid[: capacity + 1] = best
        passed = (np.arange(rows) * prices[i])[:, None]
        best = (np.maximum.accumulate(grid.reshape(rows, length) - passed, axis=0) + passed).reshape(-1)[: capacity + 1]
    best = np.maximum.accumulate(best)
    pattern, room = np.zeros(len(lengths), dtype=np.int64), capacity
    while True:  # back from the full room: a last piece that explains the price, until none does
        fits = paying[lengths[paying] <= room]
        if not len(fits):
            break
        values = best[room - lengths[fits]] + prices[fits]
        k = int(values.argmax())
        if values[k] <= 1e-12 or values[k] < best[room] - 1e-9:
            break
        pattern[fits[k]] += 1
        room -= int(lengths[fits[k]])
    return float(prices @ pattern), pattern


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Inverse by row operations with pivots, in this thread only: a library's threads would wait for each other in a
    driver whose cores are busy."""
    m = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(m)], axis=1)
    for c in range(m):
        pivot = c + int(np.abs(work[c:, c]).argmax())
        if pivot != c:
            work[[c, pivot]] = work[[pivot, c]]
        work[c] /= work[c, c]
        factors = work[:, c].copy()
        factors[c] = 0
        work -= factors[:, None] * work[c]
    return work[:, m:]


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional counts that solve the linear program.

    Revised simplex: the basis has one pattern for each length; the pattern that the knapsack prices above one
    sequence enters, the first to reach zero leaves. The inverse is updated by the pivot and made anew every
    ``REFACTOR`` rounds. After ``rounds``, by default ``ROUNDS`` for each length, the basis at hand is taken, which is a
    solution as well, if not the best one.
    """
    m = len(lengths)
    basis = np.diag(np.maximum(capacity // lengths, 1)).astype(float)  # columns are patterns
    inverse = np.diag(1 / np.diag(basis))
    # Demands are moved apart a little, so that no two patterns reach zero at once and the simplex cannot cycle.
    rhs = demand * (1 + 1e-7 * np.arange(1, m + 1) / m)
    for step in range(1, (ROUNDS * m if rounds is None else rounds) + 1):
        x = (inverse * rhs).sum(axis=1)
        value, pattern = best_pattern(lengths, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + TOLERANCE:
            break
        direction = (inverse * pattern).sum(axis=1)
        ok = direction > 1e-10
        if not ok.any():
            break
        ratios = np.full(m, np.inf)
        ratios[ok] = np.maximum(x[ok], 0) / direction[ok]
        leaves = int(ratios.argmin())
        basis[:, leaves] = pattern
        # By Farley's bound no solution has fewer than sum(x) / value sequences.
        if np.maximum(x, 0).sum() * (1 - 1 / value) < 0.25:
            break
        if step % REFACTOR:
            inverse[leaves] /= direction[leaves]
            direction[leaves] = 0
            inverse -= direction[:, None] * inverse[leaves]
        else:
            inverse = inverse_of(basis)
    x = np.maximum((inverse_of(basis) * demand).sum(axis=1), 0)
    return basis.T.round().astype(np.int64), x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for the pieces of each length: rows (length, first, places, sequence, each, offset).

    Pieces number ``first`` to ``first + places - 1`` of a length go, ``each`` to a sequence, into the sequences
    from ``sequence`` on, one after the other from ``offset`` in it. Patterns keep the pieces of one length together.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    lengths = np.array(sorted(counts, reverse=True), dtype=np.int64)
    left = np.array([counts[k] for k in lengths.tolist()], dtype=np.int64)
    used = np.zeros(len(lengths), dtype=np.int64)
    sequence = 0

    def lay(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence, left, used
        offset = 0
        for i in np.nonzero(pattern)[0]:
            each, length = int(pattern[i]), int(lengths[i])
            rows.append((length, int(used[i]), each * times, sequence, each, offset))
            offset += each * length
        used = used + pattern * times
        left = left - pattern * times
        sequence += times

    if len(lengths):
        patterns, x = column_generation(lengths, left, capacity)
        for pattern, times in sorted(zip(patterns.tolist(), x.tolist(), strict=True), key=lambda p: (-p[1], p[0])):
            pattern = np.array(pattern)
            whole = int(times + 1e-6)
            fits = int((left[pattern > 0] // pattern[pattern > 0]).min()) if pattern.any() else 0
            if whole := min(whole, fits):
                lay(pattern, whole)
        for pattern, times in sorted(zip(patterns.tolist(), x.tolist(), strict=True), key=lambda p: (-(p[1] % 1), p[0])):
            pattern = np.array(pattern)
            # Rounded up where the rest allows it, and where the pattern fills its sequence.
            if times % 1 > 1e-6 and (pattern <= left).all() and pattern @ lengths == capacity:
                lay(pattern, 1)
    while left.any():  # first fit decreasing, one sequence at a time
        room, pattern = capacity, np.zeros(len(lengths), dtype=np.int64)
        for i, length in enumerate(lengths.tolist()):
            pattern[i] = min(int(left[i]), room // length)
            room -= int(pattern[i]) * length
        lay(pattern, int((left[pattern > 0] // pattern[pattern > 0]).min()))
    return rows


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stored(pieces(documents, tokenizer, capacity, quantum), "pieces")
    # One row for each of the possible lengths, at most capacity / quantum + quantum.
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(parts)).cast("int"))
    cells = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    rows = sorted(plan(counts, capacity))
    # Numbers within a length without gaps: first number of each (length, part) cell, then order inside the cell.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    cell = Window.partitionBy("length", "part").orderBy("doc_id", "doc_tokens", "start", "ids_crc32")
    numbered = cut.withColumn("place", F.row_number().over(cell) - 1).join(starts, ["length", "part"])
    numbered = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("rank"))
    return placed(numbered, rows)


def placed(numbered: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Looks each piece up in the plan, by its length and its number. The plan is bounded by the lengths squared."""
    table = np.array(rows, dtype=np.int64).reshape(-1, 6)

    def look_up(batches):
        import pyarrow as pa

        # Length in the high bits, number in the low ones: one sorted key.
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            found = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            k = rank - found[:, 1]
            sequence = found[:, 3] + k // found[:, 4]
            offset = found[:, 5] + k % found[:, 4] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return numbered.mapInArrow(look_up, PIECES + ", sequence_id long, offset long")
