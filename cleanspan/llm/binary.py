"""Token ids in compressed binary files: a context-mixing range coder over independent blocks.

A block holds whole documents of together about ``BLOCK_IDS`` ids and starts from an empty model, so each
can be read alone; its header has the document ids, their lengths and checksums of ids and coded bytes. Inside a
block the ids are laid out in lanes of equal length that are coded in step with each other: at step t every
lane codes its t-th id, and the model, which all lanes share, learns from all of them before step t + 1.
So the coder works on whole vectors.

For each id three models speak. Order 2 and order 1 each predict one id, the last one seen after the same two
(or one) ids; a table of adaptive counts, chosen by how often those predictions have held lately, mixes them
into the probabilities of "the order-2 prediction", "the order-1 prediction" and "another id". Another id is
coded by the order-0 model, the frequencies of all ids so far in the block, brought up to date at growing distances.

Defined results: a null text is an empty one and has only its end id; a text of any length lies in one block whole; null ids come
first; rows that share an id are kept, ordered by text hash, and repeated rows one after the other; an id of 65,536 or more
fails the writing; further columns, whatever their names, are not looked at; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import AtomicFile, filesystem, fresh_path, stored
from .tokens import default_tokenizer, encoder

MAGIC = b"CSTK0001"
BLOCK_MAGIC = b"CSBK"
VOCABULARY = 65536
END_ID = 1
BLOCK_IDS = 1 << 20
MAX_LANES = 4096
#: Ids that a lane has at least, in blocks of many ids.
LANE_IDS = 128
CONTEXT_BITS = 18
MIX_BITS, ORDER0_BITS = 12, 20
#: The coder's range stays at or above BOT; coded words have 16 bits.
BOT = np.uint64(1 << 40)
TOP = np.uint64(48)
U = np.uint64
LOW32 = U(0xFFFFFFFF)


class Model:
    """The adaptive state that encoder and decoder keep alike."""

    def __init__(self) -> None:
        # Of each context: the predicted id above its standing, 0 to 7.
        self.table2, self.table1 = np.zeros(1 << CONTEXT_BITS, np.uint32), np.zeros(VOCABULARY, np.uint32)
        self.counts = np.zeros(VOCABULARY, np.int64)
        self.seen, self.due, self.steps = 0, 2048, 0
        self.waiting: list[np.ndarray] = []
        # Of each pair of standings: weight of order 2, order 1 and neither.
        self.mixed = np.tile(np.array([1.0, 1.0, 2.0]), (64, 1))
        self._mix_tables()
        self._order0()

    def _order0(self) -> None:
        """Frequencies of all ids with sum 2 ** ORDER0_BITS, one at least for each; the last entry is the whole range."""
        whole = 1 << ORDER0_BITS
        freq = np.ones(VOCABULARY, np.int64)
        if self.seen:
            freq += self.counts * (whole - VOCABULARY) // self.seen
        freq[int(freq.argmax())] += whole - int(freq.sum())
        self.sizes0 = freq
        starts = np.cumsum(freq) - freq
        self.place0 = np.append((starts << 32) | freq, whole).astype(np.uint64)
        self.symbol0: np.ndarray | None = None

    def symbols(self) -> np.ndarray:
        if self.symbol0 is None:
            self.symbol0 = np.repeat(np.arange(VOCABULARY, dtype=np.uint32), self.sizes0)
        return self.symbol0

    def _mix_tables(self) -> None:
        total = (1 << MIX_BITS) - 3
        freq = np.floor(self.mixed / self.mixed.sum(axis=1, keepdims=True) * total).astype(np.int64) + 1
        freq[:, 2] += (1 << MIX_BITS) - freq.sum(axis=1)
        starts = np.cumsum(freq, axis=1) - freq
        self.place_mix = ((starts << 32) | freq).astype(np.uint64).reshape(-1)
        self.bound1, self.bound2 = starts[:, 1].astype(np.uint64), starts[:, 2].astype(np.uint64)

    def predict(self, one: np.ndarray, two: np.ndarray):
        """Contexts, entries and pair of standings for lanes whose last ids are ``one`` and, before, ``two``."""
        at = ((one * 40503 + two * 24421) >> 3) & ((1 << CONTEXT_BITS) - 1)
        e2, e1 = self.table2.take(at), self.table1.take(one)
        return at, e2, e1, ((e2 & 7) << 3) | (e1 & 7)

    def learn(self, ids: np.ndarray, chosen: np.ndarray, one, at, e2, e1) -> None:
        self.table2[at] = _taught(e2, ids)
        self.table1[one] = _taught(e1, ids)
        self.mixed += np.bincount(chosen, minlength=192).reshape(64, 3)
        if self.mixed[:, 2].max() > 1e6:
            self.mixed *= 0.5
        self.steps += 1
        if self.steps < 16 or not self.steps % 8:
            self._mix_tables()
        self.waiting.append(ids)
        self.seen += len(ids)
        if self.seen >= self.due:
            self.due = self.seen + min(self.seen, 1 << 18)
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=VOCABULARY)
            self.waiting = []
            self._order0()


def _taught(entries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries after ids were seen: a prediction that fails loses its standing, and is replaced once it has none."""
    known, standing = entries >> 3, entries & 7
    hit = known == ids
    kept = np.where(hit | (standing > 1), known, ids)
    return (kept << 3) | np.where(hit, np.minimum(standing + 1, 7), standing >> 1)


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids."""
    lanes = int(min(MAX_LANES, max(1, n // LANE_IDS)))
    return lanes, -(-n // lanes)


class Coder:
    """The lanes' ranges. A lane that has used up its range hands over 16 bits."""

    def __init__(self, lanes: int):
        self.low, self.wide = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, k: int, step: np.ndarray, place: np.ndarray) -> None:
        """The first k lanes go on to the part of their range that ``place`` names: start above, size below, in steps."""
        self.low[:k] += step * (place >> U(32))
        np.multiply(step, place & LOW32, out=self.wide[:k])

    def spent(self, k: int):
        """Lanes whose range is too small, and the ranges as they go on; to be asked until there is none."""
        while len(lanes := np.flatnonzero(self.wide[:k] < BOT)):
            low, wide = self.low[lanes], self.wide[lanes]
            straddles = ((low ^ (low + wide)) >> TOP) != 0
            wide = np.where(straddles, (~low + U(1)) & (BOT - U(1)), wide)
            yield lanes, low
            self.low[lanes], self.wide[lanes] = low << U(16), wide << U(16)


def encode_ids(ids: np.ndarray) -> bytes:
    """Coded bytes of up to 2 ** 32 - 1 ids below 65536: lengths of the lanes' codes, then the codes."""
    n = len(ids)
    if not n:
        return b""
    lanes, steps = shape(n)
    # Each lane has a run of the ids; only the last lanes may be short.
    grid = np.zeros(lanes * steps, np.uint32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    live = np.clip(n - np.arange(lanes) * steps, 0, steps)
    model, coder = Model(), Coder(lanes)
    room = steps * 3 + 16
    out = np.zeros(lanes * room, np.uint16)
    first = np.arange(lanes) * room
    place = first.copy()
    one = two = np.zeros(lanes, np.int64)
    for t in range(steps):
        k = lanes if live[-1] > t else int((live > t).sum())  # short lanes end; they are the last ones
        now, o, w = grid[t, :k], one[:k], two[:k]
        at, e2, e1, pair = model.predict(o, w)
        kind = np.where(e2 >> 3 == now, 0, np.where(e1 >> 3 == now, 1, 2))
        chosen = pair * 3 + kind
        coder.narrow(k, coder.wide[:k] >> U(MIX_BITS), model.place_mix.take(chosen))
        coder.narrow(k, coder.wide[:k] >> U(ORDER0_BITS), model.place0.take(np.where(kind == 2, now, VOCABULARY)))
        for spent, low in coder.spent(k):
            to = place[spent]
            out[to] = low >> TOP
            place[spent] = to + 1
        model.learn(now, chosen, o, at, e2, e1)
        two, one = one, np.concatenate([now.astype(np.int64), one[k:]])
    for _ in range(4):  # what is left of each lane's state
        out[place] = coder.low >> TOP
        place += 1
        coder.low <<= U(16)
    filled = place - first
    used = np.arange(room) < filled[:, None]
    return filled.astype("<u4").tobytes() + out.reshape(lanes, room)[used].astype("<u2").tobytes()


def decode_ids(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    lanes, steps = shape(n)
    length = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u2", offset=4 * lanes).astype(np.uint64), np.zeros(8, np.uint64)])
    place = np.cumsum(length) - length
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << U(16)) | words[place]
        place = place + 1
    live = np.clip(n - np.arange(lanes) * steps, 0, steps)
    grid = np.zeros((steps, lanes), np.uint32)
    model, coder = Model(), Coder(lanes)
    one = two = np.zeros(lanes, np.int64)
    for t in range(steps):
        k = lanes if live[-1] > t else int((live > t).sum())
        o, w, c = one[:k], two[:k], code[:k]
        at, e2, e1, pair = model.predict(o, w)
        step = coder.wide[:k] >> U(MIX_BITS)
        above = c - coder.low[:k]
        kind = (above >= step * model.bound1.take(pair)).astype(np.int64) + (above >= step * model.bound2.take(pair))
        chosen = pair * 3 + kind
        coder.narrow(k, step, model.place_mix.take(chosen))
        step = coder.wide[:k] >> U(ORDER0_BITS)
        value = np.minimum((c - coder.low[:k]) // step, U((1 << ORDER0_BITS) - 1))
        now = np.where(kind == 0, e2 >> 3, np.where(kind == 1, e1 >> 3, model.symbols().take(value.astype(np.int64))))
        coder.narrow(k, step, model.place0.take(np.where(kind == 2, now, VOCABULARY)))
        for spent, _ in coder.spent(k):
            from_ = place[spent]
            code[spent] = (code[spent] << U(16)) | words[from_]
            place[spent] = from_ + 1
        grid[t, :k] = now
        model.learn(now, chosen, o, at, e2, e1)
        two, one = one, np.concatenate([now.astype(np.int64), one[k:]])
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


# --- Files ------------------------------------------------------------------------------------------
#
# A file is MAGIC, then blocks. A block is BLOCK_MAGIC; documents, ids and coded bytes as unsigned 32-bit
# integers; CRC-32 of the ids (as unsigned 32-bit integers) and of all the bytes that follow; the document ids as
# signed 64-bit integers, a byte each for "has an id", the documents' lengths as unsigned 32-bit integers; the code.

HEADER = struct.Struct("<4sIIIII")


class DamagedBlock(ValueError):
    """A block whose checksum does not hold."""


def write_block(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) >= VOCABULARY:
        raise ValueError(f"ids must be below {VOCABULARY}")
    code = encode_ids(ids)
    body = (
        np.array([d or 0 for d in docs], "<i8").tobytes()
        + bytes(d is not None for d in docs)
        + np.array(lengths, "<u4").tobytes()
        + code
    )
    return HEADER.pack(BLOCK_MAGIC, len(docs), len(ids), len(code), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def read_blocks(stream, start: int = 0, stop: int | None = None):
    """Yields (document ids, lengths, ids) of the blocks of an open file that begin in the bytes [start, stop), one block in
    memory at a time. ``start`` is 0 or the first byte of a block."""
    at = start
    if not start:
        if stream.read(len(MAGIC)) != MAGIC:
            raise DamagedBlock("not a token file")
        at = len(MAGIC)
    while (stop is None or at < stop) and (head := stream.read(HEADER.size)):
        if len(head) < HEADER.size:
            raise DamagedBlock("a block is cut off")
        magic, n_docs, n_ids, n_code, ids_crc, body_crc = HEADER.unpack(head)
        body = stream.read(13 * n_docs + n_code)
        at += HEADER.size + len(body)
        if magic != BLOCK_MAGIC or zlib.crc32(body) != body_crc:
            raise DamagedBlock("a block's bytes do not match their checksum")
        docs = np.frombuffer(body, "<i8", n_docs)
        known = np.frombuffer(body, np.uint8, n_docs, 8 * n_docs)
        lengths = np.frombuffer(body, "<u4", n_docs, 9 * n_docs)
        ids = decode_ids(body[13 * n_docs :], n_ids).astype("<u4")
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise DamagedBlock("a block's ids do not match their checksum")
        yield [int(d) if k else None for d, k in zip(docs, known, strict=True)], lengths.tolist(), ids


#: Bytes of source tables that go into one file, about; files of less, as many as there are shuffle partitions.
FILE_BYTES = 256 << 20
#: Blocks that are read back by one task.
SPLIT_BLOCKS = 16

MANIFEST = "path string, part long, start long, stop long, first_doc long, docs long, n_ids long"


def write(
    documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, split_blocks: int = SPLIT_BLOCKS
) -> DataFrame:
    """Writes the documents' ids in ascending order of doc_id, one file for each range of ids; the manifest, which has a row
    for each run of blocks of a file.

    Files are renamed into place when whole, so a task that runs twice leaves one file.
    """
    path = tokenizer or default_tokenizer()

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.cstk"
        out, encode = None, encoder(path).encode_column
        docs: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        runs: list[list] = []
        size = 0

        def flush():
            nonlocal size, docs, lengths, held
            ids = np.concatenate(held)
            begins = out.size if runs else 0
            out.write(write_block(docs, lengths, ids))
            if not runs or runs[-1][-1] == split_blocks:
                runs.append([begins, 0, docs[0], 0, 0, 0])
            run = runs[-1]
            run[1], run[3], run[4], run[5] = out.size, run[3] + len(docs), run[4] + len(ids), run[5] + 1
            docs, lengths, held, size = [], [], [], 0

        try:
            for batch in batches:
                keys, at = batch.column(0).to_pylist(), 0
                for ids, counts in encode(batch.column(1)):
                    if out is None:
                        out = AtomicFile(name)
                        out.write(MAGIC)
                    ids, ends = np.insert(ids, np.cumsum(counts), end_id), np.cumsum(counts + 1)
                    names, done, k = keys[at : at + len(counts)], 0, 0
                    at += len(counts)
                    while k < len(names):  # up to the text that fills the block, or all that there are
                        stop = min(len(names), 1 + int(np.searchsorted(ends, done + block_ids - size)))
                        docs += names[k:stop]
                        lengths += (counts[k:stop] + 1).tolist()
                        held.append(ids[done : ends[stop - 1]])
                        size += len(held[-1])
                        k, done = stop, int(ends[stop - 1])
                        if size >= block_ids:
                            flush()
            if out is None:
                return
            if docs:
                flush()
            out.commit()
        except BaseException:
            if out is not None:
                out.abort()
            raise
        columns = [[name] * len(runs), [part] * len(runs), *zip(*(r[:5] for r in runs), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 6], strict=True)], [c.split()[0] for c in MANIFEST.split(", ")]
        )

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    # By the size of the source, which the plan of a scan knows without a pass over it; past a petabyte it is a guess.
    source = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = source // FILE_BYTES if source < 1 << 50 else 0
    many = files > int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(files, "doc_id", "h") if many else rows.repartitionByRange("doc_id", "h")
    return ranged.sortWithinPartitions("doc_id", "h").drop("h").mapInArrow(put, MANIFEST)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def get(batches):
        import pyarrow as pa

        for batch in batches:
            for path, begin, stop, before in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                store, at = filesystem(path)
                with store.open_input_file(at) as stream:
                    stream.seek(begin)
                    for docs, lengths, ids in read_blocks(stream, begin, stop):
                        raw, offset, crcs, starts = ids.tobytes(), 0, [], []
                        for n in lengths:
                            crcs.append(zlib.crc32(raw[4 * offset : 4 * (offset + n)]))
                            starts.append(before + offset)
                            offset += n
                        before += offset
                        columns = [docs, starts, lengths, crcs]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in READ.split(", ")])

    # Ids before each run: those of earlier files, of which there are few, and those of earlier runs of its own file.
    earlier = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min_by("first_doc", "start").alias("first_doc"))
    files = files.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_before"))
    runs = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(files, "part")
    runs = runs.select("path", "start", "stop", (F.col("file_before") + F.col("inside")).alias("before"))
    return runs.repartition(max(1, manifest.count()), "path", "start").mapInArrow(get, READ)


def round_trip(documents: DataFrame, tokenizer: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Writes the files, then reads them back."""
    spark: SparkSession = documents.sparkSession
    manifest = stored(write(documents, folder or fresh_path(spark, "tokens"), tokenizer, **options), "manifest")
    return read(manifest)
