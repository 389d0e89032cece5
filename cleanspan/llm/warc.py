"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts archives into byte ranges; a task scans its range for
gzip magic, takes a candidate for a member only if it decompresses to a WARC header, and owns the records that
start inside its range, reading the last one past the end of the range if need be. After a record it goes on at
the next member's first byte, so bytes that look like magic inside a member only matter before a range's first
record, where the header check turns them away.

Of pages with equal payloads the one with the least page_id is written whole, as a response; the others revisit
it. Only payload digests and page ids are shuffled to find it; each different payload is shuffled to its response.

Defined results: a null page has an empty payload, a page of any length is one record; further columns, whatever their names,
are not looked at; a null page_id has a record id made of payload and URL; rows with a null page_id come last within their payload; of
rows equal in page_id, url and payload one is the first, the others revisit it; an empty table gives no archive and
no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AtomicFile, filesystem, fresh_path, stored, text_of

#: Byte ranges of archives; so many go to one task, so that there are not more tasks than a scheduler likes.
SPLIT_BYTES = 8 << 20
TASK_BYTES = 128 << 20
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 20
MIN_REVISIT_BYTES = 0
GZIP_MAGIC = b"\x1f\x8b\x08"
#: Bytes that a candidate member may take to show the first line of a record.
FIRST_LINE = b"WARC/1."

#: The pages have no date; a fixed one lets a task that runs twice write the same bytes.
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, n_bytes long, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A row for each record: page_id, url, html (null for a revisit), revisits, original, sha and size.

    Which page comes first is found without the pages' bodies. Equal bodies are one row before they are shuffled.
    """
    payload = text_of("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of(F.col("html").cast("string")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(payload), "size": F.octet_length(payload)})
    own = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", F.col("url").isNull().alias("bare"), F.coalesce("url", F.lit("")).alias("url"))
    counts = rows.groupBy("sha", "size", own.alias("own")).agg(F.count("*").alias("n"))
    firsts = counts.groupBy("sha").agg(F.min("own").alias("first"))
    met = counts.join(firsts, "sha").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    leads = (F.col("own") == F.col("first")) & (F.col("copy") == 1)
    revisits = ~leads & (F.col("size") >= least)
    url = F.when(~F.col("own.bare"), F.col("own.url"))
    records = met.select("sha", "size", F.col("own.page_id").alias("page_id"), url.alias("url"), revisits.alias("revisits"), F.when(revisits, F.col("first.page_id")).alias("original"))
    whole = records.where(~F.col("revisits")).join(rows.select("sha", "html").dropDuplicates(["sha"]), "sha")
    again = records.where("revisits").withColumn("html", F.lit(None).cast("string"))
    return whole.unionByName(again).select("page_id", "url", "html", "revisits", "original", "sha", "size")


def record(page_id, url, page, revisits: bool, original, sha: str | None = None, size: int | None = None) -> bytes:
    """One gzip member with a response record, or with a revisit of a payload of this SHA-1 (hexadecimal) and size."""
    body = b"" if revisits else (page or "").encode()
    digest = base64.b32encode(bytes.fromhex(sha)).decode() if sha else digest_of(body)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines.append(f"WARC-Date: {DATE}")
    lines.append(f"X-Payload-Length: {len(body) if size is None else size}")
    if page_id is None:
        lines.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {url}')}>")
    else:
        lines.append(f"WARC-Record-ID: <urn:x-page:{page_id}>")
    if url is not None:
        # No line breaks inside a header; the bytes of a URL that has some are escaped, and read back as they were.
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url) if re.search(r"[\r\n]", url) else f"WARC-Target-URI: {url}")
        if re.search(r"[\r\n]", url):
            lines.append("X-Target-Escaped: yes")
    if revisits:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if original is not None:
            lines.append(f"WARC-Refers-To: <urn:x-page:{original}>")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    raw = "\r\n".join(lines).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write(pages: DataFrame, folder: str, least: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of each partition into ``folder``, a new archive once one has ``archive_bytes``; the manifest."""

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), []
        out, count = None, 0
        try:
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(7)), strict=True):
                    if out is not None and out.size >= archive_bytes:
                        out.commit()
                        done.append((out.uri, out.size, count))
                        out, count = None, 0
                    out = out or AtomicFile(f"{folder}/part-{part:06d}-{len(done):04d}.warc.gz")
                    out.write(record(*(v.as_py() for v in row)))
                    count += 1
            if out is None:
                return
            out.commit()
            done.append((out.uri, out.size, count))
        except BaseException:
            if out is not None:
                out.abort()
            raise
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "n_bytes", "records"])

    return with_originals(pages, least).mapInArrow(put, MANIFEST)


class Range:
    """Bytes of an archive from an offset on, fetched in chunks and dropped once passed."""

    def __init__(self, path: str, start: int):
        store, at = filesystem(path)
        self.file = store.open_input_file(at)
        self.end = self.file.size()
        self.base, self.data = start, b""

    def upto(self, offset: int) -> bool:
        """Makes sure that the byte before ``offset`` is held; false past the end of the file."""
        while self.base + len(self.data) < min(offset, self.end):
            at = self.base + len(self.data)
            self.data += self.file.read_at(min(CHUNK, self.end - at), at)
        return offset <= self.end

    def drop(self, offset: int) -> None:
        self.data = self.data[offset - self.base :]
        self.base = offset

    def find_magic(self, start: int, stop: int) -> int:
        """Offset of the first magic that starts in [start, stop), or -1."""
        while start < stop:
            self.drop(start)
            limit = min(start + CHUNK, stop)
            self.upto(limit + len(GZIP_MAGIC) - 1)
            found = self.data.find(GZIP_MAGIC, 0, limit - start + len(GZIP_MAGIC) - 1)
            if found >= 0:
                return start + found
            start = limit
        return -1

    def member(self, start: int) -> tuple[bytes, int] | None:
        """The decompressed member at ``start`` and the offset after it; None if it is no WARC record."""
        unpack = zlib.decompressobj(31)
        out, at, checked = [], start, False
        try:
            while not unpack.eof:
                if not self.upto(at + 1):
                    return None  # cut off at the end of the file
                piece = self.data[at - self.base : at - self.base + (CHUNK if checked else 512)]
                out.append(unpack.decompress(piece))
                at += len(piece)
                if not checked and sum(map(len, out)) >= len(FIRST_LINE):
                    if not b"".join(out).startswith(FIRST_LINE):
                        return None
                    checked = True
        except zlib.error:
            return None
        raw = b"".join(out)
        return (raw, at - len(unpack.unused_data)) if raw.startswith(FIRST_LINE) and b"\r\n\r\n" in raw else None


def parse(raw: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and html of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    payload = rest[: int(fields.get("content-length", 0))]

    def number(name: str) -> int | None:
        value = fields.get(name, "").strip("<>")
        return int(value.removeprefix("urn:x-page:")) if value.startswith("urn:x-page:") else None

    url = fields.get("warc-target-uri")
    if "x-target-escaped" in fields:
        url = re.sub("%(0A|0D|25)", lambda m: chr(int(m[1], 16)), url)
    whole = kind == "response"
    size = len(payload) if whole else int(fields.get("x-payload-length", 0))
    sha = digest_of(payload) if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:")
    page = payload.decode() if whole else None
    return number("warc-record-id"), url, size, sha, kind, number("warc-refers-to"), page


def records_in(path: str, start: int, stop: int):
    """Raw records that start in the bytes [start, stop) of an archive."""
    data = Range(path, start)
    with data.file:
        at = start
        while (at := data.find_magic(at, stop)) >= 0:
            got = data.member(at)
            if got is None:
                at += 1
                continue
            raw, at = got
            yield raw


def splits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges (path, start, stop) of the archives."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))
    rows = manifest.where("n_bytes > 0").select("path", "n_bytes", F.explode(starts).alias("start"))
    return rows.select("path", "start", F.least(F.col("start") + split_bytes, "n_bytes").alias("stop"))


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives; without ``payloads`` html stays null."""

    def get(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        held, size = [], 0
        for batch in batches:
            for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for raw in records_in(path, start, stop):
                    row = parse(raw)
                    held.append(row if payloads else (*row[:-1], None))
                    size += len(raw)
                    if size > 4 * CHUNK or len(held) >= 2000:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    ranges = stored(splits(manifest, split_bytes), "warc-splits")
    # One range a task up to some hundred tasks, then more ranges a task.
    n = ranges.count()
    tasks = max(min(n, 512), -(-n * split_bytes // TASK_BYTES))
    return ranges.repartition(max(1, tasks), "path", "start").mapInArrow(get, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives, then reads them back."""
    manifest = stored(write(pages, folder or fresh_path(pages.sparkSession, "warc"), least), "warc-manifest")
    return read(manifest, payloads=False)
