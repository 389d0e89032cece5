"""Helpers that the training-data operators share: word splitting, shared storage, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; optimizer rules cannot inline it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str | Column) -> Column:
    """The text, or the empty string for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text as an array; empty where there is none."""
    # Single blanks are left alone, so that nearly nothing is replaced and the split is on one plain character.
    even = F.regexp_replace(F.btrim(text, F.lit(SPACE)), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")
    return let(even, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ", -1)))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a new local one if
    all runs in one process, as in tests; on a cluster this fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="cleanspan-")
        else:
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The tables stay, as results are read from them; :func:`release` deletes them.
    """
    path = fresh_path(df.sparkSession, name)
    _stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this process has stored, once their results have been used."""
    while _stored:
        target = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Parts that the rows of one key are dealt into.
PARTS = 16


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, parts: int = PARTS) -> DataFrame:
    """Inner join of many rows of a key with its one row, where a key may have a large share of all rows: these are dealt
    into parts by the hash of another column, and the one row is there for each part. Never a broadcast: the plan does not
    see that the other side grows by the parts."""
    dealt = many.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copied = one.withColumn("__part", F.explode(F.array(*map(F.lit, range(parts)))))
    return dealt.join(copied.hint("merge"), [key, "__part"]).drop("__part")


# --- Binary files on the shared store, used inside tasks -------------------------------------------


def filesystem(uri: str):
    """A pyarrow file system and the path in it. ``file:`` and plain paths are local to the shared mount."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class AtomicFile:
    """Writes under a temporary name and renames on success, so a retried or doubled task leaves one whole file."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{os.path.dirname(self.path)}/.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)
