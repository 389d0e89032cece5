"""Rules over streams. Every rule looks at one row, so a stream needs no state and gives what a batch gives."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cleanspan.functions.catalogue import Recipe
from cleanspan.operators.reports import findings
from cleanspan.operators.rules import clean


def text_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def clean_stream(stream: DataFrame, column: str, recipe: str | Recipe | Mapping, path: str, checkpoint: str) -> StreamingQuery:
    """Cleans what is there into Parquet, then ends; called again it goes on from the checkpoint."""
    cleaned = clean(stream, column, recipe)
    return cleaned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_per_window(stream: DataFrame, key: str, column: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of findings by kind and event-time window, with a watermark for late rows."""
    found = findings(stream.withWatermark(time, late), [key, time], column)
    return found.groupBy(F.window(time, window), "kind").count()
