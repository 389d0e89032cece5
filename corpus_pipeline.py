"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage is ``(name, function)``; the function takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's documents. All but the last return the columns of documents.

Defined results: each stage treats nulls, empty and very long texts, ties, repeated rows and further columns as its operator's
module says; an empty table goes through all stages and gives an empty table. The mixing stage writes its documents in the order of
the mix, a document as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanspan.llm import common, mixing, packing, quality, simhash, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_quality),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
