"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cleanspan.sources.text import read_spread

from . import binary, htmltext, mixing, packing, quality, sharding, simhash, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; one of few row groups is dealt out over all cores."""
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op2_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_low_discrepancy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_html_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [
        op1_quality_divergence,
        op2_cutting_stock_packing,
        op3_virtual_slot_sharding,
        op4_low_discrepancy_mixing,
        op5_html_block_rules,
        op6_weak_supervision_toxicity,
        op7_warc_round_trip,
        op8_threshold_top_k,
        op9_simhash_segments,
        op10_context_mixing_files,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
