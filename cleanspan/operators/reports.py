"""Findings as a table, and reports over it: ordinary aggregates, joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import found, inspection

#: Of each kind, what its findings are labelled with, and their detail.
KINDS = {
    "hidden": ("name", "codePoint"),
    "hiddenText": ("kind", "decoded"),
    "secretWarnings": ("label", "id"),
    "terminalControls": ("label", "detail"),
    "formulaLines": ("label", None),
}


def inspected(df: DataFrame, column: str, output: str = "inspection") -> DataFrame:
    return df.withColumn(output, inspection(F.col(column)))


def findings(df: DataFrame, key: str | list[str], column: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """A row for each finding of some kinds: key, kind, offset, length, line, column, label, detail, code_point.

    All findings: the cap of a thousand is one of the record, not of the table. Only the detectors of these kinds run.
    """
    keys = [key] if isinstance(key, str) else key
    record = df.select(*keys, found(F.col(column), tuple(kinds)).alias("i"))
    none = {"s": F.lit(None).cast("string"), "i": F.lit(None).cast("int")}

    def rows(kind: str) -> Column:
        label, detail = KINDS[kind]
        place = kind != "formulaLines"
        return F.transform(
            F.coalesce(F.col(f"i.{kind}"), F.array()),
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                (x["offset"] if place else none["i"]).alias("offset"),
                (x["length"] if place and kind != "hidden" else none["i"]).alias("length"),
                x["line"].alias("line"),
                (x["column"] if place else none["i"]).alias("column"),
                x[label].alias("label"),
                (x[detail] if detail else none["s"]).alias("detail"),
                (x["codePoint"] if kind in ("hidden", "terminalControls") else none["s"]).alias("code_point"),
            ),
        )

    every = rows(kinds[0]) if len(kinds) == 1 else F.concat(*map(rows, kinds))
    return record.select(*keys, F.explode(every).alias("f")).select(*keys, "f.*")


def without_findings(df: DataFrame, column: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """The rows whose text has no finding of these kinds: a filter, nothing is shuffled. A null text has none."""
    record = found(F.col(column), tuple(kinds))
    none = [F.coalesce(F.size(record[k]), F.lit(-1)) <= 0 for k in kinds]
    clean = none[0]
    for c in none[1:]:
        clean = clean & c
    return df.where(clean)


def remaining(record: Column, with_hidden_text: bool = False) -> Column:
    """Map of kind to how many findings a text still has, the omitted ones too."""
    omitted = {"secretWarnings": "likelySecrets"}
    kinds = [k for k in KINDS if with_hidden_text or k != "hiddenText"]
    pairs = [x for k in kinds for x in (F.lit(k), F.size(record[k]) + record["omittedFindings"][omitted.get(k, k)])]
    return F.create_map(*pairs)


def omitted_total(record: Column) -> Column:
    o = record["omittedFindings"]
    return o["hidden"] + o["hiddenText"] + o["likelySecrets"] + o["terminalControls"] + o["formulaLines"]


def grouped(found: DataFrame, key: str) -> DataFrame:
    """Runs of hidden characters of one name that stand side by side, as one row each with first and last code point."""
    hidden = found.where("kind = 'hidden'")
    order = Window.partitionBy(key).orderBy("offset")
    width = F.when(F.length("code_point") > 6, 2).otherwise(1)
    before = F.lag("offset").over(order) + F.lag(width).over(order)
    begins = ~F.coalesce((F.lag("label").over(order) == F.col("label")) & (before == F.col("offset")), F.lit(False))
    runs = hidden.withColumn("run", F.sum(begins.cast("int")).over(order))
    return runs.groupBy(key, "run").agg(
        F.min("label").alias("label"),
        F.min("offset").alias("offset"),
        F.count("*").alias("count"),
        F.min_by("code_point", "offset").alias("first"),
        F.max_by("code_point", "offset").alias("last"),
    ).drop("run")


def by_kind(found: DataFrame, *dimensions: str) -> DataFrame:
    """Findings per kind and dimension, with subtotals."""
    return found.rollup(*dimensions, "kind").agg(F.count("*").alias("n"))
