"""The engine in SQL: a function for every rule, the inspection, the preview and the diff, and a table function of findings.

Rules that are expressions become SQL functions with that expression as their body, so they stay in the JVM.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanspan.functions import texts
from cleanspan.operators import diff, html, preview, rules, scan

FINDING = "kind string, offset int, length int, line int, col int, label string, detail string"
OPERATORS = {"+", "-", "*", "/", "=", "<", ">", "<=", ">=", "and", "or", "&&", "||"}


def sql_of(node) -> str:
    """SQL text of a Column's node. Spark's own text has operators in front of their arguments, which does not parse."""
    kind = node.getClass().getSimpleName()

    def all_of(items) -> list[str]:
        return [sql_of(items.apply(i)) for i in range(items.size())]

    if kind == "UnresolvedFunction":
        name, given = node.functionName(), all_of(node.arguments())
        if name in OPERATORS and len(given) == 2:
            return f"({given[0]} {({'&&': 'AND', '||': 'OR'}).get(name, name)} {given[1]})"
        if name in ("!", "not"):
            return f"(NOT {given[0]})"
        return f"{name}({', '.join(given)})"
    if kind == "Alias":
        return f"{sql_of(node.child())} AS {node.name().apply(0)}"
    if kind == "Cast":
        return f"CAST({sql_of(node.child())} AS {node.dataType().sql()})"
    if kind == "CaseWhenOtherwise":
        branches = [node.branches().apply(i) for i in range(node.branches().size())]
        whens = " ".join(f"WHEN {sql_of(b._1())} THEN {sql_of(b._2())}" for b in branches)
        other = node.otherwise()
        return f"CASE {whens}{f' ELSE {sql_of(other.get())}' if other.isDefined() else ''} END"
    if kind == "LambdaFunction":
        given = all_of(node.arguments())
        return f"{given[0] if len(given) == 1 else '(' + ', '.join(given) + ')'} -> {sql_of(node.function())}"
    if kind == "UnresolvedExtractValue":
        return f"{sql_of(node.child())}[{sql_of(node.extraction())}]"
    return node.sql()


@F.udtf(returnType=FINDING)
class TextFindings:
    """All findings of a text: ``SELECT * FROM docs, LATERAL text_findings(text)``."""

    def eval(self, text: str):
        if text is None:
            return
        for kind, rows in scan.findings(scan.checked(text, None)).items():
            for r in rows:
                label = r.get("name") or r.get("label") or r.get("kind")
                yield kind, r.get("offset"), r.get("length"), r["line"], r.get("column"), label, r.get("detail") or r.get("decoded") or r.get("id")


def register(spark: SparkSession) -> None:
    """Registers a function for each rule, named by its id with underscores; size_metrics, is_multiline, formula_lines,
    format_code_point, inspect_text, visible_text, describe_changes; and the table function text_findings."""
    from pyspark.sql.pandas.types import to_arrow_type

    def expression(name: str, function, given: str = "STRING", kind: str = "STRING") -> None:
        body = sql_of(function(F.col("given"))._jc.node())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(given {given}) RETURNS {kind} RETURN {body}")

    def one(name, function, kind):
        arrow = to_arrow_type(kind)

        def batch(column: pa.Array) -> pa.Array:
            return pa.array([None if v is None else function(v) for v in column.to_pylist()], arrow)

        spark.udf.register(name, F.arrow_udf(batch, kind))

    for rule, function in texts.COLUMN_RULES.items():
        expression(rule.replace("-", "_"), function)
    expression("size_metrics", texts.size_metrics, kind="STRUCT<characters: INT, bytes: INT, lines: INT>")
    expression("is_multiline", texts.is_multiline, kind="BOOLEAN")
    expression("formula_lines", texts.formula_lines, kind="ARRAY<STRUCT<line: INT, cell: INT, label: STRING>>")
    expression("format_code_point", texts.format_code_point, "INT")
    one("strip_html", html.strip_html, T.StringType())
    one("inspect_text", lambda t: scan.inspect(scan.checked(t, None)), rules.INSPECTION)
    one("visible_text", lambda t: preview.visible_text(scan.checked(t, None)), T.StringType())
    arrow = to_arrow_type(rules.CHANGES)

    def pairs(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([diff.describe_changes(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], arrow)

    spark.udf.register("describe_changes", F.arrow_udf(pairs, rules.CHANGES))
    spark.udtf.register("text_findings", TextFindings)
