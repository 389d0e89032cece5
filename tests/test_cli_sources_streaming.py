"""Command line, sources and sinks, reports, SQL functions, and streams against batches."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cleanspan import cli
from cleanspan.functions.catalogue import RECIPES
from cleanspan.operators import reports, rules
from cleanspan.plans.register import register
from cleanspan.sources import recipes, text
from cleanspan.streaming import clean


def run(args, given=b""):
    return subprocess.run([sys.executable, "-m", "cleanspan.cli", *args], input=given, capture_output=True, timeout=120)


@pytest.mark.parametrize(
    "args, message",
    [
        (["--recipe"], "--recipe needs a value"),
        (["--recipe="], "--recipe needs a value"),
        (["--recipe", "nope"], "Unknown recipe \u201cnope\u201d"),
        (["--rules", "execute-command"], "Unknown transformation rule: execute-command. Run with --list"),
        (["--recipe", "plain-text", "--rules", "strip-html"], "either --recipe or --rules"),
        (["--inspect", "--recipe", "plain-text"], "cannot be combined"),
        (["--inspect=yes"], "does not take a value"),
        (["--frobnicate"], "Unknown option \u201c--frobnicate\u201d"),
    ],
)
def test_usage_errors(args, message, capsys):
    assert cli.main(args) == 2
    assert message in capsys.readouterr().err


def test_listing(capsys):
    assert cli.main(["--list"]) == 0
    out = capsys.readouterr().out
    assert all(r.id in out for r in RECIPES) and "remove-tracking" in out
    assert run(["--help"]).stdout.startswith(b"usage")


def test_inspection_report():
    for padding in (65533, 65536):
        done = run(["--inspect"], ("a" * padding + "\u200btail").encode())
        record = json.loads(done.stdout)
        assert len(record["hidden"]) == 1 and record["characters"] == padding + 5
    done = run(["--inspect"], b"a" * 500_001)
    assert done.returncode == 2 and b"exceeds the 500,000 character limit" in done.stderr


def test_local_rules():
    done = run(["--rules", "strip-html"], "<p>a</p>\u00e9 ghp_1234567890abcdefghijklmnop".encode())
    assert done.returncode == 0 and done.stdout.decode().startswith("a\n\u00e9")
    assert b"Applied 1 named rule; 1 changed" in done.stderr and b"still contains 1 likely secret" in done.stderr


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("\ufeffone\r\ntwo\rthree".encode())
    (tmp_path / "in/b.txt").write_bytes(b"bad \xff byte")
    got = {r.path.rsplit("/", 1)[1]: r for r in text.read_files(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"].text == "\ufeffone\r\ntwo\rthree" and got["a.txt"].valid_utf8
    assert got["b.txt"].text == "bad \ufffd byte" and not got["b.txt"].valid_utf8
    assert "one\r\ntwo\rthree" in {r.text.lstrip("\ufeff") for r in text.read_texts(spark, str(tmp_path / "in/a.txt")).collect()}
    (tmp_path / "in/c.txt").write_bytes(b"x" * 50)
    assert {r.too_large for r in text.read_files(spark, str(tmp_path / "in/c.txt"), limit=10).collect()} == {True}
    text.write_reports(reports.inspected(text.sample(spark), "text"), "inspection", str(tmp_path / "out"))
    record = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    for kind in reports.KINDS:
        assert record[kind], kind


def test_recipe_store(spark, tmp_path):
    good, bad = recipes.parsed([{"id": "x", "name": "A", "rules": ["strip-html"]}, {"id": "x", "name": "B", "rules": ["strip-html"]}, {"name": ""}, 5])
    assert [r.name for r in good] == ["A", "B"] and good[1].id.startswith("local-") and bad == [{"name": ""}, 5]
    recipes.save(spark, good, bad, str(tmp_path / "store"))
    assert recipes.load(spark, str(tmp_path / "store")) == (good, bad)
    assert len(recipes.parsed({"name": f"n{i}", "rules": ["strip-html"]} for i in range(25))[0]) == 20
    df = spark.createDataFrame([("a", ["strip-html"]), ("b", ["nope"]), ("c", None)], "name string, rules array<string>")
    assert {r.name for r in recipes.quarantined(df, list(rules.LABELS)).collect()} == {"b", "c"}


def test_reports(spark):
    df = spark.createDataFrame([(1, "a\u200b\u200bb\u200b \U000e0041\U000e0042"), (2, "plain")], "id int, t string")
    found = reports.findings(df, "id", "t")
    assert {(r.kind, r["n"]) for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("hidden", 5), ("hiddenText", 1)}
    groups = sorted((r.offset, r.label, r["count"], r["first"], r["last"]) for r in reports.grouped(found, "id").collect())
    assert groups == [(0 + 1, "zero-width space", 2, "U+200B", "U+200B"), (4, "zero-width space", 1, "U+200B", "U+200B"), (6, "tag character", 2, "U+E0041", "U+E0042")]
    record = reports.inspected(df, "t").where("id = 1").select(reports.remaining(F.col("inspection")).alias("m"), reports.omitted_total(F.col("inspection")).alias("o")).first()
    assert record.m["hidden"] == 5 and "hiddenText" not in record.m and record.o == 0
    assert rules.rule_catalogue(spark).count() == 10 and rules.recipe_catalogue(spark).count() == 6


def test_sql_functions(spark):
    register(spark)
    df = spark.createDataFrame([("k\u00a0\u200b \x1b[1m\u201cq\u201d \r\n\u202e https://k.test/?gclid=1 \ufe0f",)], "t string")
    df.createOrReplaceTempView("given_texts")
    for rule, column in rules.RULE_COLUMNS.items():
        got = spark.sql(f"SELECT {rule.replace('-', '_')}(t) a FROM given_texts").first().a
        assert got == df.select(column(F.col("t")).alias("a")).first().a, rule
    found = spark.sql("SELECT kind, label, line, col FROM given_texts, LATERAL text_findings(t)").collect()
    assert len(found) == reports.findings(df, "t", "t").count() and ("hidden", "zero-width space", 1, 3) in set(map(tuple, found))
    assert spark.sql("SELECT size_metrics('ab').bytes a, is_multiline('a\nb') b, formula_lines('=1')[0].cell c, format_code_point(8203) d").first() == (2, True, 1, "U+200B")
    row = spark.sql("SELECT strip_html('<b>x</b>&amp;') a, inspect_text('=1+1').formulaLines[0].cell b, size(describe_changes('a', 'b').hunks) c, visible_text('\\t') d").first()
    assert (row.a, row.b, row.c, row.d) == ("x&", 1, 1, "\u27e6tab U+0009\u27e7")


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = clean.text_stream(spark, str(tmp_path / "in"), pages.schema, files_per_batch=1)
    clean.clean_stream(stream, "html", "clean-markdown", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = rules.clean(pages, "html", "clean-markdown")
    assert sorted(map(tuple, got.select("page_id", "html").collect())) == sorted(map(tuple, want.collect()))


def test_findings_per_window(spark, tmp_path):
    """Counts in event-time windows, as a batch over the same rows has them."""
    import datetime

    start = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, start + datetime.timedelta(minutes=20 * i), "a\u200b\u200b" if i % 2 else f"=1\n{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, at timestamp, t string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = clean.text_stream(spark, str(tmp_path / "in"), df.schema)
    query = clean.findings_per_window(stream, "id", "t", "at").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    found = reports.findings(df.select(F.struct("id", "at").alias("k"), "t"), "k", "t")
    want = found.groupBy(F.window("k.at", "1 hour"), "kind").count()
    got = spark.table("windows")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 8
