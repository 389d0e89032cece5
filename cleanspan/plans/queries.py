"""Registered queries over whole tables, with the same questions in DuckDB SQL.

The tables hold hardly anything to find but HTML and tracking parameters, so the queries dirty the documents first,
by the same replacements on both sides (:mod:`cleanspan.plans.dirt`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanspan.functions import texts
from cleanspan.operators import reports, rules
from cleanspan.plans import dirt
from cleanspan.plans.dirt import COLOUR, CONTROLS, ESC, HIDDEN, JOINED, LINKS, MARKUP, MIXED, RUNS, SECRETS, TAGS, TERMINAL, TOKEN, UNTERMINATED, quoted
from cleanspan.sources.text import read_spread

Query = Callable[[SparkSession, str], DataFrame]
BEL = dirt.BEL


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str, cases=MIXED, before: str = "", after: str = "") -> DataFrame:
    """The documents with cases put in: doc_id, lang, source, t."""
    text = F.concat(F.lit(before), dirt.dirtied(F.col("text"), cases), F.lit(after))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.alias("t"))


def _dirty_sql(cases=MIXED, before: str = "", after: str = "", piece: str = "piece") -> str:
    text = f"{quoted(before)} || {dirt.dirtied_sql('text', cases, piece)} || {quoted(after)}"
    return f"(SELECT doc_id, lang, source, {text} AS t FROM documents)"


_count_sql = dirt.count_sql
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql:
            _oracles[function.__name__] = sql
        return function

    return add


# --- Links and markup on real pages ------------------------------------------------------------------


@query(
    """
    WITH cut AS (SELECT page_id, url, split_part(url, '#', 1) AS head FROM pages),
    parts AS (SELECT *, substr(url, length(head) + 1) AS tail, split_part(head, '?', 1) AS base FROM cut),
    pairs AS (SELECT *, string_split(substr(head, length(base) + 2), '&') AS p FROM parts),
    kept AS (SELECT *, list_filter(p, lambda x: NOT regexp_matches(x, '^(?i:utm_[a-z0-9_]+)(=|$)')) AS k FROM pairs)
    SELECT page_id,
      CASE WHEN NOT contains(head, '?') OR len(k) = len(p) THEN url
           ELSE base || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END || tail END AS clean_url,
      contains(head, '?') AND len(k) < len(p) AS changed
    FROM kept"""
)
def clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = texts.remove_tracking(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", "url", url.alias("clean_url")).select("page_id", "clean_url", (F.col("url") != F.col("clean_url")).alias("changed"))


#: What tidying does to a page that has any tag, in SQL; two passes, as blank lines share their line breaks.
def _tidied_sql(text: str) -> str:
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|\\r\\n|\\r|\\n)[ \\t]+(\\r\\n|\\r|\\n|$)', '\\1\\2', 'g')"
    text = f"regexp_replace({text}, '(\\r\\n|\\r|\\n)(\\r\\n|\\r|\\n){{2,}}', '\\1\\1', 'g')"
    return f"trim({text}, E' \\t\\r\\n')"


@query(f"SELECT doc_id, replace({_tidied_sql('t')}, chr(1), chr(10)) AS text FROM {_dirty_sql(MARKUP, piece='clean')}")
def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of markup in the documents, which are paragraphs here; code, unknown tags and comparisons stay."""
    rows = dirty(spark, sf_dir, MARKUP, "<head><title>T</title></head><P>", "</P>")
    return rows.select("doc_id", rules.strip_html(F.col("t")).alias("text"))


@query(f"SELECT doc_id, t AS text FROM {_dirty_sql(LINKS, piece='clean')}")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of link in the documents."""
    return dirty(spark, sf_dir, LINKS).select("doc_id", texts.remove_tracking(F.col("t")).alias("text"))


@query()
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", rules.strip_html(F.col("html")).alias("text"))


@query("SELECT doc_id, replace(replace(replace(text, 'th', '<'), 'en', '\u2014'), 'er', '&') AS text FROM documents")
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for old, new in (("th", "&lt;"), ("en", "&#8212;"), ("er", "&amp;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return read(spark, sf_dir, "documents").select("doc_id", rules.strip_html(text).alias("text"))


# --- One rule at a time ------------------------------------------------------------------------------

SQL_RULES = {
    "remove-tracking": "regexp_replace({t}, '\\?utm_source=a&id=7', '?id=7', 'g')",
    "remove-zero-width": "regexp_replace({t}, '[\u200b\u00ad\u2060]', '', 'g')",
    "remove-directional": "replace({t}, '\u202e', '')",
    "remove-invisible-payloads": "regexp_replace({t}, '[\U000e0000-\U000e007f]+', '', 'g')",
    "strip-terminal-controls": f"regexp_replace({{t}}, '{ESC}\\[[0-9;]*m|{ESC}\\][^{BEL}]*{BEL}', '', 'g')",
    "normalise-line-endings": "regexp_replace({t}, '\r\n?|[\u2028\u2029]', '\n', 'g')",
    "replace-non-breaking-spaces": "regexp_replace({t}, '[\u00a0\u2009]', ' ', 'g')",
    "normalise-smart-quotes": "replace(replace({t}, '\u201c', '\"'), '\u201d', '\"')",
    "trim-trailing-space": "regexp_replace({t}, '[ \t]+([\n\r\u2028\u2029]|\\z)', '\\1', 'g')",
}


def _rules_sql(*ids: str) -> str:
    text = "t"
    for rule in ids:
        text = SQL_RULES[rule].replace("{t}", text)
    return f"SELECT doc_id, {text} AS text FROM {_dirty_sql()}"


def _rule_query(name: str, *ids: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dirty(spark, sf_dir).select("doc_id", rules.cleaned(F.col("t"), {"name": name, "rules": ids}).alias("text"))

    run.__name__ = name
    query(_rules_sql(*ids))(run)


for _id in SQL_RULES:
    _rule_query("rule_" + _id.replace("-", "_"), _id)
for _recipe in rules.RECIPES:
    if "strip-html" not in _recipe.rules:
        _rule_query("recipe_" + _recipe.id.replace("-", "_"), *_recipe.rules)


#: Markup and everything else at once.
_PAGE = tuple(c for c in MARKUP if c.word != " y ") + MIXED


def _page_sql(*ids: str) -> str:
    cases = [dirt.Case(c.word, c.piece, c.clean or c.piece) for c in _PAGE]
    text = _tidied_sql(dirt.dirtied_sql("text", cases, "clean"))
    for rule in ids:
        text = SQL_RULES[rule].replace("{t}", text)
    return f"SELECT doc_id, {text} AS text FROM documents"


def _page_recipe(recipe: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.clean(dirty(spark, sf_dir, _PAGE, "<p>", "</p>"), "t", recipe, "text").select("doc_id", "text")

    run.__name__ = "recipe_" + recipe.replace("-", "_")
    query(_page_sql(*rules.recipe_of(recipe).rules[1:]))(run)


_page_recipe("clean-markdown")
_page_recipe("plain-text")


@query()
def pages_clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean(read(spark, sf_dir, "pages").select("page_id", "html"), "html", "clean-markdown")


@query(
    "SELECT count(*) FILTER (t <> a) AS n_changed, sum(length(a) - length(t) - length(regexp_replace(t, '[^\U000e0000-\U000e007f]', '', 'g')))::BIGINT AS delta "
    f"FROM (SELECT t, {SQL_RULES['remove-invisible-payloads'].replace('{t}', 't')} AS a FROM {_dirty_sql()})"
)
def edit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rules.edits(dirty(spark, sf_dir), "t", {"name": "Payloads", "rules": ["remove-invisible-payloads"]})
    e = F.get("edits", F.lit(0))
    return done.agg(F.sum(e["changed"].cast("long")).alias("n_changed"), F.sum(e["characterDelta"].cast("long")).alias("delta"))


# --- Measures and findings ---------------------------------------------------------------------------


@query(
    "SELECT doc_id, (length(t) + length(regexp_replace(t, '[^\U00010000-\U0010ffff]', '', 'g')))::BIGINT AS characters, strlen(t)::BIGINT AS bytes, "
    f"(CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\r\n?|\n')) END)::BIGINT AS lines FROM {_dirty_sql()}"
)
def size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir).select("doc_id", texts.size_metrics(F.col("t")).alias("s"))
    return rows.select("doc_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("characters", "bytes", "lines")])


@query(
    "SELECT doc_id, len(list_filter(regexp_split_to_array(t, '\r\n?|\n'), lambda x: regexp_matches(x, '[^\\s\u00a0\u2009\u2028]'))) > 1 AS multiline "
    f"FROM {_dirty_sql()}"
)
def multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select("doc_id", texts.is_multiline(F.col("t")).alias("multiline"))


@query(
    "SELECT doc_id, x.i::BIGINT AS line, (CASE WHEN regexp_matches(x.s, '^\\s*(=SUM|-2\\+3)') THEN 1 ELSE 2 END)::BIGINT AS cell FROM "
    "(SELECT doc_id, unnest(list_transform(regexp_split_to_array(t, '\r\n?|\n'), lambda s, i: {'s': s, 'i': i})) AS x "
    f"FROM {_dirty_sql()}) WHERE regexp_matches(x.s, '(^|\t)\\s*(=SUM|-2\\+3)')"
)
def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir).select("doc_id", F.explode(texts.formula_lines(F.col("t"))).alias("f"))
    return rows.select("doc_id", F.col("f.line").cast("long").alias("line"), F.col("f.cell").cast("long").alias("cell"))


def found(spark: SparkSession, sf_dir: str, kind: str, cases=MIXED, **around) -> DataFrame:
    return reports.findings(dirty(spark, sf_dir, cases, **around), "doc_id", "t", (kind,))


PLACE = ("label", "detail", "offset", "length", "line", "column")


def places(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "label", "detail", *[F.col(c).cast("long").alias(c) for c in PLACE[2:]])


_HIDDEN_PIECES = [(c, ((0, name, 1, f"U+{ord(c):04X}"),)) for name, c in HIDDEN.items()]
_HIDDEN_PIECES += [(TAGS, ((0, "tag character", 2, "U+E0068"), (2, "tag character", 2, "U+E0069")))]


@query(
    "SELECT doc_id, label, n FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS label, {_count_sql(c)} AS n FROM {_dirty_sql()}" for name, c in HIDDEN.items())
    + f" UNION ALL SELECT doc_id, 'tag character' AS label, 2 * {_count_sql(TAGS)} AS n FROM {_dirty_sql()}) WHERE n > 0"
)
def hidden_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden characters of each document by name: counted inside the row, so nothing is shuffled."""
    names = F.transform(rules.found(F.col("t"), ("hidden",))["hidden"], lambda h: h["name"])
    rows = dirty(spark, sf_dir).select("doc_id", F.explode(F.array(names)).alias("names"))
    rows = rows.select("doc_id", "names", F.explode(F.array_distinct("names")).alias("label"))
    return rows.select("doc_id", "label", F.size(F.filter("names", lambda x: x == F.col("label"))).cast("long").alias("n"))


@query(f"SELECT doc_id, label, detail, \"offset\", line, \"column\" FROM ({dirt.places_sql(_dirty_sql(), _HIDDEN_PIECES)})")
def hidden_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(found(spark, sf_dir, "hidden")).drop("length")


@query(dirt.places_sql(_dirty_sql(), [(TAGS, ((0, "tag characters", 4, "hi"),))]))
def hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(found(spark, sf_dir, "hiddenText"))


@query(
    f"SELECT doc_id, label, \"offset\", line, \"column\" FROM ({dirt.places_sql(_dirty_sql(JOINED), [(c.piece, c.events) for c in JOINED if c.events])})"
)
def joiners_and_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joiners, selectors and tags where they hide something; those in emoji, scripts and flags are none."""
    return places(found(spark, sf_dir, "hidden", JOINED)).drop("length", "detail")


@query(dirt.places_sql(_dirty_sql(JOINED), [(c.piece, ((at, label, n, spelt),)) for c in JOINED if c.word in RUNS for at, label, n, spelt in [RUNS[c.word]]]))
def spelled_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs of selectors and of tags spell."""
    return places(found(spark, sf_dir, "hiddenText", JOINED))


@query(f"SELECT doc_id, t AS text FROM {_dirty_sql(JOINED, piece='clean')}")
def joiners_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = {"name": "Invisible", "rules": ["remove-zero-width", "remove-invisible-payloads"]}
    return dirty(spark, sf_dir, JOINED).select("doc_id", rules.cleaned(F.col("t"), recipe).alias("text"))


@query(
    f"SELECT label, sum(n)::BIGINT AS n FROM (SELECT 'terminal hyperlink' AS label, {_count_sql(CONTROLS[2][0])} AS n FROM {_dirty_sql()} "
    f"UNION ALL SELECT 'terminal hyperlink end', {_count_sql(CONTROLS[3][0])} FROM {_dirty_sql()} "
    f"UNION ALL SELECT '{COLOUR}', {_count_sql(ESC + '[')} FROM {_dirty_sql()}) GROUP BY label"
)
def terminal_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terminal controls of all documents by label."""
    return found(spark, sf_dir, "terminalControls").groupBy("label").agg(F.count("*").alias("n"))


_AROUND = {"before": "\n", "after": UNTERMINATED.piece}


@query(dirt.places_sql(_dirty_sql(TERMINAL, **_AROUND), [(c.piece, c.events) for c in (*TERMINAL, UNTERMINATED)]))
def terminal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of terminal control, with what it carries and where it stands."""
    return places(found(spark, sf_dir, "terminalControls", TERMINAL, **_AROUND))


@query(f"SELECT doc_id, t AS text FROM {_dirty_sql(TERMINAL, chr(10), UNTERMINATED.clean, 'clean')}")
def terminal_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir, TERMINAL, **_AROUND).select("doc_id", texts.strip_terminal_controls(F.col("t")).alias("text"))


_SECRET_CASES = tuple(dirt.Case(word, f" {piece} ") for word, (_, piece) in SECRETS.items())
_SECRET_PIECES = [(f" {piece} ", ((1, key, len(piece), None),)) for key, piece in SECRETS.values() if key]


@query(f"SELECT doc_id, label, \"offset\", length, line, \"column\" FROM ({dirt.places_sql(_dirty_sql(_SECRET_CASES), _SECRET_PIECES)})")
def secret_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials of every shape by their ids, and where they stand."""
    return places(found(spark, sf_dir, "secretWarnings", _SECRET_CASES)).drop("label").withColumnRenamed("detail", "label")


@query(f"SELECT doc_id, 'github-token' AS id, {_count_sql(TOKEN)} AS n FROM {_dirty_sql()} WHERE contains(t, '{TOKEN}')")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials of each document by id, counted inside the row."""
    rows = dirty(spark, sf_dir).select("doc_id", F.explode(F.array(rules.found(F.col("t"), ("secretWarnings",))["secretWarnings"])).alias("s"))
    ids = rows.select("doc_id", F.transform("s", lambda s: s["id"]).alias("ids"))
    ids = ids.select("doc_id", "ids", F.explode(F.array_distinct("ids")).alias("id"))
    return ids.select("doc_id", "id", F.size(F.filter("ids", lambda x: x == F.col("id"))).cast("long").alias("n"))


# --- Previews and changes ------------------------------------------------------------------------------

PREVIEW = 60_000


def _label(text: str) -> str:
    return f"\u27e6{text}\u27e7"


def _visible_sql() -> str:
    text = "t"
    shown = {"\t": "tab U+0009", "\r": "carriage return U+000D", TAGS: "2 tag characters hiding \u201chi\u201d"}
    shown |= {c: f"{name} U+{ord(c):04X}" for name, c in HIDDEN.items()}
    for piece, label, detail in CONTROLS:
        pictures = piece.replace(ESC, "\u241b").replace(BEL, "\u2407")
        shown[piece] = f"{label}: \u201c{detail}\u201d" if detail else f"{label} {pictures}"
    for piece, label in shown.items():
        text = f"replace({text}, {quoted(piece)}, {quoted(_label(label))})"
    cut = f"left(v, {PREVIEW}) || {quoted(chr(10) + _label('preview truncated at 60,000 characters'))}"
    return f"SELECT doc_id, CASE WHEN length(v) > {PREVIEW} THEN {cut} ELSE v END AS preview FROM (SELECT doc_id, {text} AS v FROM {_dirty_sql()})"


@query(_visible_sql())
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select("doc_id", rules.visible(F.col("t")).alias("preview"))


def numbered(text: Column) -> Column:
    """The sentences of a text as lines that are all different."""
    return F.transform(F.split(text, r"\. ", -1), lambda s, i: F.concat(i.cast("string"), F.lit("|"), F.replace(s, F.lit("\n"), F.lit(" "))))


_SENTENCES = "list_transform(regexp_split_to_array(text, '\\. '), lambda s, i: (i - 1)::VARCHAR || '|' || replace(s, chr(10), ' '))"


@query(
    f"""
    WITH l AS (SELECT doc_id, {_SENTENCES} AS p FROM documents),
    e AS (SELECT doc_id, unnest(p) AS b, generate_subscripts(p, 1) AS i FROM l),
    c AS (SELECT *, replace(b, ' the ', ' THE ') AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e WHERE contains(b, ' the ')),
    f AS (SELECT doc_id, i, b, a, n, count(*) OVER (PARTITION BY doc_id) AS every FROM c)
    SELECT doc_id, i::BIGINT AS line, 1::BIGINT AS lines, 1::BIGINT AS added,
           CASE WHEN length(b) > 2000 THEN left(b, 2000) || '\u2026' ELSE b END AS before,
           CASE WHEN length(a) > 2000 THEN left(a, 2000) || '\u2026' ELSE a END AS after, greatest(every - 50, 0)::BIGINT AS omitted
    FROM f WHERE n <= 50"""
)
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of changed lines, line by line."""
    lines = numbered(F.col("text"))
    changed = F.array_join(F.transform(lines, lambda s: F.replace(s, F.lit(" the "), F.lit(" THE "))), "\n")
    return _hunks(read(spark, sf_dir, "documents").select("doc_id", rules.changes(F.array_join(lines, "\n"), changed).alias("c")))


@query(
    f"""
    WITH l AS (SELECT doc_id, {_SENTENCES} AS p FROM documents),
    e AS (SELECT doc_id, unnest(p) AS b, generate_subscripts(p, 1) AS i, len(p) AS size FROM l),
    r AS (SELECT * FROM e WHERE i % 40 IN (7, 8, 9) OR i % 40 = 20),
    g AS (SELECT doc_id, i // 40 AS block, i % 40 = 20 AS grows, min(i) AS line, count(*) AS n, string_agg(b, chr(10) ORDER BY i) AS before FROM r GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k, count(*) OVER (PARTITION BY doc_id) AS every FROM g)
    SELECT doc_id, (line + grows::INT)::BIGINT AS line, CASE WHEN grows THEN 0 ELSE n END::BIGINT AS lines, CASE WHEN grows THEN 2 ELSE 0 END::BIGINT AS added,
           CASE WHEN grows THEN '' WHEN length(before) > 2000 THEN left(before, 2000) || '\u2026' ELSE before END AS before,
           CASE WHEN grows THEN 'new ' || line || chr(10) || 'more' ELSE '' END AS after, greatest(every - 50, 0)::BIGINT AS omitted
    FROM o WHERE k <= 50"""
)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of lines that go and of lines that come."""
    lines = F.col("lines")
    old = read(spark, sf_dir, "documents").select("doc_id", numbered(F.col("text")).alias("lines"))

    def edited(s: Column, i: Column) -> Column:
        at = (i + 1) % 40
        grown = F.array(s, F.concat(F.lit("new "), (i + 1).cast("string")), F.lit("more"))
        return F.when(at.isin(7, 8, 9), F.array().cast("array<string>")).when(at == 20, grown).otherwise(F.array(s))

    new = F.array_join(F.flatten(F.transform(lines, edited)), "\n")
    return _hunks(old.select("doc_id", rules.changes(F.array_join(lines, "\n"), new).alias("c")))


def _hunks(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", F.explode("c.hunks").alias("h"), F.col("c.omitted").cast("long").alias("omitted"))
    counts = [F.col(f"h.{c}").cast("long").alias(name) for c, name in (("line", "line"), ("lines", "lines"), ("addedLines", "added"))]
    return rows.select("doc_id", *counts, "h.before", "h.after", "omitted")


# --- Reports -----------------------------------------------------------------------------------------


@query(
    f"WITH f AS (SELECT lang, source, {_count_sql(TOKEN)} AS n FROM {_dirty_sql()} WHERE contains(t, '{TOKEN}')) "
    "SELECT lang, source, sum(n)::BIGINT AS n FROM f GROUP BY ROLLUP (lang, source)"
)
def findings_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.findings(dirty(spark, sf_dir), ["lang", "source"], "t", ("secretWarnings",))
    return rows.rollup("lang", "source").agg(F.count("*").alias("n"))


@query(
    f"SELECT toxic::BIGINT AS toxic, count(*)::BIGINT AS documents, sum({_count_sql(TOKEN)})::BIGINT AS secrets "
    f"FROM {_dirty_sql()} d JOIN labels USING (doc_id) GROUP BY toxic"
)
def findings_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = dirty(spark, sf_dir).select("doc_id", rules.found(F.col("t"), ("secretWarnings",))["secretWarnings"].alias("s"))
    counted = counted.select("doc_id", F.greatest(F.coalesce(F.size("s"), F.lit(0)), F.lit(0)).alias("n"))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(counted, "doc_id")
    return rows.groupBy(F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("secrets"))


@query(f"SELECT doc_id FROM {_dirty_sql()} WHERE NOT regexp_matches(t, '[\u00a0\u200b\u202e\u2009\u00ad\u2060\u2028{ESC}{BEL}\U000e0000-\U000e007f]|ghp_|=SUM')")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.without_findings(dirty(spark, sf_dir), "t").select("doc_id")


_RUN_PIECES = [(c, ((0, name, 1, f"U+{ord(c):04X}"),)) for name, c in HIDDEN.items()] + [(TAGS, ((0, "tag character", 2, "U+E0068"),))]


@query(
    "SELECT doc_id, label, \"offset\", length AS count, detail AS first, CASE WHEN label = 'tag character' THEN 'U+E0069' ELSE detail END AS last "
    f"FROM ({dirt.places_sql(_dirty_sql(), _RUN_PIECES)})"
)
def grouped_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hidden characters of one name, side by side."""
    rows = reports.grouped(found(spark, sf_dir, "hidden"), "doc_id")
    return rows.withColumns({"offset": F.col("offset").cast("long"), "count": F.col("count").cast("long")})


_N_HIDDEN = " + ".join([*(_count_sql(c) for c in HIDDEN.values()), f"2 * {_count_sql(TAGS)}"])
_N_CONTROLS = f"{_count_sql(ESC + '[')} + {_count_sql(ESC + ']8')}"


@query(
    f"SELECT doc_id, hidden, terminal, secrets, greatest(hidden - 1000, 0) + greatest(terminal - 1000, 0) + greatest(secrets - 1000, 0) "
    f"+ greatest(formulas - 1000, 0) + greatest(runs - 1000, 0) AS omitted FROM (SELECT doc_id, {_N_HIDDEN} AS hidden, {_N_CONTROLS} AS terminal, "
    f"{_count_sql(TOKEN)} AS secrets, {_count_sql('=SUM')} + {_count_sql('-2+3')} AS formulas, {_count_sql(TAGS)} AS runs FROM {_dirty_sql()})"
)
def remaining_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record says of each document: findings by kind, listed and left out, and how many are left out in all."""
    rows = dirty(spark, sf_dir).select("doc_id", rules.inspection(F.col("t")).alias("i"))
    rows = rows.select("doc_id", reports.remaining(F.col("i")).alias("m"), reports.omitted_total(F.col("i")).cast("long").alias("omitted"))
    kinds = {"hidden": "hidden", "terminalControls": "terminal", "secretWarnings": "secrets"}
    return rows.select("doc_id", *[F.element_at("m", F.lit(k)).cast("long").alias(v) for k, v in kinds.items()], "omitted")


@query("SELECT unnest([" + ", ".join(f"'{r.id}'" for r in rules.RULES) + "]) AS id, unnest([" + ", ".join(quoted(r.label) for r in rules.RULES) + "]) AS label")
def rules_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_catalogue(spark)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
