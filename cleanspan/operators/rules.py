"""Rules and recipes on columns, and everything that explains what they did.

Nine of the ten rules are JVM expressions; removing markup runs over Arrow batches. All are ``Column -> Column``, so a
recipe is one projection, in batch and in streaming alike. The limit on the length of a text holds for single texts (the
command line); tables take texts of any length unless they are given one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanspan.functions import texts
from cleanspan.functions.catalogue import MAX_RECIPE_ID, MAX_RECIPE_NAME, RECIPES, RULES, Recipe
from cleanspan.functions.classes import SPACE_CHARACTERS

from . import diff, html, preview, scan


def _over_batches(function, kind: T.DataType):
    """A function of one text as a Column function over Arrow batches; null stays null."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def batch(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in column.to_pylist()], arrow)

    return F.arrow_udf(batch, kind)


def _over_pairs(function, kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], arrow)

    return F.arrow_udf(batch, kind)


def strip_html(text: Column) -> Column:
    return _over_batches(html.strip_html, T.StringType())(text)


RULE_COLUMNS = {"strip-html": strip_html, **texts.COLUMN_RULES}
LABELS = {r.id: r.label for r in RULES}


# --- Recipes ---------------------------------------------------------------------------------------


def validate_recipe(value: object) -> Recipe:
    """A recipe from an untrusted mapping: trimmed name and id, known rules, each once and in order."""
    if isinstance(value, Recipe):
        value = {"id": value.id, "name": value.name, "rules": list(value.rules)}
    if not isinstance(value, Mapping):
        raise TypeError("A recipe must be an object.")

    def text(key: str, limit: int) -> str:
        given = value.get(key)
        return given.strip(SPACE_CHARACTERS)[:limit] if isinstance(given, str) else ""

    name, rules = text("name", MAX_RECIPE_NAME), value.get("rules")
    if not name:
        raise ValueError("A recipe needs a name.")
    if not isinstance(rules, list | tuple) or not rules:
        raise ValueError("Select at least one recipe rule.")
    for rule in rules:
        if not isinstance(rule, str):
            raise TypeError("Recipe rules must be identified by text.")
        if rule not in LABELS:
            raise ValueError(f"Unknown transformation rule: {rule}")
    return Recipe(text("id", MAX_RECIPE_ID) or f"custom-{uuid.uuid4()}", name, tuple(dict.fromkeys(rules)))


def recipe_of(choice: str | Recipe | Mapping) -> Recipe:
    """A built-in recipe by its id, or any recipe given whole."""
    if isinstance(choice, str):
        for recipe in RECIPES:
            if recipe.id == choice:
                return recipe
        raise ValueError(f"Unknown recipe: {choice}")
    return validate_recipe(choice)


def rule_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.id, r.label) for r in RULES], "id string, label string")


def recipe_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.id, r.name, list(r.rules)) for r in RECIPES], "id string, name string, rules array<string>")


# --- Applying --------------------------------------------------------------------------------------


def cleaned(text: Column, recipe: str | Recipe | Mapping) -> Column:
    """A recipe as one Column; NUL is made visible first."""
    text = texts.show_nul(text)
    for rule in recipe_of(recipe).rules:
        text = RULE_COLUMNS[rule](text)
    return text


def clean(df: DataFrame, column: str, recipe: str | Recipe | Mapping, output: str | None = None, limit: int | None = None) -> DataFrame:
    """Adds (or replaces) ``output``, by default the column itself, by the cleaned text. With a limit, a longer text fails."""
    return df.withColumn(output or column, cleaned(texts.validate(F.col(column), limit), recipe))


def edits(df: DataFrame, column: str, recipe: str | Recipe | Mapping, limit: int | None = None) -> DataFrame:
    """Adds ``output`` and ``edits``, a struct for each rule: what it changed, and by how many UTF-16 units."""
    chosen = recipe_of(recipe)
    steps = [f"__step{i}" for i in range(len(chosen.rules) + 1)]
    df = df.withColumn(steps[0], texts.validate(F.col(column), limit))
    for before, after, rule in zip(steps, steps[1:], chosen.rules, strict=False):
        df = df.withColumn(after, RULE_COLUMNS[rule](F.col(before)))
    made = [
        F.struct(
            F.lit(rule).alias("ruleId"),
            F.lit(LABELS[rule]).alias("label"),
            (F.col(a) != F.col(b)).alias("changed"),
            F.col(a).alias("before"),
            F.col(b).alias("after"),
            (texts.utf16_length(F.col(b)) - texts.utf16_length(F.col(a))).alias("characterDelta"),
        )
        for a, b, rule in zip(steps, steps[1:], chosen.rules, strict=False)
    ]
    return df.withColumns({"output": F.col(steps[-1]), "edits": F.array(*made)}).drop(*steps)


def _struct(fields: str) -> T.StructType:
    """A struct of ``name:kind`` fields; kinds are s(tring), i(nt) and b(oolean)."""
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType()}
    made = T.StructType()
    for field in fields.split():
        name, kind = field.split(":")
        made = made.add(name, kinds[kind])
    return made


KINDS = {
    "hidden": "offset:i codePoint:s name:s line:i column:i",
    "hiddenText": "offset:i length:i characters:i kind:s decoded:s line:i column:i",
    "secretWarnings": "offset:i id:s label:s length:i disclosure:s line:i column:i",
    "terminalControls": "offset:i length:i codePoint:s label:s detail:s line:i column:i",
    "formulaLines": "line:i cell:i label:s",
}
INSPECTION = _struct("characters:i bytes:i lines:i")
for _name, _fields in KINDS.items():
    INSPECTION = INSPECTION.add(_name, T.ArrayType(_struct(_fields)))
INSPECTION = INSPECTION.add("omittedFindings", _struct(" ".join(f"{scan.OMITTED_AS.get(k, k)}:i" for k in KINDS)))
INSPECTION = INSPECTION.add("multilineCommand", T.BooleanType()).add("limitation", T.StringType())
CHANGES = T.StructType().add("hunks", T.ArrayType(_struct("line:i lines:i addedLines:i before:s after:s"))).add("omitted", T.IntegerType())


def inspection(text: Column, limit: int | None = None) -> Column:
    """The inspection record of a text as a struct. It lists the first thousand findings of a kind and counts the others."""
    return _over_batches(lambda t: scan.inspect(scan.checked(t, limit)), INSPECTION)(text)


def suspect(text: Column, kinds: tuple[str, ...]) -> Column:
    """Whether a text has anything that a finding of one of the kinds could begin with or must hold."""
    some = F.lit(False)
    if {"hidden", "hiddenText"} & set(kinds):
        some = some | text.rlike(r"[^\x00-\x7f]")
    if "terminalControls" in kinds:
        some = some | text.rlike(texts.CONTROL + r"|\r(?!\n)")
    if "secretWarnings" in kinds:
        low = F.lower(text)
        for shape in scan.shapes():
            some = some | F.contains(low if shape.any_case else text, F.lit(shape.hint))
    return some


def found(text: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """All findings of some kinds as a struct of arrays, each of null if there is none. Formula-like lines are found in the
    JVM; for the other kinds only texts that are suspect go to the scanners."""
    scanned = tuple(k for k in kinds if k != "formulaLines")
    schema = T.StructType([T.StructField(k, T.ArrayType(_struct(KINDS[k]))) for k in scanned])

    def look(t: str) -> dict:
        return scan.findings(scan.checked(t, None), scanned)

    formulas = texts.formula_lines(text)
    if not scanned:
        return F.struct(formulas.alias("formulaLines"))
    record = _over_batches(look, schema)(texts.let(text, lambda t: F.when(suspect(t, scanned), t)))
    return F.struct(*[(formulas if k == "formulaLines" else record[k]).alias(k) for k in kinds])


def changes(before: Column, after: Column) -> Column:
    return _over_pairs(diff.describe_changes, CHANGES)(before, after)


def visible(text: Column, limit: int | None = None) -> Column:
    return _over_batches(lambda t: preview.visible_text(scan.checked(t, limit)), T.StringType())(text)


def apply_recipe(df: DataFrame, column: str, recipe: str | Recipe | Mapping, limit: int | None = None) -> DataFrame:
    """The edits of :func:`edits`, with ``inspection`` of the text and ``outputInspection`` of the result."""
    # The generator keeps the optimizer from merging the rules into the argument of the last inspection.
    done = edits(df, column, recipe, limit).withColumn("output", F.explode(F.array("output")))
    return done.withColumns({"inspection": inspection(F.col(column)), "outputInspection": inspection(F.col("output"))})


def split_by_length(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the rules accept, and rows whose text is too long for them."""
    too_long = F.coalesce(texts.is_too_long(F.col(column)), F.lit(False))
    return df.where(~too_long), df.where(too_long)
