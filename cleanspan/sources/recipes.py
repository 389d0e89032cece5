"""A store of saved recipes: the last few, unreadable ones kept apart."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanspan.functions.catalogue import MAX_SAVED_RECIPES, RECIPES, Recipe
from cleanspan.operators.rules import validate_recipe

SCHEMA = "position int, id string, name string, rules array<string>, unread string"


def parsed(entries: Iterable[object]) -> tuple[list[Recipe], list[object]]:
    """Recipes of a stored list, and entries that are none. Ids that are taken get new ones."""
    good: list[Recipe] = []
    bad: list[object] = []
    taken = {r.id for r in RECIPES}
    for entry in entries:
        try:
            recipe = validate_recipe(entry)
        except (TypeError, ValueError):
            bad.append(entry)
            continue
        if recipe.id in taken:
            recipe = Recipe(f"local-{uuid.uuid4()}", recipe.name, recipe.rules)
        taken.add(recipe.id)
        good.append(recipe)
    return good[-MAX_SAVED_RECIPES:], bad


def save(spark: SparkSession, recipes: list[Recipe], unread: list[object], path: str) -> None:
    """Replaces the store; entries that could not be read are written back as they were."""
    rows = [(i, r.id, r.name, list(r.rules), None) for i, r in enumerate(recipes[-MAX_SAVED_RECIPES:])]
    rows += [(-1, None, None, None, json.dumps(x)) for x in unread]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> tuple[list[Recipe], list[object]]:
    rows = spark.read.schema(SCHEMA).json(path).orderBy("position").collect()  # a handful
    good, bad = parsed({"id": r.id, "name": r.name, "rules": r.rules} for r in rows if r.unread is None)
    return good, bad + [json.loads(r.unread) for r in rows if r.unread is not None]


def quarantined(df: DataFrame, known: list[str]) -> DataFrame:
    """Rows of a recipe table that name unknown rules, or none."""
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    return df.where((F.size(rules) == 0) | (F.size(F.array_except(rules, F.array(*map(F.lit, known)))) > 0))
