"""Command line: cleans or inspects the text on standard input, or a whole table.

    python -m cleanspan.cli [--recipe ID | --rules ID,ID | --inspect] < input
    python -m cleanspan.cli --table IN --column NAME --output OUT [--recipe ID | --rules ID,ID | --inspect]
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from cleanspan.functions.catalogue import DEFAULT_RECIPE, MAX_TEXT_UNITS, RECIPES, RULES, Recipe
from cleanspan.operators import html, scan
from cleanspan.operators.rules import validate_recipe

USAGE = "Usage: cleanspan [--recipe <id> | --rules <id,id,...> | --inspect] < input"


class UsageError(Exception):
    """Bad arguments or input: exit status 2."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        if message.startswith("unrecognized arguments: "):
            raise UsageError(f"Unknown option \u201c{message.removeprefix('unrecognized arguments: ').split()[0]}\u201d.")
        if "ignored explicit argument" in message:
            raise UsageError(f"{message.split()[1].split('/')[-1].rstrip(':')} does not take a value.")
        if "expected one argument" in message:
            raise UsageError(f"{message.split()[1].rstrip(':')} needs a value.")
        raise UsageError(message)


def arguments(given: list[str]) -> argparse.Namespace:
    parser = _Parser(prog="cleanspan", usage=USAGE.removeprefix("Usage: "), allow_abbrev=False)
    parser.add_argument("--recipe", help=f"apply a built-in recipe (default: {DEFAULT_RECIPE})")
    parser.add_argument("--rules", help="apply a comma-separated list of rules, in order")
    parser.add_argument("--inspect", action="store_true", help="print the inspection report as JSON")
    parser.add_argument("--list", action="store_true", help="list the built-in recipes and rules")
    parser.add_argument("--table", help="a Parquet table to clean instead of standard input")
    parser.add_argument("--column", default="text", help="its text column")
    parser.add_argument("--output", help="where the cleaned table goes")
    options = parser.parse_args(given)
    for flag in ("recipe", "rules"):
        if getattr(options, flag) == "":
            raise UsageError(f"--{flag} needs a value.")
    if options.recipe is not None and options.rules is not None:
        raise UsageError("Use either --recipe or --rules, not both.")
    if options.inspect and (options.recipe is not None or options.rules is not None):
        raise UsageError("--inspect reports on the supplied input, so it cannot be combined with --recipe or --rules.")
    return options


def chosen_recipe(options: argparse.Namespace) -> Recipe:
    if options.rules is not None:
        ids = [r.strip() for r in options.rules.split(",") if r.strip()]
        try:
            return validate_recipe({"id": "command-line", "name": "Command-line rules", "rules": ids})
        except (TypeError, ValueError) as error:
            raise UsageError(f"{str(error).rstrip('.')}. Run with --list to see the available rules.") from None
    wanted = options.recipe or DEFAULT_RECIPE
    for recipe in RECIPES:
        if recipe.id == wanted:
            return recipe
    raise UsageError(f"Unknown recipe \u201c{wanted}\u201d. Available: {', '.join(r.id for r in RECIPES)}")


def listing() -> str:
    width = max(len(x.id) for x in (*RECIPES, *RULES))
    lines = ["Recipes:", *(f"  {r.id:<{width}}  {r.name} ({', '.join(r.rules)})" for r in RECIPES)]
    return "\n".join([*lines, "", "Rules:", *(f"  {r.id:<{width}}  {r.label}" for r in RULES)]) + "\n"


def counted(n: int, noun: str) -> str:
    return f"{n:,} {noun}" + ("" if n == 1 else "s")


def remaining(record: dict) -> list[str]:
    omitted = record["omittedFindings"]
    kinds = (
        ("secretWarnings", "likelySecrets", "likely secret"),
        ("terminalControls", "terminalControls", "terminal control sequence"),
        ("hidden", "hidden", "hidden character"),
        ("formulaLines", "formulaLines", "formula-like line"),
    )
    totals = [(len(record[k]) + omitted[o], noun) for k, o, noun in kinds]
    return [counted(n, noun) for n, noun in totals if n]


def read_input(stream) -> str:
    """UTF-8 of standard input, bytes that are none replaced; stops reading past the limit."""
    data = stream.read(4 * MAX_TEXT_UNITS + 4)
    text = data.decode(errors="replace")
    if scan.Places(text).units(len(text)) > MAX_TEXT_UNITS:
        raise UsageError(f"Input exceeds the {MAX_TEXT_UNITS:,} character limit.")
    return scan.checked(text)


def apply(texts: list[str], recipe: Recipe) -> list[list[str]]:
    """The texts after each rule of a recipe; a local session runs the rules that are Columns."""
    local = {"strip-html": html.strip_html, "strip-terminal-controls": scan.strip_terminal_controls}
    if all(r in local for r in recipe.rules):
        steps = [texts]
        for r in recipe.rules:
            steps.append([local[r](t) for t in steps[-1]])
        return steps[1:]
    from pyspark.sql import functions as F

    from cleanspan.operators.rules import edits

    df = session().createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = edits(df, "t", recipe).orderBy("i").select(F.col("edits.after").alias("a")).collect()
    return [list(x) for x in zip(*(r.a for r in got), strict=True)]


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.appName("cleanspan")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_table(options: argparse.Namespace) -> None:
    from cleanspan.operators.reports import inspected
    from cleanspan.operators.rules import clean

    if not options.output:
        raise UsageError("--table needs --output.")
    df = session().read.parquet(options.table)
    done = inspected(df, options.column) if options.inspect else clean(df, options.column, chosen_recipe(options))
    done.write.parquet(options.output)


def main(given: list[str] | None = None) -> int:
    try:
        options = arguments(sys.argv[1:] if given is None else given)
        if options.list:
            sys.stdout.write(listing())
        elif options.table:
            run_table(options)
        elif options.inspect:
            record = scan.inspect(read_input(sys.stdin.buffer))
            for found in record["terminalControls"]:
                if found["detail"] is None:
                    del found["detail"]
            sys.stdout.write(json.dumps(record, indent=2, ensure_ascii=False) + "\n")
        else:
            recipe = chosen_recipe(options)
            text = read_input(sys.stdin.buffer)
            steps = [text, *(s[0] for s in apply([text], recipe))]
            sys.stdout.buffer.write(steps[-1].encode())
            changed = sum(a != b for a, b in zip(steps, steps[1:], strict=False))
            sys.stderr.write(f"Applied {counted(len(recipe.rules), 'named rule')}; {changed:,} changed the text.\n")
            if left := remaining(scan.inspect(steps[-1])):
                sys.stderr.write(f"Warning: the output still contains {', '.join(left)}.\n")
        sys.stdout.flush()
    except UsageError as error:
        sys.stderr.write(f"{error}\n{USAGE}\n")
        return 2
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except Exception as error:
        sys.stderr.write(f"{error}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
