"""Rules and detectors: generated texts against plain models of the same rule, and the cases that the queries put into documents."""

import gc
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cleanspan.functions import texts
from cleanspan.functions.catalogue import INVISIBLE, MAX_PREVIEW, MAX_TEXT_UNITS, RECIPES, RULES, SECRETS, TRACKING_KEYS
from cleanspan.operators import diff, html, preview, reports, rules, scan
from cleanspan.plans import dirt

ESC, BEL = dirt.ESC, dirt.BEL
#: What random texts are made of.
CONTROLS = [f"{ESC}[31m", f"{ESC}]8;;h{BEL}", BEL, f"{ESC}]0;t{dirt.ST}", "\x9b2J", f"{ESC}P", "\x9c", "\x85", ESC, f"{ESC}(B", "\x9d", "\x90", "\\", "("]
RARE = ["\u200b", "\u200d", "\u200c", "\U0001f680", "\ufe0f", "\U000e0041", "\U000e0001", "\u202e", "\u00a0", "\u2028", "\u0645", "\U0001f3f4", "\U000e0067\U000e007f", "\u0600"]
PLAIN = ["a", "\u00e9", " ", "\t", "\n", "\r", "\r\n", "'", "\u201c", "x y"]


def made_of(parts, n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def run(spark):
    def apply(function, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(4)
        return [r.o for r in df.select("i", function(F.col("t")).alias("o")).orderBy("i").collect()]

    return apply


# --- Invisible characters ------------------------------------------------------------------------------


def test_every_character_of_the_catalogue_is_named_and_removed_by_its_rule(run):
    removed = {"invisible": "", "joiner": "", "directional": "", "space": " ", "line-break": "\n"}
    every = ["remove-zero-width", "remove-directional", "replace-non-breaking-spaces", "normalise-line-endings"]
    points = sorted(INVISIBLE)
    values = [f"q{chr(p)}w" for p in points]
    for p, text in zip(points, values, strict=True):
        (found,) = scan.findings(text)["hidden"]
        assert (found["name"], found["codePoint"], found["offset"]) == (INVISIBLE[p][0], f"U+{p:04X}", 1)
    got = run(lambda t: rules.cleaned(t, {"name": "All", "rules": every}), values)
    assert got == [f"q{removed[INVISIBLE[p][1]]}w" for p in points]
    assert len(points) == 57 and len(RULES) == 10 and len(RECIPES) == 6


def test_columns_and_scanners_agree(run):
    """Each rule that is an expression against what the scanner of the same rule would cut out."""
    values = made_of(CONTROLS + RARE + PLAIN, 3000, 1)
    kinds = {"remove-zero-width": {"invisible", "joiner"}, "remove-directional": {"directional"}, "remove-invisible-payloads": {"payload"}}
    for rule, categories in kinds.items():
        for text, out in zip(values, run(texts.COLUMN_RULES[rule], values), strict=True):
            gone = {e.start for e in scan.invisible_events(text) if e.category in categories}
            assert out == "".join(c for i, c in enumerate(text) if i not in gone), (rule, text)
    assert run(texts.strip_terminal_controls, values) == list(map(scan.strip_terminal_controls, values))


def test_simple_rules_against_python(run):
    values = made_of(RARE + PLAIN + ["\u2029", "\u3000", "\u2009", "\u2019"], 2000, 2)
    spaces = {p: " " for p, (_, kind) in INVISIBLE.items() if kind == "space"}
    plain = {
        texts.replace_spaces: lambda t: t.translate(spaces),
        texts.normalise_quotes: lambda t: t.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"'}),
        texts.normalise_line_endings: lambda t: re.sub("\r\n|[\r\u2028\u2029]", "\n", t),
        texts.trim_trailing_space: lambda t: "".join(p if p in "\n\r\u2028\u2029" else p.rstrip(" \t") for p in re.split("([\n\r\u2028\u2029])", t)),
        texts.show_nul: lambda t: t.replace("\0", "\ufffd"),
    }
    values += ["a\0b", "\0"]
    for column, want in plain.items():
        assert run(column, values) == list(map(want, values)), column.__name__


def test_cases_of_joiners_and_selectors():
    for case in dirt.JOINED:
        assert [(h["offset"], h["name"]) for h in scan.findings(case.piece)["hidden"]] == [(at, label) for at, label, *_ in case.events], case
        run = [(h["offset"], h["kind"], h["length"], h["decoded"]) for h in scan.findings(case.piece)["hiddenText"]]
        assert run == ([dirt.RUNS[case.word]] if case.word in dirt.RUNS else [])


def test_places_against_counting():
    """Offset, line and column by walking the text."""
    for text in made_of(RARE + PLAIN, 400, 3):
        places, line, column, units = {}, 1, 1, 0
        for i, c in enumerate(text):
            places[i] = (units, line, column)
            if c == "\n" and i and text[i - 1] == "\r":
                column = 1
            elif c in "\r\n":
                line, column = line + 1, 1
            else:
                column += 1
            units += 1 + (c > "\uffff")
        found = scan.findings(text)["hidden"]
        starts = [e.start for e in scan.invisible_events(text) if not e.is_run]
        for at, h in zip(starts, found, strict=True):
            want = places[at] if not (text[at - 1 : at] == "\r" and text[at] == "\n") else None
            assert (h["offset"], h["line"], h["column"]) == want


# --- Terminal controls ---------------------------------------------------------------------------------


@pytest.mark.parametrize("case", [*dirt.TERMINAL, dirt.UNTERMINATED], ids=lambda c: repr(c.word))
def test_terminal_controls(case):
    got = [(c["offset"], c["label"], c["length"], c["detail"]) for c in scan.findings("\n" + case.piece)["terminalControls"]]
    assert got == [(at + 1, *rest) for at, *rest in case.events]
    assert scan.strip_terminal_controls(case.piece) == case.clean


def test_carriage_returns_count_among_line_feeds_only():
    labels = lambda t: [c["label"] for c in scan.findings(t)["terminalControls"]]
    assert labels("top\rover\rdone") == labels("top\r\nover\r\n") == []
    assert labels("top\rover\n") == ["carriage return without line feed"]


# --- Markup ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("case", dirt.MARKUP, ids=lambda c: repr(c.word))
def test_markup(case):
    want = case.clean.replace("\x01", "\n")
    assert html.strip_html(f"start{case.piece}end<wbr>") == f"start{want}end"


def test_references():
    assert html.strip_html("&#x41;&#66;&lt;i&gt;&#x9F;&#129;&Amp;&amp;lt;") == "AB<i>\u0178\x81&Amp;&lt;"
    for bad in ("&#0;", "&#xD900;", "&#1114112;"):
        assert html.strip_html(bad) == "\ufffd"
    assert html.strip_html("&#xE000;") == "\ufffd" and html.strip_html("\ue000&#xE000;") == "\ue000\ue000"
    assert html.strip_html("".join(map(chr, range(0xE000, 0xF900))) + "<b>x</b>").endswith("x")


def test_text_without_tags_stays(run):
    kept = ["3 < 4, 5 > 2", "mail <me@here.test> or <https://here.test>", "Vec<T> and Dict<Str, Int>", "a <div", "a <!-- b", "\n\n\n x \n\n\n", "", "`<hr>`", "~~~\n<hr>"]
    assert run(rules.strip_html, kept) == kept
    assert html.strip_html("``a `<hr>` b`` <hr>") == "``a `<hr>` b``"
    assert html.strip_html("`a\n\n<hr>b`") == "`a\n\nb`"  # a paragraph ends a span
    assert html.strip_html("<script>a<script>b</script>c") == "c" and html.strip_html("<style>a") == "a"


def test_layout_of_tables_and_lists():
    table = "<table>\n<tr><th>k</th> <th>v</th></tr>\n <tr><td>1</td><td>2</td></tr>\n</table>after"
    assert html.strip_html(table) == "k\tv\n1\t2\n\nafter"
    assert html.strip_html("<ol>\n<li>x</li>\n<li><b>y</b> z</li></ol>") == "x\ny z"
    assert html.strip_html("<dl><dt>t</dt><dd>d</dd></dl>\r\n\r\n \r\n\r\nq") == "t\nd\n\nq"


# --- Links -----------------------------------------------------------------------------------------------


def test_links(run):
    cases = {c.piece: c.clean for c in dirt.LINKS}
    cases |= {f"http://k.test/p?{k.upper()}=1&n=2#f": "http://k.test/p?n=2#f" for k in TRACKING_KEYS}
    cases |= {f"http://k.test/p?{k}=1": "http://k.test/p" for k in TRACKING_KEYS}
    cases |= {t: t for t in ("https://k.test/?q=1&flag", "https://", "see ?utm_source=1", "HTTPS://K.Test/\u00fc?a=%C3%BC", "https://k.test/?a=x\ufffdy&b")}
    cases["https://k.test/?a=\0&gclid=1"] = "https://k.test/?a=\0"
    assert run(texts.remove_tracking, list(cases)) == list(cases.values())


# --- Formulas, lines, sizes --------------------------------------------------------------------------------

FORMULAS = ["=1", "= x", "  =A1+B2", "+(2)", "-(a", "+1*2", "-3.5%", "-f(x)", "+name|y", "@f(x)", "@a.b|c", "-=1", "+@x"]
NO_FORMULAS = ["- point", "+ point", "----", "====", "= ", "-7", "+49 30 1234", "--flag", "-x y", "@name hello", "a=1", "", "*(1)"]


def test_formulas_lines_and_sizes(run):
    tabbed = "k\t=1\nv\tw\r\t\t@f(x)"
    cases = [*FORMULAS, *NO_FORMULAS, tabbed, "one\ntwo", "one\n \t\n", *made_of(RARE + PLAIN + ["=1", "-2+3"], 300, 5)]
    for text, lines, several, sizes in zip(cases, run(texts.formula_lines, cases), run(texts.is_multiline, cases), run(texts.size_metrics, cases), strict=True):
        record = scan.inspect(text)
        assert [x.asDict() for x in lines] == record["formulaLines"] and several == record["multilineCommand"], text
        assert sizes.asDict() == {k: record[k] for k in ("characters", "bytes", "lines")}
    assert all(scan.inspect(t)["formulaLines"] for t in FORMULAS) and not any(scan.inspect(t)["formulaLines"] for t in NO_FORMULAS)
    assert [(x["line"], x["cell"]) for x in scan.inspect(tabbed)["formulaLines"]] == [(1, 2), (3, 3)]
    assert run(lambda t: texts.format_code_point(t.cast("int")), ["200", "8203", "128640"]) == ["U+00C8", "U+200B", "U+1F680"]


def test_phone_numbers_are_no_formulas(run):
    phones = ["+1 (389) 555-5010 Les des", "+1(389)5555010", " +49 (0)30 1234", "+44 (0)20 7946 0000, or", "+1 (389) 555-5010\u00a0the", "+1 (389) 555-5010."]
    formulas = ["+1 (2)", "+1 (2)*3", "-1 (389) 555-5010", "+1 (389) 555-5010*2", "+1 (389) 555-5010+cmd|' /C calc'!A0", "+1-389-555-5010", "+1*(389) 555"]
    cases = [*phones, *formulas, "k\t+1 (389) 555-5010\t=1"]
    for text, lines in zip(cases, run(texts.formula_lines, cases), strict=True):
        assert [x.asDict() for x in lines] == scan.inspect(text)["formulaLines"], text
        assert [x.cell for x in lines] == ([] if text in phones else [1] if text in formulas else [3]), text


# --- Secrets ---------------------------------------------------------------------------------------------


def test_secrets():
    assert {k for k, _ in dirt.SECRETS.values() if k} == {s[0] for s in SECRETS}
    for key, value in dirt.SECRETS.values():
        got = [(s["id"], s["offset"], s["length"]) for s in scan.findings(f"\U0001f680 {value} .")["secretWarnings"]]
        assert got == ([(key, 3, len(value))] if key else []), value
        assert value not in str(scan.inspect(value)["secretWarnings"])


def test_overlapping_secrets():
    """Against all matches of all shapes, sorted and swept."""
    pieces = [v for _, v in dirt.SECRETS.values()] + [" ", "-", "x", "Bearer ", "sk-", "://"]
    for text in made_of(pieces, 400, 6, 6):
        matches = sorted((m.start(), rank, m.end()) for rank, s in enumerate(scan.shapes()) for m in s.pattern.finditer(text))
        want, covered = [], 0
        for start, rank, end in matches:
            if start >= covered:
                want.append((start, end, scan.shapes()[rank].id))
                covered = end
        assert [s[:3] for s in scan.secret_spans(text)] == want


# --- Preview ---------------------------------------------------------------------------------------------


def test_preview():
    shown = preview.visible_text(f"k\u2060{dirt.TAGS}\t{ESC}[1m{ESC}]2;T{BEL}\x7f\r\n")
    assert shown == (
        "k\u27e6word joiner U+2060\u27e7\u27e62 tag characters hiding \u201chi\u201d\u27e7\u27e6tab U+0009\u27e7\u27e6terminal colour or style sequence \u241b[1m\u27e7"
        "\u27e6terminal title change: \u201cT\u201d\u27e7\u27e6delete control character U+007F\u27e7\u27e6carriage return U+000D\u27e7\n"
    )
    whole = "b" * MAX_PREVIEW
    assert preview.visible_text(whole) == whole
    for text in (whole + "b", "\u2060" * 9_000):
        made = preview.visible_text(text)
        assert made.endswith("\n\u27e6preview truncated at 60,000 characters\u27e7") and len(made) == MAX_PREVIEW + 41
    # Without anything to show a text is its own preview; what is inside a terminal string is part of it.
    assert preview.visible_text("\u00e9 \U0001f680") == "\u00e9 \U0001f680"
    assert preview.visible_text(f"{ESC}]9;\u200b{BEL}").count("\u27e6") == 1


# --- Changes ---------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] if x == y else 1 + min(last[j], row[j - 1]))
    return row[-1]


def test_changes_rebuild_the_text_with_the_fewest_edits():
    rng = random.Random(7)
    for _ in range(1500):
        old, new = ([rng.choice("uvwxyz") for _ in range(rng.randint(1, 12))] for _ in range(2))
        got = diff.describe_changes("\n".join(old), "\n".join(new))
        lines, edits = list(old), 0
        for h in reversed(got["hunks"]):
            at = h["line"] - 1
            before, after = (h[k].split("\n") if h[n] else [] for k, n in (("before", "lines"), ("after", "addedLines")))
            assert lines[at : at + h["lines"]] == before
            lines[at : at + h["lines"]] = after
            edits += h["lines"] + h["addedLines"]
        assert lines == new and edits == edit_distance(old, new) and got["omitted"] == 0


def test_changes_that_are_many_or_long():
    old = [f"r{i}" for i in range(700)]
    apart = diff.describe_changes("\n".join(old), "\n".join(f"s{i}" for i in range(700)))
    assert (len(apart["hunks"]), apart["omitted"]) == (50, 650) and apart["hunks"][3]["before"] == "r3"
    (block,) = diff.describe_changes("\n".join(old), "\n".join(f"s{i}" for i in range(699)))["hunks"]
    assert (block["line"], block["lines"], block["addedLines"]) == (1, 700, 699)
    (long,) = diff.describe_changes("keep\n" + "m" * 3000, "keep\n" + "n" * 3000)["hunks"]
    assert long["line"] == 2 and long["before"] == "m" * 2000 + "\u2026"
    assert diff.describe_changes("same\n", "same\n") == {"hunks": [], "omitted": 0}


# --- Recipes ---------------------------------------------------------------------------------------------


def test_recipes_are_validated():
    good = {"name": "  Mine ", "rules": ["trim-trailing-space", "strip-html", "trim-trailing-space"]}
    made = rules.validate_recipe(good)
    assert (made.name, made.rules) == ("Mine", ("trim-trailing-space", "strip-html")) and made.id.startswith("custom-")
    for change, error in (
        ({"name": "\u00a0"}, ValueError), ({"name": 7}, ValueError), ({"rules": []}, ValueError), ({"rules": "strip-html"}, ValueError),
        ({"rules": ["__init__"]}, ValueError), ({"rules": ["Strip-HTML"]}, ValueError), ({"rules": [None]}, TypeError), ({"rules": [["strip-html"]]}, TypeError),
    ):
        with pytest.raises(error):
            rules.validate_recipe(good | change)
    for bad in (None, "strip-html", 3, ["strip-html"]):
        with pytest.raises(TypeError):
            rules.validate_recipe(bad)
    long = rules.validate_recipe(good | {"id": " " + "\U0001f680" * 101, "name": "\U0001f680" * 81})
    assert (len(long.id), len(long.name)) == (100, 80)
    assert [rules.validate_recipe(r) for r in RECIPES] == list(RECIPES) and [rules.recipe_of(r.id) for r in RECIPES] == list(RECIPES)
    with pytest.raises(ValueError, match="Unknown recipe"):
        rules.recipe_of("tidy")


def test_apply_recipe(spark):
    text = "<h1>Kept\u200b</h1>\u00a0 http://k.test/?gclid=1&n=2 \0"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    row = rules.apply_recipe(df, "t", "clean-markdown").where("t IS NOT NULL").first()
    assert row.output == "Kept\n  http://k.test/?n=2 \ufffd"
    steps = [text.replace("\0", "\ufffd"), *[e.after for e in row.edits]]
    for before, e, rule in zip(steps, row.edits, rules.recipe_of("clean-markdown").rules, strict=False):
        assert (e.ruleId, e.before, e.changed, e.characterDelta) == (rule, before, e.after != before, len(e.after) - len(before))
    assert steps[-1] == row.output and len(row.inspection.hidden) == 2 and not row.outputInspection.hidden
    assert rules.apply_recipe(df, "t", "clean-markdown").where("t IS NULL").first().output is None


def test_length_limit(spark):
    """One text has a limit where one is asked for; tables take any length, and can be split by it."""
    df = spark.createDataFrame([("a" * (MAX_TEXT_UNITS + 1) + "\u200b",), ("ok\0",)], "t string")
    good, bad = rules.split_by_length(df, "t")
    assert rules.clean(good, "t", "clean-links").first().t == "ok\ufffd" and bad.count() == 1
    assert rules.clean(df, "t", "remove-invisible").where(F.length("t") > 9).first().t == "a" * (MAX_TEXT_UNITS + 1)
    assert reports.findings(df.where(F.length("t") > 9), "t", "t", ("hidden",)).count() == 1
    with pytest.raises(Exception, match="500,000"):
        rules.clean(df, "t", "clean-links", limit=MAX_TEXT_UNITS).collect()


# --- Caps and time -----------------------------------------------------------------------------------------


def test_caps_are_those_of_the_record():
    text = "\u2060" * 1200 + "\n=1" * 1100
    record = scan.inspect(text)
    assert (len(record["hidden"]), record["omittedFindings"]["hidden"], record["omittedFindings"]["formulaLines"]) == (1000, 200, 100)
    assert len(scan.findings(text)["hidden"]) == 1200


@pytest.mark.parametrize(
    "most, work",
    [
        (3, lambda: (scan.inspect("\u2060" * 400_000), scan.inspect("\u4e2d\U0001f469\u200d\U0001f680" * 50_000))),
        (3, lambda: (scan.inspect(f"{ESC}]" * 100_000 + f"{ESC}_" * 100_000), scan.strip_terminal_controls(f"{ESC}[" * 200_000))),
        (2, lambda: html.strip_html("<p>t</p>" * 30_000 + "<b " * 20_000 + "~~~" + "x < y " * 20_000)),
        (2, lambda: html.strip_html("<script>" * 30_000 + "`" + "``a" * 30_000)),
    ],
    ids=["invisible", "terminal", "markup", "unclosed"],
)
def test_time_is_linear(most, work):
    scan.inspect("\u2060")
    gc.collect()
    gc.freeze()  # what other tests hold is none of this test's time
    start = time.process_time()
    work()
    assert time.process_time() - start < most


def test_native_terminal_rule_is_linear(run):
    texts_ = [f"{ESC}]" * 100_000 + f"{ESC}P" * 100_000, f"{ESC}Px" * 60_000 + BEL, f"{ESC}]x" * 60_000 + dirt.ST]
    start = time.time()
    got = run(texts.strip_terminal_controls, texts_)
    assert got == ["", "x" * 60_000, ""] and time.time() - start < 30
