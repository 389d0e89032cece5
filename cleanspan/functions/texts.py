"""Rules and measures as Column expressions that stay in the JVM.

Every rule mentions its input once, or binds it with :func:`let`, so a recipe of many rules does not multiply
the expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classes
from .catalogue import MAX_TEXT_UNITS, SITE_KEYS, TRACKING_KEYS, members


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- Measures and validation -----------------------------------------------------------------------


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return let(text, lambda t: (F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("int"))


def size_metrics(text: Column) -> Column:
    """Struct of UTF-16 units, UTF-8 bytes and lines (none in an empty text)."""

    def measures(t: Column) -> Column:
        lines = F.when(t == "", 0).otherwise(F.size(F.split(t, r"\r\n?|\n", -1)))
        return F.struct(utf16_length(t).alias("characters"), F.octet_length(t).alias("bytes"), lines.alias("lines"))

    return let(text, measures)


def show_nul(text: Column) -> Column:
    """The text with NUL made visible as U+FFFD."""
    return F.replace(text, F.lit("\0"), F.lit("\ufffd"))


def validate(text: Column, limit: int | None = MAX_TEXT_UNITS) -> Column:
    """The text with NUL made visible; fails the query on a text of more units than the limit, if there is one."""
    if limit is None:
        return show_nul(text)
    message = F.lit(f"Text is limited to {limit:,} characters.")
    return let(text, lambda t: F.when(utf16_length(t) > limit, F.raise_error(message)).otherwise(show_nul(t)))


def is_too_long(text: Column, limit: int = MAX_TEXT_UNITS) -> Column:
    return utf16_length(text) > limit


def format_code_point(point: Column) -> Column:
    return F.concat(F.lit("U+"), let(F.hex(point), lambda h: F.lpad(h, F.greatest(F.lit(4), F.length(h)), "0")))


def is_multiline(text: Column) -> Column:
    """Whether more than one line has something besides white space."""
    lines = F.split(text, r"\r\n?|\n", -1)
    return F.size(F.filter(lines, lambda line: F.btrim(line, F.lit(classes.SPACE_CHARACTERS)) != "")) > 1


# --- Formula-like lines ----------------------------------------------------------------------------

_S = f"[{classes.SPACE}]"
#: With its area code in brackets; no spreadsheet evaluates it.
_PHONE = rf"\+[0-9]{{1,3}}{_S}?\([0-9]{{1,5}}\)(?:[{classes.SPACE}.-]?[0-9]){{6,14}}(?=[{classes.SPACE}.,;:/)]|\z)"
FORMULA = (
    rf"\A{_S}*(?:=(?!=*{_S}*\z)"
    rf"|(?!{_PHONE})"
    r"[-+](?:[(=@]|[0-9.]+" + _S + r"*[-+*/^&%(]|[A-Za-z_][A-Za-z0-9_.]*" + _S + r"*[(|!])"
    r"|@[A-Za-z_][A-Za-z0-9_.]*" + _S + r"*[(|])"
)


def formula_lines(text: Column) -> Column:
    """array<struct<line, cell, label>>: of each line its first cell that a spreadsheet would evaluate."""

    def of_line(line: Column, i: Column) -> Column:
        flags = F.transform(F.split(line, "\t", -1), lambda c: c.rlike(FORMULA))
        return F.struct((i + 1).alias("line"), F.array_position(flags, F.lit(True)).cast("int").alias("cell"))

    found = F.filter(F.transform(F.split(text, r"\r\n?|\n", -1), of_line), lambda x: x["cell"] > 0)
    elsewhere = lambda x: F.concat(F.lit("Formula-like value in cell "), x["cell"].cast("string"), F.lit(" of a tab-separated line."))
    label = lambda x: F.when(x["cell"] == 1, F.lit("Formula-like line begins with =, +, - or @.")).otherwise(elsewhere(x))
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), x["cell"].alias("cell"), label(x).alias("label")))


# --- Rules of one character at a time ----------------------------------------------------------------

#: Nothing below it is removed by the rules for invisible characters: one comparison for most characters of most texts.
RARE = "(?=[\u00ad\u034f-\U0010ffff])"


def without(text: Column, candidates: str, pattern: str, instead: str = "") -> Column:
    """Replaces a pattern in the texts that have one of the candidate characters; others are looked at once and stay."""
    return let(text, lambda t: F.when(t.rlike(f"{RARE}[{candidates}]"), F.regexp_replace(t, pattern, instead)).otherwise(t))


def normalise_line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?|[\u2028\u2029]", "\n")


def replace_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"(?=[\u00a0-\uffff])[{members('space')}]", " ")


def normalise_quotes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[\u2018\u2019]", "'"), "[\u201c\u201d]", '"')


def trim_trailing_space(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]++(?=[\\n\\r\u2028\u2029]|\\z)", "")


def remove_directional(text: Column) -> Column:
    return without(text, members("directional"), f"{RARE}[{members('directional')}]")


def remove_zero_width(text: Column) -> Column:
    """Invisible characters, and joiners where neither an emoji sequence nor a script needs them."""
    script = f"[{classes.joining_script()}]"
    alone = rf"(?:(?<!{script}\u200c)|(?!{script}))"
    not_script = alone.replace(r"\u200c", r"[\u200c\u200d]")
    not_emoji = rf"(?:(?<![{classes.before_joiner()}]\u200d)|(?![{classes.pictographic()}]))"
    pattern = rf"{RARE}(?:[{classes.ALWAYS_INVISIBLE}]|\u200d{not_emoji}{not_script}|\u200c{not_script})"
    return without(text, classes.ALWAYS_INVISIBLE + "\u200c\u200d", pattern)


def remove_payloads(text: Column) -> Column:
    """Tag characters but for flags, variation selectors but for one after a visible character.

    Every alternative begins with the candidate itself, so other characters are passed by after one comparison.
    """
    tag, selector = classes.TAGS, classes.SELECTORS
    flag = f"{classes.FLAG}[\U000e0020-\U000e007e]+\U000e007f(?![{tag}])"
    visible = f"[^{classes.SPACE}{classes.CONTROL}{classes.FORMAT}{selector}]"
    pattern = f"{RARE}(?:({flag})|[{classes.TAG_START}][{tag}]*+|[{selector}]{{2,}}+|[{selector}](?<!{visible}[{selector}]))"
    return without(text, classes.TAG_START + selector, pattern, "$1")


# --- Terminal controls -------------------------------------------------------------------------------

#: The first byte of anything that a terminal obeys.
CONTROL = r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
_COMMAND = r"(?:\x1b\]|\x9d)(?s:.*?)"
_DEVICE = r"(?:\x1b[PX^_]|[\x90\x98\x9e\x9f])(?s:.*?)"
_STOP = r"(?:\x1b\\|\x9c)"
_SHORT = rf"(?:\x1b\[|\x9b)[0-?]*[ -/]*[@-~]|\x1b[ -/]*[0-~]|{CONTROL}"


def strip_terminal_controls(text: Column) -> Column:
    """Terminal controls go, each with the span that a terminal would take.

    A text is cut after its last string terminator and after its last bell. Before the first cut every string that begins
    also ends, between the cuts every command does, and after them nothing does and only introducers go. So no search for
    an end fails, and the time is linear in the text.
    """

    def cleaned(t: Column) -> Column:
        def after(start: Column, done: Column) -> Column:
            return F.substring(start, F.length(done) + 1, F.length(start))

        def parts(closed: Column, rest: Column) -> Column:
            rung = F.regexp_extract(rest, r"(?s)\A.*\x07", 0)
            whole = F.regexp_replace(closed, f"{_COMMAND}(?:{_STOP}|\\x07)|{_DEVICE}{_STOP}|{_SHORT}", "")
            commands = F.regexp_replace(rung, f"{_COMMAND}\\x07|{_SHORT}", "")
            return F.concat(whole, commands, F.regexp_replace(after(rest, rung), _SHORT, ""))

        return let(F.regexp_extract(t, rf"(?s)\A.*{_STOP}", 0), lambda closed: let(after(t, closed), lambda rest: parts(closed, rest)))

    return let(text, lambda t: F.when(t.rlike(CONTROL), cleaned(t)).otherwise(t))


# --- Tracking parameters ---------------------------------------------------------------------------

#: Begins with the character itself, so that what stands before it is only looked at where a URL could begin.
URL = rf"[hH](?<![A-Za-z0-9_][hH])(?iu:ttps?)://[^{classes.SPACE}<>\"'`]+"
GLOBAL_KEY = r"(?iu)\A(?:utm_[a-z0-9_]+|" + "|".join(TRACKING_KEYS) + r")\z"


def _occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _url_end(url: Column) -> Column:
    """Length of a URL without the sentence's punctuation and unbalanced closing brackets after it."""
    tail = F.length(F.regexp_extract(url, r"[.,;:!?*)\]]*\z", 0))

    def peel(state: Column, _: Column) -> Column:
        head = F.left(url, state["end"])
        last = F.right(head, F.lit(1))
        extra = lambda o, c: (last == c) & (_occurrences(head, o) < _occurrences(head, c))
        goes = ~state["stopped"] & (last.isin(list(".,;:!?*")) | extra("(", ")") | extra("[", "]"))
        return F.struct(F.when(goes, state["end"] - 1).otherwise(state["end"]).alias("end"), (~goes).alias("stopped"))

    start = F.struct(F.length(url).alias("end"), F.lit(False).alias("stopped"))
    return F.when(tail == 0, F.length(url)).otherwise(F.aggregate(F.sequence(F.lit(1), tail), start, peel)["end"])


def _is_tracking(key: Column, host: Column) -> Column:
    found = key.rlike(GLOBAL_KEY)
    for host_pattern, key_pattern, any_case in SITE_KEYS:
        found = found | (host.rlike(host_pattern) & key.rlike(("(?iu)" if any_case else "") + rf"\A(?:{key_pattern})\z"))
    return found


def _host(base: Column) -> Column:
    """The host of a URL up to its query, without user, port and a last dot, in lower case."""
    authority = F.regexp_extract(base, r"//([^/\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"\A.*@", ""), r"\.?(?::[0-9]*)?\z", ""))


def _clean_url(raw: Column) -> Column:
    def cleaned(end: Column) -> Column:
        def of(before: Column, base: Column) -> Column:
            query = F.substring(before, F.length(base) + 2, F.length(before))
            rest = F.substring(raw, F.length(before) + 1, F.length(raw))  # the fragment, and what is not the URL's

            def rebuilt(query: Column) -> Column:
                escaped = F.contains(query, F.lit("&amp;"))

                def key_of(pair: Column) -> Column:
                    return let(F.substring_index(pair, "=", 1), lambda k: F.coalesce(F.try_url_decode(k), k))

                def joined(pairs: Column, kept: Column) -> Column:
                    left = F.filter(kept, lambda p: p != "")
                    again = F.when(escaped, F.array_join(left, "&amp;")).otherwise(F.array_join(left, "&"))
                    made = F.concat(base, F.when(F.size(left) > 0, F.concat(F.lit("?"), again)).otherwise(F.lit("")), rest)
                    return F.when(F.size(kept) == F.size(pairs), raw).otherwise(made)

                def chosen(pairs: Column, host: Column) -> Column:
                    kept = F.filter(pairs, lambda p: ~let(key_of(p), lambda k: _is_tracking(k, host)))
                    return let(kept, lambda kept: joined(pairs, kept))

                pairs = F.when(escaped, F.split(query, "&amp;", -1)).otherwise(F.split(query, "&", -1))
                return let(pairs, lambda pairs: let(_host(base), lambda host: chosen(pairs, host)))

            return F.when(F.length(base) == F.length(before), raw).otherwise(let(query, rebuilt))

        before = F.substring_index(F.left(raw, end), "#", 1)
        return let(before, lambda before: let(F.substring_index(before, "?", 1), lambda base: of(before, base)))

    return F.when(~F.contains(raw, F.lit("?")), raw).otherwise(let(_url_end(raw), cleaned))


def remove_tracking(text: Column) -> Column:
    """Query parameters that only track leave the URLs in a text; everything else stays as it is."""

    def rewritten(t: Column) -> Column:
        urls = F.transform(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), _clean_url)
        joined = lambda urls: F.transform(F.split(t, URL, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(urls, i), F.lit(""))))
        return let(urls, lambda urls: F.array_join(joined(urls), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("://")) & F.contains(t, F.lit("?")), rewritten(t)).otherwise(t))


COLUMN_RULES = {
    "remove-tracking": remove_tracking,
    "remove-zero-width": remove_zero_width,
    "remove-directional": remove_directional,
    "remove-invisible-payloads": remove_payloads,
    "strip-terminal-controls": strip_terminal_controls,
    "normalise-line-endings": normalise_line_endings,
    "replace-non-breaking-spaces": replace_spaces,
    "normalise-smart-quotes": normalise_quotes,
    "trim-trailing-space": trim_trailing_space,
}
