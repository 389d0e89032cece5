"""Scanners over one text: invisible characters, terminal controls, likely secrets, and where they stand.

They run inside Arrow batches, where a rule needs state that a Column expression lacks: runs and their contexts,
terminators found in linear time, overlaps between patterns. Offsets inside are code points; reports count UTF-16.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property
from heapq import heappop, heappush
from typing import NamedTuple

from cleanspan.functions import classes
from cleanspan.functions.catalogue import (
    CONTROL_NAMES,
    DISCLOSURE,
    INVISIBLE,
    LIMITATION,
    MAX_DECODED,
    MAX_DETAIL,
    MAX_FINDINGS,
    MAX_TEXT_UNITS,
    MUSICAL_FORMAT,
    SECRET_HINTS,
    SECRETS,
    UNLISTED_FORMAT,
)


class Event(NamedTuple):
    start: int
    end: int
    name: str
    category: str = ""
    detail: str = ""
    count: int = 0

    @property
    def is_run(self) -> bool:
        return self.category == "run"


def clipped(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[:limit] + "\u2026"


@cache
def code_point(character: str) -> str:
    return f"U+{ord(character):04X}"


class Places:
    """UTF-16 offsets, lines and columns of positions in a text."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def hidden(self) -> list[Event]:
        return list(invisible_events(self.text))

    @cached_property
    def wide(self) -> list[int]:
        return [] if self.text.isascii() else [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", self.text)]

    @cached_property
    def breaks(self) -> tuple[list[int], list[int]]:
        spans = [m.span() for m in re.finditer(r"\r\n?|\n", self.text)]
        return [a for a, _ in spans], [b for _, b in spans]

    def units(self, at: int) -> int:
        return at + bisect_left(self.wide, at)

    def of(self, start: int, end: int | None = None) -> dict:
        """offset, line and column of a span, and with an end its length."""
        wide, (starts, ends) = self.wide, self.breaks
        offset = start + bisect_left(wide, start) if wide else start
        passed = bisect_left(starts, start) if starts else 0
        place = {"offset": offset, "line": passed + 1, "column": start - (min(ends[passed - 1], start) if passed else 0) + 1}
        if end is not None:
            place["length"] = self.units(end) - offset
        return place


# --- Invisible characters --------------------------------------------------------------------------


class Scan(NamedTuple):
    """What finds invisible characters: candidates, flags after their base, what selectors and joiners may stand beside."""

    candidates: re.Pattern
    flag: re.Pattern
    base: re.Pattern
    before: re.Pattern
    after: re.Pattern
    script: re.Pattern
    names: dict[str, tuple[str, str]]


@cache
def invisible() -> Scan:
    import regex

    low, high = MUSICAL_FORMAT
    unlisted = (p for a, b in UNLISTED_FORMAT for p in range(a, b + 1))
    names = {chr(p): ("musical formatting character" if low <= p <= high else "format character", "invisible") for p in unlisted}
    names |= {chr(p): name for p, name in INVISIBLE.items()}
    return Scan(
        re.compile(f"(?P<tags>[{classes.TAG_START}][{classes.TAGS}]*)|(?P<selectors>[{classes.SELECTORS}]+)|[{''.join(names)}]"),
        re.compile("[\U000e0020-\U000e007e]+\U000e007f"),
        regex.compile(rf"[^{classes.SPACE}\p{{Cc}}{classes.FORMAT}]"),
        *(regex.compile(f"[{c()}]") for c in (classes.before_joiner, classes.pictographic, classes.joining_script)),
        names,
    )


TAG_NAMES = {"\U000e0001": "language tag", "\U000e007f": "cancel tag"}


def _selector_bytes(run: str) -> str:
    data = bytes(ord(c) - 0xFE00 if ord(c) <= 0xFE0F else ord(c) - 0xE0100 + 16 for c in run)
    try:
        return data.decode().removeprefix("\ufeff")
    except UnicodeDecodeError:
        return ""


def invisible_events(text: str) -> Iterator[Event]:
    """Invisible and unusual characters in order; a run that can carry text comes before its characters."""
    if text.isascii():
        return
    candidates, flag, base, before, after, script, names = invisible()

    def needed(at: int) -> bool:
        """Whether the joiner there is part of an emoji sequence or of a word in a script that joins."""
        left, right = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        if not left or not right:
            return False
        return bool((text[at] == "\u200d" and before.match(left) and after.match(right)) or (script.match(left) and script.match(right)))

    for m in candidates.finditer(text):
        found, (start, end) = m[0], m.span()
        if (kind := m.lastgroup) is None:
            name, category = names[found]
            if category != "joiner" or not needed(start):
                yield Event(start, end, name, category)
        elif kind == "tags":
            if start and text[start - 1] == classes.FLAG and flag.fullmatch(found):
                continue
            hidden = "".join(chr(ord(c) - 0xE0000) for c in found if 0xE0020 <= ord(c) <= 0xE007E)
            yield Event(start, end, "tag characters", "run", clipped(hidden, MAX_DECODED), len(found))
            for i, c in enumerate(found, start):
                yield Event(i, i + 1, TAG_NAMES.get(c, "tag character"), "payload")
        else:
            if len(found) > 1:
                yield Event(start, end, "variation selectors", "run", clipped(_selector_bytes(found), MAX_DECODED), len(found))
            elif start and base.match(text[start - 1]):
                continue
            for i in range(start, end):
                yield Event(i, i + 1, "variation selector", "payload")


# --- Terminal controls -----------------------------------------------------------------------------

# Named in the order in which the alternatives are tried.
CONTROL = re.compile(
    r"(?P<command>\x1b\]|\x9d)"
    r"|(?P<device>\x1b[PX^_]|[\x90\x98\x9e\x9f])"
    r"|(?P<sequence>(?:\x1b\[|\x9b)[0-?]*[ -/]*[@-~])"
    r"|(?P<escape>\x1b[ -/]*[0-~])"
    r"|(?P<single>[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f])"
    r"|(?P<return>\r(?!\n))"
)


class _Terminators:
    """The next string terminator after a place, from lists that are made once."""

    def __init__(self, text: str):
        self.text, self.lists = text, None

    def after(self, at: int, bell: bool) -> tuple[int, int] | None:
        if self.lists is None:
            spans = [m.span() for m in re.finditer(r"(?=(\x1b\\|\x9c|\x07))", self.text)]
            spans = [(a, a + (2 if self.text[a] == "\x1b" else 1)) for a, _ in spans]
            self.lists = {True: spans, False: [s for s in spans if self.text[s[0]] != "\x07"]}
        spans = self.lists[bell]
        i = bisect_left(spans, (at, 0))
        return spans[i] if i < len(spans) else None


def _base64_text(data: str) -> str:
    data = "".join(c for c in data if c not in classes.SPACE_CHARACTERS)
    if len(data) % 4 == 0:
        data = data.removesuffix("=").removesuffix("=")
    if len(data) % 4 == 1 or not re.fullmatch(r"[A-Za-z0-9+/]*", data):
        return ""
    try:
        return base64.b64decode(data + "=" * (-len(data) % 4)).decode().removeprefix("\ufeff")
    except (binascii.Error, UnicodeDecodeError):
        return ""


#: Commands by number: label, the field from which the detail goes on, and how it is read.
COMMANDS = {
    "0": ("terminal title change", 1, str),
    "1": ("terminal title change", 1, str),
    "2": ("terminal title change", 1, str),
    "8": ("terminal hyperlink", 2, str),
    "52": ("terminal clipboard write", 2, _base64_text),
}
#: Labels that hang on what a command carries.
EMPTY_LINK, CLIPBOARD_READ = "terminal hyperlink end", "terminal clipboard read request"


def command_of(body: str) -> tuple[str, str]:
    """Label and detail of an operating system command."""
    number = body.partition(";")[0]
    label, skip, read = COMMANDS.get(number, ("terminal operating system command", None, None))
    if skip is None:
        return label, ""
    fields = body.split(";", skip)
    payload = fields[skip] if len(fields) > skip else ""
    if number == "8" and not payload:
        return EMPTY_LINK, ""
    if number == "52" and payload == "?":
        return CLIPBOARD_READ, ""
    return label, clipped(read(payload), MAX_DETAIL)


#: Any character that a control can begin with.
ANY_CONTROL = re.compile(r"[\x01-\x08\x0b-\x1f\x7f-\x9f]")


def terminal_events(text: str) -> Iterator[Event]:
    """Terminal controls in order, each with the span that a terminal would take; category ``kept`` is reported only."""
    terminators, at, has_line_feed = _Terminators(text), 0, "\n" in text
    while begin := ANY_CONTROL.search(text, at):
        m = CONTROL.match(text, begin.start())
        if not m:  # a carriage return before a line feed
            at = begin.end()
            continue
        start, at, found, kind = m.start(), m.end(), m[0], m.lastgroup
        category, detail = "", ""
        if kind == "return":
            if not has_line_feed:
                continue
            label, category = "carriage return without line feed", "kept"
        elif kind in ("command", "device"):
            plain = "terminal operating system command" if kind == "command" else "terminal device control string"
            if stop := terminators.after(at, kind == "command"):
                label, detail = command_of(text[at : stop[0]]) if kind == "command" else (plain, "")
                at = stop[1]
            else:
                label = f"unterminated {plain}; a terminal would hide the text that follows"
        elif kind == "sequence" or (kind == "escape" and found.startswith("\x1b[")):
            label = "terminal colour or style sequence" if found.endswith("m") else "terminal cursor or screen control sequence"
        elif kind == "escape":
            label = "terminal escape sequence"
        elif found == "\x1b":
            label = "escape character"
        elif found >= "\x80":
            label = "C1 control character"
        else:
            label = CONTROL_NAMES.get(ord(found), "control character")
        yield Event(start, at, label, category, detail)


def strip_terminal_controls(text: str) -> str:
    kept, at = [], 0
    for e in terminal_events(text):
        if e.category != "kept":
            kept.append(text[at : e.start])
            at = e.end
    return "".join([*kept, text[at:]])


# --- Likely secrets --------------------------------------------------------------------------------


class Shape(NamedTuple):
    id: str
    label: str
    hint: str  # what every match has in it; in lower case where case is ignored
    any_case: bool
    pattern: re.Pattern


@cache
def shapes() -> list[Shape]:
    meanings = {"<E": r"(?<![A-Za-z0-9_-])", "E>": r"(?![A-Za-z0-9_-])", "<B": r"(?<![A-Za-z0-9_])", "<S": classes.SPACE}
    marks = re.compile("|".join(meanings))
    return [
        Shape(key, label, SECRET_HINTS[key], any_case, re.compile(marks.sub(lambda m: meanings[m[0]], shape), re.I if any_case else 0))
        for key, label, shape, any_case in SECRETS
    ]


def secret_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, id, label), earliest first, none inside another; ties go to the shape listed first.

    Shapes whose hint the text lacks are not searched for. The first match of each is kept at hand, and the earliest is taken.
    """
    low = text.casefold()
    found = [s for s in shapes() if s.hint in (low if s.any_case else text)]
    ahead: list[tuple[int, int, int]] = []

    def advance(rank: int, at: int) -> None:
        if m := found[rank].pattern.search(text, at):
            heappush(ahead, (m.start(), rank, m.end()))

    for rank in range(len(found)):
        advance(rank, 0)
    taken, covered = [], 0
    while ahead:
        start, rank, end = heappop(ahead)
        if start >= covered:
            taken.append((start, end, found[rank].id, found[rank].label))
            covered = end
        advance(rank, end)
    return taken


def checked(text: str, limit: int | None = MAX_TEXT_UNITS) -> str:
    """The text with NUL made visible; fails on a text of more UTF-16 units than the limit, if there is one."""
    if limit is not None and (len(text) > limit or Places(text).units(len(text)) > limit):
        raise ValueError(f"Text is limited to {limit:,} characters.")
    return text.replace("\0", "\ufffd")


# --- Findings --------------------------------------------------------------------------------------


def hidden(text: str, places: Places) -> Iterator[dict]:
    for e in places.hidden:
        if e.category != "run":
            found = places.of(e.start)
            found["codePoint"], found["name"] = code_point(text[e.start]), e.name
            yield found


def hidden_text(text: str, places: Places) -> Iterator[dict]:
    for e in places.hidden:
        if e.is_run:
            yield {"characters": e.count, "kind": e.name, "decoded": e.detail, **places.of(e.start, e.end)}


def secret_warnings(text: str, places: Places) -> Iterator[dict]:
    for start, end, key, label in secret_spans(text):
        yield {"id": key, "label": label, "disclosure": DISCLOSURE, **places.of(start, end)}


def terminal_controls(text: str, places: Places) -> Iterator[dict]:
    for e in terminal_events(text):
        yield {"codePoint": code_point(text[e.start]), "label": e.name, "detail": e.detail or None, **places.of(e.start, e.end)}


@cache
def formula() -> re.Pattern:
    from cleanspan.functions.texts import FORMULA

    return re.compile(FORMULA.replace(r"\z", r"\Z"))


def formula_lines(text: str, places: Places) -> Iterator[dict]:
    looks = formula().match
    for number, line in enumerate(lines_of(text), 1):
        cell = next((k for k, c in enumerate(line.split("\t"), 1) if looks(c)), 0)
        if cell:
            yield {"line": number, "cell": cell, "label": FIRST_CELL if cell == 1 else LATER_CELL.format(cell)}


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n?|\n", text)


FIRST_CELL = "Formula-like line begins with =, +, - or @."
LATER_CELL = "Formula-like value in cell {} of a tab-separated line."
Detector = Callable[[str, Places], Iterable[dict]]
#: The kinds of findings by the names that the record has for them.
DETECTORS: dict[str, Detector] = {
    "hidden": hidden,
    "hiddenText": hidden_text,
    "secretWarnings": secret_warnings,
    "terminalControls": terminal_controls,
    "formulaLines": formula_lines,
}
#: What the record calls the findings of a kind that it leaves out, where the names differ.
OMITTED_AS = {"secretWarnings": "likelySecrets"}


def findings(text: str, kinds: Iterable[str] = tuple(DETECTORS)) -> dict[str, list[dict]]:
    """All findings of some kinds."""
    places = Places(text)
    return {kind: list(DETECTORS[kind](text, places)) for kind in kinds}


def inspect(text: str, most: int = MAX_FINDINGS) -> dict:
    """The inspection record of a validated text, with at most so many findings of a kind."""
    found, lines = findings(text), lines_of(text)
    record = {kind: rows[:most] for kind, rows in found.items()}
    record["omittedFindings"] = {OMITTED_AS.get(kind, kind): max(0, len(rows) - most) for kind, rows in found.items()}
    sizes = {"characters": Places(text).units(len(text)), "bytes": len(text.encode()), "lines": len(lines) if text else 0}
    several = sum(bool(line.strip(classes.SPACE_CHARACTERS)) for line in lines) > 1
    return sizes | record | {"multilineCommand": several, "limitation": LIMITATION}


def cut_units(text: str, units: int) -> str:
    """The first ``units`` UTF-16 units of a text; a character that does not fit whole is left out."""
    places = Places(text)
    if places.units(len(text)) <= units:
        return text
    low = bisect_right(range(len(text) + 1), units, key=places.units)
    return text[: low - 1]
