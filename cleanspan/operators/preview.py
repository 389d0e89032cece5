"""A text with its hidden characters and controls spelled out.

Both scanners' events become marks, a span and what to show for it. The marks are folded over the text in order, and a
mark that begins inside the span of an earlier one is covered by it.
"""

from __future__ import annotations

from collections.abc import Iterator

from cleanspan.functions.catalogue import MAX_CONTROL_PREVIEW, MAX_PREVIEW

from .scan import Event, Places, code_point, cut_units, invisible_events, terminal_events

OPEN, SHUT = "\u27e6", "\u27e7"
#: What stands for a control character: pictures for C0 and DEL, code points for C1; and for white space that moves the cursor.
PICTURES = {i: 0x2400 + i for i in range(0x20)} | {0x7F: 0x2421} | {i: f"U+{i:04X}" for i in range(0x80, 0xA0)}
MOVES = {0x09: f"{OPEN}tab U+0009{SHUT}", 0x0D: f"{OPEN}carriage return U+000D{SHUT}"}


def quoted(text: str) -> str:
    return f"\u201c{text}\u201d"


def of_invisible(event: Event, found: str) -> str:
    if not event.is_run:
        return f"{event.name} {code_point(found)}"
    return f"{event.count:,} {event.name}" + (f" hiding {quoted(event.detail)}" if event.detail else "")


def of_control(event: Event, found: str) -> str:
    if event.detail:
        return f"{event.name}: {quoted(event.detail)}"
    if len(found) == 1:
        return f"{event.name} {code_point(found)}"
    shown = "".join(c.translate(PICTURES) for c in found[:MAX_CONTROL_PREVIEW])
    return f"{event.name} {shown}" + "\u2026" * (len(found) > MAX_CONTROL_PREVIEW)


def marks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what to show) in order; where both scanners see something, the invisible character comes first."""
    found = [(e, of_invisible) for e in invisible_events(text)]
    found += [(e, of_control) for e in terminal_events(text) if e.category != "kept"]
    found.sort(key=lambda x: x[0].start)
    return [(e.start, e.end, f"{OPEN}{shown(e, text[e.start : e.end])}{SHUT}") for e, shown in found]


def spelled_out(text: str) -> Iterator[str]:
    """A piece for each mark, empty for a covered one, then the text after the last."""
    at = 0
    for start, end, shown in marks(text):
        if start < at:
            yield ""
        else:
            yield text[at:start].translate(MOVES) + shown
            at = end
    yield text[at:].translate(MOVES)


def units_of(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def visible_text(text: str, limit: int = MAX_PREVIEW) -> str:
    """The preview of a validated text, at most ``limit`` UTF-16 units and a closing remark."""
    *pieces, rest = spelled_out(text)
    kept, size = [], 0
    for piece in pieces:
        if size >= limit:  # more marks come, even if they are covered
            break
        kept.append(piece)
        size += units_of(piece)
    made = "".join(kept)
    if len(kept) == len(pieces):
        made += rest
        if units_of(made) <= limit:
            return made
    return f"{cut_units(made, limit)}\n{OPEN}preview truncated at {limit:,} characters{SHUT}"
