"""Line changes between two versions of a text: a shortest edit script by the greedy O(ND) search, as blocks of lines.

Each diagonal of the search carries its own history as a linked chain, so there is nothing to trace back. A block is
what lies between two kept lines; the number of lines kept before an edit names its block.
"""

from __future__ import annotations

from itertools import groupby
from os.path import commonprefix
from typing import NamedTuple

from cleanspan.functions.catalogue import MAX_CHANGE, MAX_EDITS, MAX_HUNKS

from .scan import clipped


class Block(NamedTuple):
    """Lines ``old[at : at + gone]`` that became ``new[to : to + come]``."""

    at: int
    gone: int
    to: int
    come: int


def shortest_edits(old: list[str], new: list[str], most: int = MAX_EDITS) -> list[tuple[int, bool]] | None:
    """Of each edit, the lines kept before it and whether it adds a line; None if it takes more than ``most`` edits."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(line, len(number)) for line in lines] for lines in (old, new))
    # Diagonal (old line less new line): the furthest old line, and the chain of edits that led there.
    ends: dict[int, tuple[int, tuple | None]] = {0: (len(commonprefix([a, b])), None)}
    for made in range(most + 1):
        for k, (x, chain) in ends.items():
            if x >= len(a) and x - k >= len(b):
                edits = []
                while chain:
                    *edit, chain = chain
                    edits.append(tuple(edit))
                return edits[::-1]
        further = {}
        for k in range(-made - 1, made + 2, 2):
            deleting, adding = ends.get(k - 1, (-1, None)), ends.get(k + 1, (-1, None))
            adds = deleting[0] < adding[0]
            x, chain = adding if adds else deleting
            deleted = (made + k + adds) // 2 if adds else (made + k - 1) // 2
            chain = (x - deleted, adds, chain)
            x += not adds
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            further[k] = (x, chain)
        ends = further
    return None


def blocks_of(edits: list[tuple[int, bool]]) -> list[Block]:
    blocks, gone, come = [], 0, 0
    for kept, group in groupby(edits, key=lambda e: e[0]):
        added = [adds for _, adds in group]
        block = Block(kept + gone, added.count(False), kept + come, added.count(True))
        blocks.append(block)
        gone, come = gone + block.gone, come + block.come
    return blocks


def line_by_line(block: Block) -> list[Block]:
    """A block that has as many lines as before, one line at a time."""
    return [Block(block.at + i, 1, block.to + i, 1) for i in range(block.gone)] if block.gone == block.come else [block]


def describe_changes(before: str, after: str, limit: int = MAX_HUNKS) -> dict:
    """Hunks and how many were left out. Versions too far apart are compared line by line, or as one block."""
    old, new = before.split("\n"), after.split("\n")
    head = len(commonprefix([old, new]))
    old, new = old[head:], new[head:]
    if tail := len(commonprefix([old[::-1], new[::-1]])):
        old, new = old[:-tail], new[:-tail]
    edits = shortest_edits(old, new)
    blocks = [Block(0, len(old), 0, len(new))] if edits is None else blocks_of(edits)
    hunks = [h for block in blocks for h in line_by_line(block) if edits is not None or (h.gone, h.come) != (1, 1) or old[h.at] != new[h.to]]

    def shown(h: Block) -> dict:
        lost, made = ("\n".join(lines) for lines in (old[h.at : h.at + h.gone], new[h.to : h.to + h.come]))
        return {"line": head + h.at + 1, "lines": h.gone, "addedLines": h.come, "before": clipped(lost, MAX_CHANGE), "after": clipped(made, MAX_CHANGE)}

    return {"hunks": [shown(h) for h in hunks[:limit]], "omitted": max(0, len(hunks) - limit)}
