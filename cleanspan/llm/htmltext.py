"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. Pass one classes each block by its stop-word density, length
and link density as good, bad, near-good or short; in pass two the undecided blocks inherit from the nearest decided ones
before and after them: one label on both sides is theirs, of different ones near-good takes good, a heading what follows it,
and a short block the nearer one. Blocks in an article or main element have neighbours there only, and lie between good ones
at its edges. What page markup itself names as not content (navigation, header, footer, aside,
forms, dialogs, scripts, styles; classes or ids for adverts, menus, notices, sidebars, comments) is bad from the
start. A name that only has such a word in it (``no-sidebar``) counts if no article, main or good block lies inside.

Defined results: a null or empty page has the empty text; a page of any length is read whole; unclosed tags and markup cut off
at the end of the page are read as far as they go; ties between two labels are settled as above; repeated rows are treated
alike; further columns stay as they are but for text and n_chars, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages, by public stop-word lists.
STOP_WORDS = frozenset(
    (
        "a an and are as at be by for from has have in is it its not of on or that the this to was were with you "
        "aber als am auf aus bei das dem den der des die ein eine einer es für im in ist mit nicht sich sie und von war zu "
        "al como con de del el en es la las lo los más no para pero por que se su un una y "
        "au aux avec ce dans de des du elle en est et il la le les ne ou par pas plus pour que qui sur un une"
    ).split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never counts, however the rules class it.
NEVER = frozenset("script style template noscript head title svg canvas iframe object video audio select textarea button".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog search".split())
#: A class or id that is one of these words marks its element as boilerplate; one that has the word in it does so in doubt.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu nav navbar navigation newsletter notice pager pagination popup promo promoted related share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

MAX_LINK_DENSITY = 0.2
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
#: Blocks apart that a heading may lie from the good block that it heads.
HEADING_REACH = 3
DECIDED = ("good", "bad")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
#: A slash at the end of a tag that is no part of a value without quotes.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
PARTIAL = re.compile(r"<[!/?a-zA-Z][^<>]*\Z")
WORD = re.compile(r"\w+")


class Doubt:
    """An element that is boilerplate unless content is found in it; content in it is content in its parents too."""

    __slots__ = ("parent", "cleared")

    def __init__(self, parent: Doubt | None):
        self.parent, self.cleared = parent, False


def clear(doubt: Doubt | None) -> None:
    while doubt and not doubt.cleared:
        doubt.cleared = True
        doubt = doubt.parent


class Block:
    __slots__ = ("parts", "linked", "marked", "doubt", "content", "heading", "label")

    def __init__(self, marked: bool, doubt: Doubt | None, content: bool, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.marked, self.doubt, self.content, self.heading = marked, doubt, content, heading
        self.label = ""


def _boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the element is boilerplate, and whether it is so in doubt."""
    if tag in BOILERPLATE_TAGS:
        return True, False
    doubtful = False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        value = (m[2] or "").strip("\"'").lower()
        name = m[1].lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main"):
                if not BOILERPLATE_WORDS.isdisjoint(value.split()):
                    return True, False
                doubtful |= not BOILERPLATE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value))
        elif name == "role":
            if value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"):
                return True, False
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
    return False, doubtful


def blocks_of(page: str) -> list[tuple[Block, str]]:
    """The page's blocks that have text, with it: white space evened, character references decoded."""
    out: list[tuple[Block, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate, never, in doubt
    marked = never = links = content = 0
    doubt: Doubt | None = None
    block = Block(False, None, False, False)

    def close() -> None:
        nonlocal block
        if block.parts and (text := " ".join("".join(block.parts).split())):
            out.append((block, text))
        heading = any(t in HEADINGS for t, *_ in stack[-3:])
        block = Block(marked > 0, doubt, content > 0, heading)

    def add(text: str) -> None:
        if text and not never:
            text = html.unescape(text)
            block.parts.append(text)
            if links:
                block.linked += len("".join(text.split()))

    def pop(tag: str) -> None:
        nonlocal marked, never, links, content, doubt
        # An end tag closes what is open inside its element; without such an element it closes nothing.
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                for t, m, n, d in stack[i:]:
                    doubt = doubt.parent if d else doubt
                    marked -= m
                    never -= n
                    links -= t == "a"
                    content -= t in CONTENT_TAGS
                del stack[i:]
                return

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            rest = page[at:]
            add(rest[: p.start()] if (p := PARTIAL.search(rest)) else rest)
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                pop(tag)
                close()
            else:
                pop(tag)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                close()
            continue
        if m[3].endswith("/") and tag not in BLOCK_TAGS and SELF_CLOSED.search(m[3]):
            continue  # as in <svg/>; elements of HTML are open whatever stands at the end of their tag
        if tag == "p" or tag == "li" or tag in ("dd", "dt", "td", "th", "tr", "option"):
            # These end where the next of their kind begins, within the nearest other block.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for t, mk, n, d in stack[i:]:
                        doubt = doubt.parent if d else doubt
                        marked -= mk
                        never -= n
                        links -= t == "a"
                        content -= t in CONTENT_TAGS
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        (is_marked, doubtful), is_never = _boilerplate(tag, m[3]), tag in NEVER
        stack.append((tag, is_marked, is_never, doubtful))
        if doubtful:
            doubt = Doubt(doubt)
        if tag in CONTENT_TAGS and not marked and not is_marked:
            clear(doubt)
        marked += is_marked
        never += is_never
        links += tag == "a"
        content += tag in CONTENT_TAGS
        if tag in BLOCK_TAGS:
            close()
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
    close()
    return out


def first_pass(block: Block, text: str) -> str:
    """good, bad, near or short."""
    if block.marked:
        return "bad"
    length = len(text)
    if block.linked / length > MAX_LINK_DENSITY:
        return "bad"
    if length < LENGTH_LOW:
        return "short"
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= STOP_HIGH and length > LENGTH_HIGH:
        return "good"
    # Inside the element that the page names as its content, blocks of few stop words are left to their neighbours.
    return "near" if density >= STOP_LOW or block.content else "bad"


def nearest(labels: list[str], regions: list[int], step: int, edges: dict[int, str]) -> list[tuple[int, str]]:
    """Of each block the nearest decided one before it (or after it, for a step of -1): how many blocks away, and its label.

    Neighbours are sought in the block's own region; where that ends, it is the label of its edge.
    """
    order = range(len(labels)) if step == 1 else range(len(labels) - 1, -1, -1)
    out: list[tuple[int, str]] = [(0, "")] * len(labels)
    last: dict[int, tuple[int, str]] = {}  # of each region: how many of its blocks ago, label
    for i in order:
        away, label = last.get(regions[i], (0, edges[regions[i]]))
        out[i] = (away + 1, label)
        last[regions[i]] = (0, labels[i]) if labels[i] in DECIDED else (away + 1, label)
    return out


def second_pass(blocks: list[tuple[Block, str]]) -> None:
    """Undecided blocks inherit from the nearest decided ones before and after them, each from its own region: the page,
    or the page's content elements. What lies past the page's edges counts as bad, past the content's as good."""
    first = [b.label for b, _ in blocks]
    regions, edges = [int(b.content) for b, _ in blocks], {0: "bad", 1: "good"}
    # Boilerplate inside the content says nothing about the blocks beside it.
    seen = ["" if b.content and b.marked else label for (b, _), label in zip(blocks, first, strict=True)]
    before, after = nearest(seen, regions, 1, edges), nearest(seen, regions, -1, edges)
    for i, (block, _) in enumerate(blocks):
        if first[i] in DECIDED:
            continue
        (back, left), (ahead, right) = before[i], after[i]
        if left == right:
            block.label = left
        elif block.content or first[i] == "near":
            block.label = "good"
        elif block.heading:  # it belongs to what comes next
            block.label = right if ahead <= HEADING_REACH else "bad"
        else:
            block.label = "bad" if back == ahead else left if back < ahead else right


def main_text(page: str | None) -> str:
    """The good blocks in page order, two line feeds between them."""
    blocks = blocks_of(page or "")
    for block, text in blocks:
        block.label = first_pass(block, text)
        if block.label == "good":
            clear(block.doubt)
    for block, _ in blocks:
        if block.doubt and not block.doubt.cleared:
            block.label = "bad"
    second_pass(blocks)
    return "\n\n".join(text for block, text in blocks if block.label == "good")


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to the pages; columns of these names are replaced, the page is dropped."""
    kept = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(list(kept)).add("text", StringType()).add("n_chars", LongType())
    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(column)).mapInArrow(read, schema)
