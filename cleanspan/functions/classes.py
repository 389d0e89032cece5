"""Character classes that mean the same in Python's and in Java's regular expressions: literal ranges."""

from __future__ import annotations

from functools import cache

from .catalogue import FORMAT_RANGES, JOINING_SCRIPTS, UNLISTED_FORMAT, members

#: White space in the sense of the rules: no U+0085, but U+FEFF.
SPACE_CHARACTERS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = SPACE_CHARACTERS
SELECTORS = "\ufe00-\ufe0f\U000e0100-\U000e01ef"
TAG_START = "\U000e0001\U000e0020-\U000e007f"
TAGS = "\U000e0000-\U000e007f"
FLAG = "\U0001f3f4"


def ranges(pairs) -> str:
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in pairs)


FORMAT = ranges(FORMAT_RANGES)
CONTROL = "\\x00-\\x1f\\x7f-\\x9f"
#: Removed wherever they stand: the category invisible and format characters without a name.
ALWAYS_INVISIBLE = members("invisible") + ranges(UNLISTED_FORMAT)


@cache
def property_class(pattern: str) -> str:
    """The code points that a Unicode property pattern matches, as literal ranges for a class."""
    import regex

    every = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF)
    runs = regex.finditer(f"(?:{pattern})+", every)
    pairs = [(m.start(), m.end() - 1) for m in runs]
    return "".join(_range(every[a], every[b]) for a, b in pairs)


def _range(a: str, b: str) -> str:
    # A run may lead over the surrogates, which no text has.
    return ("\\" if a in "#*-[]^&" else "") + a + (f"-{b}" if b > a else "")


def pictographic() -> str:
    return property_class(r"\p{Extended_Pictographic}")


def before_joiner() -> str:
    return property_class(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\ufe0f\u20e3]")


def joining_script() -> str:
    return property_class("[" + "".join(rf"\p{{scx={s}}}" for s in JOINING_SCRIPTS) + "]")
