"""Word-cached encoding with the tokenizers library.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words one after
the other. Each worker keeps the ids of words that it has met, as little-endian unsigned 32-bit bytes; a
text is then one join of cached pieces. The cache is bounded: when it is full its words become the old generation, of
which those that come again are taken over. Whole columns are parted by Arrow, and each distinct run of letters or
other word of some megabytes of text is looked up once.

Most words are a run of letters and perhaps a run of punctuation. The tokenizer's own pattern parts the two, and
its normalizer only lower-cases them, so the letters go straight to the library's model; all other words go
through the whole library. Tests hold the two ways against each other.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import unicodedata

import numpy as np

#: Words of a generation of the cache, of which there are two.
CACHE_WORDS = 700_000
#: Bytes of text whose words are numbered together when a column is encoded.
COLUMN_BYTES = 4 << 20
#: New runs of letters that the library's model is given at once.
MODEL_RUNS = 20_000
#: ASCII punctuation but for the apostrophe, which starts pieces of its own.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of ASCII letters and of the code points below U+0580: Latin, Greek, Cyrillic, Armenian.
LETTERS = re.compile(rb"[A-Za-z\x80-\xd5]+")
#: Latin letters, each of which is composed and has one lower-case letter of its own.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+$"
_held: dict[str, WordEncoder] = {}


def byte_letters() -> list[str]:
    """The character that byte-level models use for each byte: printable Latin-1 as itself, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Words(dict):
    """Ids of words; learns those that it misses."""

    def __init__(self, learn, limit: int):
        super().__init__()
        self.learn, self.limit, self.old = learn, limit, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.learn(word)
        self.keep(word, ids)
        return ids

    def keep(self, word: bytes, ids: bytes) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids


class WordEncoder:
    """``encode(text)`` gives the ids of a text, a string or its UTF-8 bytes, as bytes, four to an id."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Words(self.learn, limit)
        # The model alone, for words between spaces, and which ids end a word.
        self.between = "".join(self.letters[:32] + [" "] + self.letters[33:])
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, names = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends = None
        if suffix:
            self.ends = np.zeros(1 + max(names.values()), bool)
            self.ends[[i for name, i in names.items() if name.endswith(suffix)]] = True

    def learn(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            lower = stem.lower()
        elif LETTERS.fullmatch(stem):
            lower = lowered(stem)
        else:
            lower = None
        if lower is None:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        known = self.words.get(lower)
        if known is None:
            text = lower.decode() if lower.isascii() else "".join(map(self.letters.__getitem__, lower))
            known = b"".join([self.packed[t.id] for t in self.tokenize(text)])
            if len(word) != len(lower):
                self.words[lower] = known
        return known if len(stem) == len(word) else known + self.words[word[len(stem) :]]

    def encode(self, text: str | bytes | None) -> bytes:
        if not text:
            return b""
        raw = text if isinstance(text, bytes) else text.encode()
        return b"".join(map(self.words.__getitem__, raw.split()))

    def encode_column(self, column, most: int = COLUMN_BYTES):
        """The ids of an Arrow string column, as (ids of some texts one after the other, number of ids of each) for texts of
        together about ``most`` bytes; a null text has none."""
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield self._encode_texts(column.slice(at, stop - at))
            at, done = stop, int(ends[stop - 1])

    def _encode_texts(self, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        parted = pc.ascii_split_whitespace(texts)  # the same white space as that of bytes.split
        bounds = np.cumsum(pc.fill_null(pc.list_value_length(parted), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        coded = parted.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_string())
        # Plain letters with marks after them become two parts, as in learn; every other word is one, with an empty one after it.
        plain = pc.match_substring_regex(pc.ascii_rtrim(words, MARKS.decode()), PLAIN)
        words = pc.if_else(plain, pc.utf8_lower(words), words)
        stems = pc.if_else(plain, pc.ascii_rtrim(words, MARKS.decode()), words)
        _, offsets, data = words.buffers()
        if not len(words) or data is None:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        cuts = np.repeat(np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset), 2)[:-1]
        cuts[1::2] += pc.binary_length(stems).to_numpy(zero_copy_only=False)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(words), [None, pa.py_buffer(cuts), data]).dictionary_encode()
        letters = np.zeros(len(parts.dictionary), bool)
        letters[parts.indices.to_numpy()[::2][plain.to_numpy(zero_copy_only=False)]] = True
        known = pa.array(self.known(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), letters.tolist()), pa.large_binary()).take(parts.indices)
        _, offsets, data = known.buffers()
        if data is None:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        whole = np.frombuffer(offsets, np.int64, len(known) + 1, 8 * known.offset)[::2].copy()
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(whole), data]).take(coded.indices)
        _, offsets, data = pieces.buffers()
        starts = np.frombuffer(offsets, np.int64, len(pieces) + 1, 8 * pieces.offset)
        ids = np.frombuffer(data, "<u4", int(starts[-1]) // 4) if data is not None else np.zeros(0, "<u4")
        return ids, np.diff(starts[bounds], prepend=0) // 4

    def known(self, parts: list[bytes], letters: list[bool]) -> list[bytes]:
        """Ids of distinct words, some of which are known to be plain letters in lower case: the new ones of these go to the
        model many at a time."""
        words, found = self.words, list(map(self.words.get, parts))
        if self.ends is not None:
            new = [k for k, ids in enumerate(found) if ids is None and letters[k] and parts[k] not in words.old]
            for some in (new[k : k + MODEL_RUNS] for k in range(0, len(new), MODEL_RUNS)):
                text = codecs.charmap_decode(b" ".join([parts[k] for k in some]), "strict", self.between)[0]
                ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(some):  # else learn has them one by one
                    raw, at = ids.tobytes(), 0
                    for k, stop in zip(some, (4 * stops).tolist(), strict=True):
                        found[k] = raw[at:stop]
                        words.keep(parts[k], found[k])
                        at = stop
        return [words[parts[k]] if ids is None else ids for k, ids in enumerate(found)]


def lowered(letters: bytes) -> bytes | None:
    """A run of letters in UTF-8 in lower case; None if it is not made of composed letters only, or if its case is not plain."""
    text = letters.decode()
    if not text.isalpha() or not unicodedata.is_normalized("NFC", text):
        return None
    # The library goes letter by letter; so does Python but for a sigma at a word's end.
    lower = text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))
    return lower.encode() if lower.isalpha() else None


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def raw_texts(column):
    """UTF-8 bytes of an Arrow string column one by one, None for null, without a decoded copy."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None
