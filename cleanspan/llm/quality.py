"""Quality rules by distribution divergence.

Each document yields two histograms: shares of character classes, and shares of a language's common
words among its words. Each is compared with the reference of its language by Jensen-Shannon distance
(base 2, in [0, 1]). References are per-bin medians over the distinct texts that pass the base rules, one per known
language and one for all other languages: junk of less than half of a language's texts, and copies of any number, leave
them nearly where they are. A known language of few texts uses fixed references. They are a table of
``len(languages) + 1`` rows however large the corpus. A distance only counts where the text is long enough for its
histogram to mean something.

Defined results: a null text counts as empty and fails the base rules; a null or unknown language uses
the reference for other languages; a text of any length is read whole; repeated rows are judged alike, and there are no ties to
break; an empty table gives an empty table; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, stored, text_of, words_of

# Frequent function words of four languages, by public stop-word lists.
COMMON_WORDS = {
    "de": "der die und das von zu mit den ist im sich des auf für als".split(),
    "en": "the of and to in is on for that it with be by this are".split(),
    "es": "de la que el en y los se del las un por con una para".split(),
    "fr": "de la le et les des en un du une que est pour qui dans".split(),
}
#: For any other language: the first words of each list.
COMMON_WORDS_OTHER = sorted({w for words in COMMON_WORDS.values() for w in words[:4]})

#: Character classes, taken off the text one after the other; what is left is the last class.
CLASSES = {
    "lower": r"\p{Ll}+",
    "space": r"[\x20\x09-\x0D]+",
    "upper": r"\p{Lu}+",
    "symbol": r"[#*$%&|<>]+",
    "punctuation": r"[\p{P}]+",
    "digit": r"\p{Nd}+",
}

MIN_CHARS = 100
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.35
#: Of both together, for texts that are somewhat off in either way.
MAX_SUM = 0.44
WINDOW = 8
#: Shares are rounded to this part for the medians, so that these are counts of few values and exact in any order of rows.
STEPS = 4096
#: Fewer distinct texts of a known language are too few for its medians.
MIN_REFERENCE = 30
#: For those: medians of the distinct base-passing texts of sf0.1, classes and then common words.
FIXED_REFERENCES = {
    "de": (
        [0.8108, 0.1548, 0.0128, 0.0, 0.0216, 0.0, 0.0],
        [0.0486, 0.0247, 0.0199, 0.0077, 0.0099, 0.008, 0.0061, 0.0122, 0.0037, 0.0036, 0.006, 0.0049, 0.0049, 0.0048, 0.002, 0.8332],
    ),
    "en": (
        [0.7954, 0.1669, 0.0139, 0.0, 0.0238, 0.0, 0.0],
        [0.0491, 0.0251, 0.0203, 0.0149, 0.0098, 0.0086, 0.005, 0.0059, 0.0077, 0.0062, 0.0043, 0.0035, 0.0031, 0.0029, 0.0032, 0.8304],
    ),
    "es": (
        [0.8016, 0.1618, 0.0135, 0.0, 0.023, 0.0, 0.0],
        [0.05, 0.025, 0.0191, 0.0137, 0.0118, 0.0097, 0.0084, 0.007, 0.0056, 0.0064, 0.0052, 0.005, 0.0047, 0.0036, 0.0032, 0.8214],
    ),
    "fr": (
        [0.7952, 0.1668, 0.0141, 0.0, 0.0239, 0.0, 0.0],
        [0.0493, 0.0262, 0.0193, 0.0138, 0.0116, 0.0103, 0.0089, 0.0078, 0.0065, 0.0057, 0.0051, 0.0045, 0.0047, 0.0037, 0.0037, 0.8191],
    ),
}

References = dict[str, tuple[list[float], list[float]]]


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text, each word counted once.

    Windows are told apart by 64-bit hashes; texts without a repeated hash skip the sort.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(
                F.transform(
                    s, lambda x, k: F.when(_same(F.get(s, k - 1)["h"], x["h"]) | _same(F.get(s, k + 1)["h"], x["h"]), x["i"])
                ),
                lambda i: i.isNotNull(),
            ),
        )
        steps = let(
            F.sort_array(twice),
            lambda at: F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    hashes = doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(
        let(
            F.slice(hashes, F.lit(1), n - (WINDOW - 1)),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )
    )


def word_features(text: Column, lang: Column) -> Column:
    """Struct of the base counts of a non-null text and its ``word_count``, from one split into words."""

    def counts(words: Column, lines: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words, n).alias("n_repeat_words"),
            word_counts(words, lang).alias("word_count"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    return let(words_of(text), lambda words: let(lines, lambda x: counts(words, x)))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (n_repeat_words * 100 > n_words * 30)


def class_counts(text: Column) -> Column:
    """Characters of each class, in the order of CLASSES, then all others."""

    def taken(rest: Column, names: list[str], got: list[Column]) -> Column:
        if not names:
            return F.array(*got, F.char_length(rest))
        return let(
            F.regexp_replace(rest, CLASSES[names[0]], ""),
            lambda left: taken(left, names[1:], [*got, F.char_length(rest) - F.char_length(left)]),
        )

    return taken(text, list(CLASSES), [])


def known_language(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(F.lit("other"))


def word_counts(words: Column, lang: Column) -> Column:
    """Words that are exactly a common word of the language, for each of those, then all other words."""
    lists = F.create_map(*[F.lit(x) for k, v in {**COMMON_WORDS, "other": COMMON_WORDS_OTHER}.items() for x in (k, v)])

    def counted(known: Column) -> Column:
        return let(
            F.filter(words, lambda w: F.array_contains(known, w)),
            lambda f: F.array_append(F.transform(known, lambda k: F.size(F.filter(f, lambda w: w == k))), F.size(words) - F.size(f)),
        )

    return let(F.element_at(lists, lang), counted)


def shares(counts: Column) -> Column:
    """Counts over their sum; null where the sum is 0."""
    return let(
        F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x),
        lambda total: F.when(total > 0, F.transform(counts, lambda x: x / total)),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of one length; null if either is null."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log(x * 2 / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.when(total < 0, F.lit(0.0)).otherwise(total) / (2 * math.log(2)))


def with_features(df: DataFrame) -> DataFrame:
    """Adds ``q_lang``, ``text_hash``, ``n_text_chars``, ``class_count`` and ``q_words`` (of :func:`word_features`)."""
    t = text_of("text")
    language = known_language(F.col("lang"))
    return df.withColumns(
        {
            "q_lang": language,
            "text_hash": F.xxhash64(t),
            "n_text_chars": F.char_length(t).cast("long"),
            "class_count": class_counts(t),
            "q_words": word_features(t, language),
        }
    )


def references(featured: DataFrame) -> References:
    """Median class and word shares of each language over its distinct texts that pass the base rules and are long
    enough to have them, brought to a sum of 1; the fixed ones for a known language of few such texts.

    The medians are taken from counts of rounded shares: at most ``STEPS + 1`` rows for each bin of a language.
    """

    def steps(counts: Column) -> Column:
        return F.transform(shares(counts), lambda x: F.round(x * STEPS).cast("int"))

    # No row is filtered before it is counted, as a filter would evaluate the features at each mention: texts that do
    # not count have null steps, and a null bin.
    counted = (F.col("n_text_chars") >= MIN_CHARS) & ~base_failed(F.col("q_words.n_words"), F.col("q_words.n_repeat_words"))
    both = F.concat(steps(F.col("class_count")), steps(F.col("q_words.word_count")))
    texts = featured.select("q_lang", "text_hash", F.when(counted, both).alias("steps")).distinct()
    counts = texts.select("q_lang", F.posexplode_outer("steps").alias("bin", "step")).groupBy("q_lang", "bin", "step").agg(F.count("*").alias("n"))
    each = Window.partitionBy("q_lang", "bin")
    ranked = counts.withColumns({"upto": F.sum("n").over(each.orderBy("step")), "texts": F.sum("n").over(each)})
    middle = [F.min(F.when(at, F.col("step"))) for at in (F.col("upto") * 2 >= F.col("texts"), F.col("upto") * 2 > F.col("texts"))]
    rows = ranked.groupBy("q_lang", "bin").agg(((middle[0] + middle[1]) / 2).alias("median"), F.first("texts").alias("texts")).collect()
    medians, found = defaultdict(list), dict(FIXED_REFERENCES)
    for r in sorted((r for r in rows if r.bin is not None), key=lambda r: (r.q_lang, r.bin)):
        if r.texts >= MIN_REFERENCE or r.q_lang not in FIXED_REFERENCES:
            medians[r.q_lang].append(r.median)
    for lang, m in medians.items():
        parts = m[: len(CLASSES) + 1], m[len(CLASSES) + 1 :]
        if all(map(sum, parts)):
            found[lang] = tuple([x / sum(part) for x in part] for part in parts)
        else:
            found.pop(lang, None)
    return found


def distances(q_lang: Column, n_chars: Column, class_count: Column, word_count: Column, refs: References) -> Column:
    """Struct of ``class_distance`` and ``word_distance``, null where the text is too short for the histogram."""
    none = F.lit(None).cast("double")
    if not refs:
        return F.struct(none.alias("class_distance"), none.alias("word_distance"))

    def table(k: int) -> Column:
        return F.create_map(*[x for lang, v in sorted(refs.items()) for x in (F.lit(lang), F.array(*map(F.lit, v[k])).cast("array<double>"))])

    words = F.aggregate(word_count, F.lit(0), lambda a, x: a + x)
    return F.struct(
        F.when(n_chars >= MIN_CHARS, js_distance(shares(class_count), F.element_at(table(0), q_lang))).alias("class_distance"),
        F.when(words >= MIN_WORDS, js_distance(shares(word_count), F.element_at(table(1), q_lang))).alias("word_distance"),
    )


def diverges(distance: Column) -> Column:
    """The method's verdict on :func:`distances`: true if a histogram, or both together, are too far off."""
    c, w = F.coalesce(distance["class_distance"], F.lit(0.0)), F.coalesce(distance["word_distance"], F.lit(0.0))
    return (c > MAX_CLASS_DISTANCE) | (w > MAX_WORD_DISTANCE) | (c + w > MAX_SUM)


def assess(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts, ``base_failed``, ``kept`` and both distances.

    The features of all rows are written once, without the texts; references and verdicts come from them.
    """
    features = stored(with_features(documents.select("doc_id", "text", "lang")).drop("text", "lang"), "quality")
    distance = distances(F.col("q_lang"), F.col("n_text_chars"), F.col("class_count"), F.col("q_words.word_count"), references(features))
    failed = base_failed(F.col("q_words.n_words"), F.col("q_words.n_repeat_words"))
    return features.withColumn("distance", distance).select(
        "doc_id",
        "q_words.n_words",
        "q_words.word_chars",
        F.get("class_count", F.lit(list(CLASSES).index("symbol"))).cast("long").alias("n_symbols"),
        "q_words.n_dup_lines",
        "q_words.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~diverges(F.col("distance"))).alias("kept"),
        "distance.class_distance",
        "distance.word_distance",
    )


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. References come from a first pass over all rows.

    The verdict is one expression with every part bound, as a filter would evaluate a feature at each mention.
    """
    refs = references(with_features(documents.select("text", "lang")))
    t, language = text_of("text"), known_language(F.col("lang"))

    def good(words: Column, classes: Column) -> Column:
        found = distances(language, F.char_length(t), classes, words["word_count"], refs)
        return let(found, lambda d: ~base_failed(words["n_words"], words["n_repeat_words"]) & ~diverges(d))

    return documents.where(let(word_features(t, language), lambda w: let(class_counts(t), lambda c: good(w, c))))
