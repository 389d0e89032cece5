import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, slot string, row string, copy string"


def sentence(rng, n):
    words = "the of and to in is on for that it house tree river stone light green walks under over never again some more".split()
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(20, 120)), rng.choice(["en", "de", "xx", None]), rng.choice(["a", "b", "c", "", None]), 1) for i in range(60)]
    rows += [rows[3], rows[3], rows[7]]
    rows += [(100 + i, rows[5][1], "en", "a", None) for i in range(12)]
    rows += [(None, rows[8][1], None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(200, None, "en", "b", 0), (201, "", "en", "b", 0), (202, " \t\n\r\x0b\x0c ", "fr", "c", 3), (203, "one", "en", None, 3), (204, "$$$ ### |||", "de", "a", 9)]
    rows += [(205, "naïve café 中文 \U0001f600́ \x00 \x1c     I'll DON'T <|endoftext|>", "fr", "a", 9)]
    rows += [(206, sentence(rng, 40_000), "en", "c", 9), (207, "x" * 200_000, "en", "b", 9), (208, sentence(rng, 9) + "\n" + (sentence(rng, 9) + "\n") * 40, "en", "b", 9)]
    return [(*r, "s", "z", "t", "r", "c") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
