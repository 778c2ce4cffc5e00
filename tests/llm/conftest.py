import random

import pytest

WORDS = [a + b for a in "ba ke li mo nu pa ri so tu ve".split() for b in "nd rk st lm n x ss t".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = r.choice(WORDS) + r.choice(["", "a", "o"])
        out.append(w.capitalize() if k % 9 == 0 else w)
        if k % 9 == 8:
            out[-1] += "." if k % 27 else ".\n"
    return " ".join(out)


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard string, kept int, class_id string, "
          "n_words string, target string, host string, labels string, node string, t string, rk string")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    a, b = prose(1, 120), prose(2, 90)
    rows = [
        (1, a, "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (None, b, "de", None), (None, None, None, None),
        (4, prose(3, 30_000), "en", "s1"), (5, a, "en", "s2"), (6, a + " extra", "en", "s2"), (7, b, None, "s1"), (7, b, None, "s1"),
        (8, " \t\n ", "de", "s3"), (9, "?", "de", "s3"), (10, "one", "fr", "s3"), (11, prose(4, 60), "fr", "s\U0001F600"),
        (12, prose(5, 70).upper(), "fr", "￮"), (13, "été " * 80, "fr", "s3"), (14, "x" * 100_000, "en", "s3"),
        (15, "1" * 50_000 + "@", "en", "s3"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, 0, 7, "x", 1, "c", "n", "g", "h", "l", "o", "t", "r") for r in odd_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
