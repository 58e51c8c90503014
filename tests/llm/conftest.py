from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, t int, id string, h long, kept string, n_words string, _k string"


def make(spark, rows):
    """Documents with clashing extra columns."""
    full = [(i, x, "en", s, None if x is None else len(x), "r", 1, "x", 2, "k", "w", None) for i, x, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, blanks, short and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["the", "cat", "sat", "on", "Mat", "é", "x1", "und", "dog."]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))

    passage = prose(60)
    base = prose(80).split()
    near = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in (3, 40, 77)]
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "a"), (5, "one two", "a"), (6, prose(50), "a"),
        (7, prose(30) + " " + passage + "\n" + prose(30), "a"), (8, passage, "b"), (8, passage, "b"), (9, prose(10) + "\n" + passage, None),
        (10, " ".join(base), "a"), (11, near[0], "a"), (12, near[1], "b"), (13, near[2], "b"), (14, " ".join(base), "b"),
        (None, passage, "a"), (None, None, None), (15, prose(20_000), "c"), (16, "x" * 60_000, "c"), (17, "line\nline\nline\n" * 40, "c"),
        (18, "ab " * 300, "c"), (19, "aaaa" * 100, "c"), (20, "aaaa" * 100, "c"), (21, prose(40) + " " + prose(1) * 3, None),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
