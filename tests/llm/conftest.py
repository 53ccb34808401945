from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table like ``documents`` with columns whose names the operators use inside."""

    def make(rows, extra=True):
        full = [(i, t, l, s, len(t or "")) for i, t, l, s in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for name in ("size", "node", "key", "hash", "slot", "copies", "part", "at", "_key"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture
def prose():
    """Seeded invented words; no word list is needed."""

    def make(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(words))

    return make


@pytest.fixture
def odd_rows(prose):
    """Nulls, empty and repeated rows, ties and a very long text."""
    long = prose(1, 30_000)
    return [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \n\t ", "en", "a"),
        (4, "one", "fr", None),
        (5, prose(2, 300), "en", "a"),
        (5, prose(2, 300), "en", "a"),
        (6, prose(2, 300) + " ", "en", "b"),
        (7, long, "fr", "b"),
        (8, "12 34 -- ..", None, "b"),
        (None, prose(3, 40), "fr", "b"),
    ]
