"""Filter audit against a plain count of every order and step."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tallyspark.llm.filter_audit import AUDIT, WideCounters, filter_audit, text_failures

LABELS = "doc_id long, quality int, toxic int, source string"


def failures(text):
    """Bits of A to D by the letter of the conditions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    a = len(words) < 200
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)
    d = re.search(r"[#$%&*|]", text) is not None
    return a | b << 1 | c << 2 | d << 3


def brute(rows, labels):
    """{(part, order, step): outcomes} by walking every document through every order."""
    docs = []
    for i, text, _, source in rows:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _, _ in rows)
        good = any(i is not None and l[0] == i and l[1] == 1 for l in labels)
        toxic = any(i is not None and l[0] == i and l[2] == 1 for l in labels)
        fails = {x for k, x in enumerate("ABCD") if failures(text) >> k & 1} | ({"E"} if copy else set())
        docs.append((source or "", fails, good, toxic))
    out, share = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            here = [d[1:] for d in docs if d[0] == part]
            everyone = here
            for step, x in enumerate(order, 1):
                hit = [d for d in here if x in d[0]]
                here = [d for d in here if x not in d[0]]
                share[part, x] += len(hit)
                out[part, order, step] = (
                    len(here),
                    len(hit),
                    sum(x in d[0] for d in everyone) - len(hit),
                    sum(d[0] == {x} for d in everyone),
                    sum(d[1] for d in hit),
                    sum(d[2] for d in hit),
                )
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def answer(df):
    columns = [c.split()[0] for c in AUDIT.split(", ")]
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.select(*columns).collect()}


def test_random_documents(spark, docs, prose):
    rng = random.Random(7)
    pool = [prose(k, rng.choice([3, 150, 250])) for k in range(12)]
    pool += [t + " $5" for t in pool[:3]] + [pool[0].upper(), pool[1] + " " + "word " * 300, "", None, "É É é"]
    rows = [(i, rng.choice(pool), "en", rng.choice(["a", "b", "", None])) for i in range(120)]
    labels = [(rng.randrange(130), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(90)]
    got = answer(filter_audit(docs(rows).repartition(5), spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)


def test_odd_rows(spark, docs, odd_rows):
    big = 9_007_199_254_740_992
    rows = [*odd_rows, (None, None, None, None), (None, "", None, "a"), (big, "same", "", "c"), (big + 1, "same", "", "c")]
    labels = [(None, 1, 1, "x"), (big + 1, 1, 0, "x"), (5, None, 1, "x"), (5, 1, None, "x")]
    got = answer(filter_audit(docs(rows), spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit(docs([]), none).collect() == []
    assert len(filter_audit(docs([(1, "x", "en", "a")]), none).collect()) == 600


def test_fields_do_not_overflow():
    wide = WideCounters()
    many = (1 << 62) - 1
    out = wide.outcomes("a", [0b0000011, 0b1111111], [many, many])
    first = out[(out["filter_order"] == "ABCDE") & (out["step"] == 1)].iloc[0]
    assert first["removed"] == 2 * many and first["kept"] == 0 and first["toxic_lost"] == many
    with pytest.raises(OverflowError):
        wide.outcomes("a", [0, 1], [1 << 62, 1 << 62])


@pytest.mark.parametrize("text", ["", " ", "a b A", "\x1c\x85 x", "AB " * 100, "é" * 99 + "A", "é" * 49 + "A", "a|b"])
def test_conditions_on_bytes(text):
    assert text_failures(text.encode()) == failures(text)
