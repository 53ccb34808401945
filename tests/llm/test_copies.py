"""Near copies in blocks, ids that no float holds, and the pipeline's removals on odd rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup, language, near_dedup, packing, page_text, token_files, toxicity

BIG = 9_007_199_254_740_992


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][: 120 - rng.integers(0, 30)], rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])) for k in range(60)]
    seeds = near_dedup._seeds(near_dedup.SIGNATURE, 2)
    rows = pd.DataFrame(
        {
            "node": range(60), "comp": range(60), "hub": -1, "size": [len(s) for s in sets],
            "sig": [near_dedup.low_bits(near_dedup.minima(s, seeds)) for s in sets], "grams": [s.tobytes() for s in sets],
        }
    )
    links = near_dedup.spanning_links(rows, rows, 80)
    every = [(i, j) for i in range(60) for j in range(i) if near_dedup.are_linked(sets[i], sets[j], 80)]

    def groups(pairs):
        comp = list(range(60))
        for i, j in pairs:
            comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
        return comp

    assert groups(links) == groups(every) and len(links) == 60 - len(set(groups(links))) < len(every) / 2


def test_ids_beyond_floats_beside_a_null_id(docs, prose):
    text = prose(1, 80)
    rows = [(BIG + 1, text, "en", "a"), (BIG, prose(2, 80), "en", "a"), (None, text, "en", "a"), (3, text + " end", "en", "a")]
    found = near_dedup.near_duplicates(docs(rows).coalesce(1)).collect()
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in found}
    assert got == {(BIG + 1, 3, False), (BIG, BIG, True), (None, None, True), (3, 3, True)}


@pytest.fixture
def odd(docs):
    """Clashing names, null ids, repeated ids with null and equal texts."""

    def make(rows):
        df = docs(rows)
        for name in ("_id", "_kept_id", "_cuts", "_row", "_copy", "_dropped", "count", "kept"):
            df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


def test_without_copies_on_odd_rows(odd):
    rows = [
        (1, "a b", "en", "s"), (2, "a  b", "en", "s"), (3, None, "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"),
        (5, "x", "en", "s"), (5, "y", "en", "s"), (5, "y ", "en", "s"), (None, "z", "en", "s"), (None, "z", "en", "s"),
        (None, "only", "en", "s"), (BIG + 1, "big", "en", "s"), (BIG, "big", "en", "s"),
    ]
    table = odd(rows)
    out = exact_dedup.without_copies(table)
    assert out.columns == table.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted(
        [(2, "a  b"), (3, None), (5, "x"), (5, "y "), (None, "z"), (None, "only"), (BIG, "big")], key=str
    )
    assert exact_dedup.without_copies(odd([])).collect() == []


def test_without_near_copies_on_odd_rows(odd, prose):
    text = prose(1, 60)
    rows = [(7, text, "en", "s"), (2, text + " more", "en", "s"), (None, text, "en", "s"), (9, None, "en", "s"), (9, None, "en", "s"), (4, "", "en", "s")]
    table = odd(rows)
    out = near_dedup.without_near_copies(table)
    assert out.columns == table.columns
    assert sorted((str(r["doc_id"]) for r in out.collect())) == ["2", "4", "9", "9", "None"]
    assert near_dedup.without_near_copies(odd([])).collect() == []


def test_every_operator_keeps_ids_beyond_floats(spark, docs, prose, tmp_path):
    rows = [(BIG + 1, prose(1, 80), "en", "a"), (BIG, prose(2, 1500), "fr", "a"), (None, prose(3, 30), "en", "a")]
    df, every = docs(rows).coalesce(1), {BIG + 1, BIG, None}
    ids = lambda found: {r["doc_id"] for r in found.select("doc_id").collect()}
    assert ids(packing.pack(df)) == every
    labels = spark.createDataFrame([(BIG + 1, 1), (BIG, 0), (None, 1)], "doc_id long, toxic int")
    assert ids(toxicity.toxicity(df, labels, F.lit(True))) == every
    assert ids(language.identify(df, F.lit(True))) == every
    token_files.write_token_files(df, str(tmp_path / "ids"), parts=2)
    assert ids(token_files.read_token_files(spark, str(tmp_path / "ids"))) == every
    pages = df.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    assert ids(page_text.extract(pages).withColumnRenamed("page_id", "doc_id")) == every


def test_toxicity_sample_is_bounded_by_features_not_length(spark, docs, prose):
    long = prose(7, 20_000)
    rows = [(k, prose(k, 30), "en", "a") for k in range(40)] + [(50, long, "en", "a"), (50, "short", "en", "a")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(50, 1)], "doc_id long, toxic int")
    every, importance = toxicity.training_sample(docs(rows), labels, F.lit(True))
    assert list(every["doc_id"]) == [*range(40), 50] and importance == {0: 1.0, 1: 1.0}
    assert len(long) > 100_000
    some, importance = toxicity.training_sample(docs(rows), labels, F.lit(True), max_features=600)
    sizes = some["found"].map(len).groupby(some["toxic"]).sum() // 4
    assert 300 < sizes[0] <= 600 and sizes[1] <= 600 and importance[0] > 1
    assert set(some["doc_id"]) <= set(every["doc_id"])
