"""Packing by patterns: plans of histograms, and whole tables against the tokenizer itself."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyspark.llm.packing import best_fit as best_fit_one_by_one
from tallyspark.llm.pattern_packing import Places, best_fit, cut, fitted, pack_by_patterns, patterns, plan
from tallyspark.llm.tokens import vocabulary_path


def windows_of(counts, size):
    """Every piece as (sequence, offset, length) by the plan."""
    places = Places(plan(counts, size), size)
    out = []
    for n in np.flatnonzero(counts).tolist():
        ranks = np.arange(counts[n])
        sequence, offset = places.of(np.full(len(ranks), n), ranks)
        out += zip(sequence.tolist(), offset.tolist(), [n] * len(ranks))
    return sorted(out)


def sound(placed, size):
    """The number of windows, after a check that each is filled from 0 without gaps."""
    end = {}
    for sequence, offset, length in placed:
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert all(n <= size for n in end.values())
    return len(end)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, dtype=int), minlength=33)
    placed = windows_of(counts, 32)
    assert sorted(n for _, _, n in placed) == sorted(lengths)
    used = sound(placed, 32)
    one_by_one = len(set(best_fit_one_by_one(sorted(lengths, reverse=True), 32)[0]))
    assert -(-sum(lengths) // 32) <= used <= one_by_one * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_best_fit_of_counts_is_best_fit_of_pieces(lengths):
    counts = np.bincount(np.array(lengths, dtype=int), minlength=21)
    together = sum(many for _, many in best_fit(counts, 20))
    assert together == len(set(best_fit_one_by_one(sorted(lengths, reverse=True), 20)[0]))


def test_patterns_are_all_exact_fills():
    lengths = np.array([2, 3, 5, 6, 7, 10])
    want = {(a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c and a + b + c == 12}
    want |= {(0, a, b) for a in lengths for b in lengths if a <= b and a + b == 12}
    assert {tuple(r) for r in patterns(lengths, 12)} == want


def test_fit_finds_the_only_exact_counts():
    # 40 windows of 7 + 3 + 2 and 25 of 7 + 5; every other mixture leaves lengths over.
    counts = np.zeros(13)
    counts[[7, 3, 2, 5]] = 65, 40, 40, 25
    rows = patterns(np.flatnonzero(counts), 12)
    x = {tuple(r): v for r, v in zip(rows.tolist(), fitted(rows, counts, 3000))}
    assert x[2, 3, 7] == pytest.approx(40, abs=0.5) and x[0, 5, 7] == pytest.approx(25, abs=0.5)


def test_many_alike_pieces_and_lengths_that_never_fit_each_other():
    counts = np.zeros(2049, dtype=np.int64)
    counts[1025] = 1_000_000
    assert sum(many for _, many in plan(counts, 2048)) == 1_000_000
    counts[1023] = 1_000_000
    windows = plan(counts, 2048)
    assert sum(many for _, many in windows) == 1_000_000 and len(windows) < 10


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(9, 8) == [(0, 1), (1, 8)]
    assert cut(20, 8) == [(0, 4), (4, 8), (12, 8)]


def test_pieces_hold_the_ids_of_whole_texts(spark, docs, odd_rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    big = 9_007_199_254_740_993  # one more than a float can tell apart
    rows = [*odd_rows, (big, "a big number", "en", "a")]
    got = pack_by_patterns(docs(rows).repartition(3), size=64).collect()
    texts = sorted(((i, t or "") for i, t, *_ in rows), key=str)
    want = []
    for doc, text in texts:
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        total = len(ids) // 4
        for k, (start, n) in enumerate(cut(total, 64)):
            want.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total))
    fields = ("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(map(str, want)) == sorted(str(tuple(r[f] for f in fields)) for r in got)
    used = sound(sorted((r["sequence_id"], r["offset"], r["length"]) for r in got), 64)
    assert used <= -(-sum(n for _, _, _, n, _, _ in want) // 64) + 2


def test_empty_table(spark, docs):
    assert pack_by_patterns(docs([])).collect() == []
