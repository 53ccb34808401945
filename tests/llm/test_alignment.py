"""Alignment against a plain version that works on whole documents byte by byte."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyspark.llm.alignment import (
    ALIGNED, OF_B, SECOND, Aligner, Chunk, PieceEncoder, RankEncoder, align, byte_level_tokens, piece_tokens,
)
from tallyspark.llm.tokens import vocabulary_path

FIELDS = [c.split()[0] for c in ALIGNED.split(", ")]
TRICKY = [
    "two  spaces", " leading", "trailing ", "\ttabs\n\nand lines\r\n", "<|endoftext|> is text", "a <s> b </s> c",
    "▁marked", "emoji \U0001f600 and é́", "<0x41> spelled", "\x00 nul", "你好世界" * 20, "1234567 89", "   ",
    "don't we'll", "x" * 500, " nbsp", "a b",
]


def plain(rows):
    """The answer from library calls, ends of tokens in sets and no windows."""
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(SECOND))
    of_a, of_b = byte_level_tokens(vocabulary_path()), piece_tokens(model)
    docs = []
    for doc_id, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        data = (" " + text).encode() if text else b""
        if b"".join(of_a[i] for i in a) != data or b"".join(of_b[i] for i in b) != data:
            a, b = [], []
        ends_a = np.cumsum([len(of_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(of_b[i]) for i in b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        for end in cuts:
            x = [str(i) for i, e in zip(a, ends_a) if before < e <= end]
            y = [str(i) for i, e in zip(b, ends_b) if before < e <= end]
            groups.append(",".join(x) + "|" + ",".join(y))
            before = end
        links = [(a[i], b[j]) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b) if e == f]
        docs.append((doc_id, a, b, groups, links))
    counts = Counter(link for d in docs for link in d[4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [
        (
            doc_id, len(a), len(b), len(groups), len(links), sum(counts[l] == best[l[1]] for l in links),
            sum(counts[l] for l in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, a, b, groups, links in docs
    ]


def same(df, rows):
    got = [tuple(r[f] for f in FIELDS) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("chunk_windows", [1, 300, 1 << 17])
def test_odd_rows_and_texts(spark, docs, odd_rows, prose, chunk_windows):
    big = 9_007_199_254_740_993
    rows = [(i, t if t is None or len(t) < 5000 else t[:5000], l, s) for i, t, l, s in odd_rows]
    rows += [(100 + k, t, "en", "a") for k, t in enumerate(TRICKY)] + [(big, prose(9, 50), "en", "a")]
    same(align(docs(rows).repartition(3), chunk_windows=chunk_windows), [(i, t) for i, t, *_ in rows])


def test_very_long_text_without_spaces(spark, docs):
    text = "abcdefghij0123456789" * 400
    same(align(docs([(1, text, "en", "a"), (2, "abc", "en", "a")])), [(1, text), (2, "abc")])


def test_empty_table_and_only_texts_without_tokens(spark, docs):
    assert align(docs([])).collect() == []
    same(align(docs([(1, None, "en", "a"), (None, "", "en", "a")])), [(1, None), (None, "")])


def test_windows_are_cut_at_anchors_and_remembered(prose):
    aligner = Aligner(vocabulary_path(), vocabulary_path(SECOND), max_windows=5)
    text = prose(4, 200) + "  " + prose(5, 3) + "\nx y"
    ((a, b),) = aligner.ids([text])
    windows = aligner.windows(a, b)
    mixed = np.frombuffer(b"".join(windows), dtype="<u4")
    assert mixed[mixed < OF_B].tolist() == a.tolist() and (mixed[mixed >= OF_B] - OF_B).tolist() == b.tolist()
    assert len(windows) > 150
    once = aligner.align(windows)
    assert len(aligner.known) == 5 and once == aligner.align(windows) == [aligner.align([w])[0] for w in windows]


def test_words_encoded_apart_are_words_of_whole_texts(prose, odd_rows):
    few, many = (PieceEncoder(vocabulary_path(SECOND), max_words=n) for n in (50, 100_000))
    texts = [*TRICKY, "", *[t for _, t, *_ in odd_rows if t], *[prose(k, 40) for k in range(20)]]
    want = [np.array(ids, dtype="<u4").tobytes() for ids in few.model.encode(texts)]
    assert few.encode(texts) == want and many.encode(texts) == want and few.encode(texts) == want


def test_a_text_that_one_side_spells_differently_leaves_no_trace(prose):
    chunk = Chunk(Aligner(vocabulary_path(), vocabulary_path(SECOND)))
    for text in ["a b", "new words ▁ here", "a b c", None]:
        for a, b in chunk.aligner.ids([text or ""]):
            chunk.add(1, a, b)
    row = chunk.row(0)
    assert [n > 0 for n in row["n_a"][0]] == [True, False, True, False]
    assert sorted(row["pair_counts"][0]) == [1, 2, 2]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aet hnosri<|>'\n", max_size=200))
def test_merging_by_rank_is_the_vocabulary_s_own_encoding(ranks_and_whole, text):
    ranks, whole = ranks_and_whole
    assert ranks.encode([text]) == [np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]


@pytest.fixture(scope="module")
def ranks_and_whole():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    whole.encode_special_tokens = True
    ranks = RankEncoder(vocabulary_path())
    assert ranks.encode == ranks._by_rank
    return ranks, whole
