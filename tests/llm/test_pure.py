"""Helpers without Spark against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyspark.llm import common, language, near_dedup, packing, page_text, passages, simple8b, topk, toxicity
from tallyspark.llm.gru import PAD, Network
from tallyspark.llm.language import pooled, windows
from tallyspark.llm.tokens import Encoder, vocabulary_path


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=700))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids):
    x = np.array(ids, dtype=np.uint64)
    words, offsets = simple8b.encode(x)
    assert (simple8b.decode(words, offsets, len(x)) == x).all()
    assert len(offsets) == -(-len(x) // simple8b.BLOCK)


def test_simple8b_packs_small_ids():
    words, _ = simple8b.encode(np.zeros(1280, dtype=np.uint64))
    assert len(words) <= 20


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_encoder_agrees_with_the_library(texts):
    from tokenizers import Tokenizer

    whole = _cached("whole", lambda: Tokenizer.from_file(vocabulary_path()))
    # Room for a few pieces only, so that forgotten ones are encoded again.
    mine = _cached("mine", lambda: Encoder(vocabulary_path(), max_words=5))
    texts = texts + ["  a  b ", "it's we'll", "x \n y", "<|endoftext|> a", "  x", "1 22  333\n"]
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


_KEPT: dict = {}


def _cached(name, make):
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=100, deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    window, offset = packing.best_fit(lengths, 40)
    left = []
    for n, w, at in zip(lengths, window, offset):
        fits = [c for c in left if c >= n]
        if w == len(left):
            assert not fits and at == 0
            left.append(40 - n)
        else:
            assert left[w] == min(fits) == 40 - at
            left[w] -= n


def test_word_hashes_are_hashes_of_lower_case_words():
    a = common.word_hashes("The\tcat  THE\x0bcaT ñ Ñ")
    assert a[0] == a[2] and a[1] == a[3] and a[4] != a[5] and len(set(a.tolist())) == 4
    assert len(common.word_hashes("")) == len(common.word_hashes(" \n")) == 0
    assert len(common.shingle_hashes(common.word_hashes("a b"), 3)) == 1


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3600], rng.integers(0, 2**64, 400, dtype=np.uint64)])
    seeds = near_dedup._seeds(near_dedup.SIGNATURE, 2)
    sig = [np.frombuffer(near_dedup.low_bits(near_dedup.minima(x, seeds)), dtype=np.uint64) for x in (a, b)]
    assert abs(near_dedup.estimate(*sig) - 3600 / 4400) < 0.06
    assert near_dedup.bands_for(85) == 20 and 0.75 < near_dedup.gate(85) < 0.85


def test_same_passage_is_cut_alike(prose):
    shared = common.word_hashes(prose(9, 80))
    one = np.concatenate([common.word_hashes(prose(1, 33)), shared, common.word_hashes(prose(2, 50))])
    two = np.concatenate([common.word_hashes(prose(3, 71)), shared])
    inside = lambda words, at: {tuple(words[s : s + passages.PARAGRAPH]) for s in passages.starts(words) if at <= s <= at + 80 - passages.PARAGRAPH}
    assert len(inside(one, 33) & inside(two, 71)) >= 2
    assert len(passages.starts(common.word_hashes("of " * 500))) > 10


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network(3, 2, seed=1)
    x = rng.integers(0, 256, (5, 4)).astype(np.int16)
    x[3:, 1] = PAD
    y = np.array([0, 1, 1, 0])
    for w in net.parameters():
        w[...] = w.astype(np.float32)
    _, grads = net.gradients(x, y)
    for w, g in zip(net.parameters(), grads):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            kept, step = w[at], 1e-2
            w[at] = kept + step
            up = net.gradients(x, y)[0]
            w[at] = kept - step
            down = net.gradients(x, y)[0]
            w[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 5e-3


def test_labels_are_those_of_training():
    rng = np.random.default_rng(0)
    x = np.where(rng.random((400, 16)) < 0.8, np.arange(400)[:, None] % 2 * 10 + 97, 32).astype(np.int16)
    net = Network(4, 2)
    net.fit(x, np.arange(400) % 2, epochs=4, batch=32)
    p = pooled(net, ["aaaa aaa" * 30, "kkk kkkk" * 30, ""], 2, at_once=3)
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and p[2].sum() == 0
    forward = np.concatenate([net._forward(x.T, 0)[0], net._forward(x.T, 1)[0]], axis=2) @ net.out + net.bias
    soft = np.exp(forward) / np.exp(forward).sum(axis=2, keepdims=True)
    assert np.allclose(net.label(x), soft.sum(axis=0), atol=1e-3)
    assert windows(np.zeros(65, dtype=np.uint8)).shape == (2, 64)


def test_ftrl_finds_the_marking_words(prose):
    bad = ["grumok", "vlastib", "zzork"]
    rng = random.Random(1)
    texts = [prose(k, 60) + (f" {rng.choice(bad)} {prose(-k, 20)}" if k % 4 == 0 else "") for k in range(400)]
    examples = [(np.unique(toxicity.features(t)), int(k % 4 == 0)) for k, t in enumerate(texts[:300])]
    weights = toxicity.learn_weights(examples, {0: 1.0, 1: 1.0})
    scores = toxicity.score(texts[300:] + [""], weights)
    assert [s >= 0.3 for s in scores[:-1]] == [k % 4 == 0 for k in range(300, 400)]
    assert scores[-1] < 0.3 and 0 < (weights != 0).sum() < 2000


def test_cell_search_against_all_products():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-900, 900, (700, 6)).astype(np.int32)
    vectors[::7] = vectors[0]
    ids = rng.permutation(700)
    import pandas as pd

    rows = []
    for b in range(0, 700, 64):
        m, i = vectors[b : b + 64], ids[b : b + 64].astype(np.int64)
        rows.append((b, 0, i.tobytes(), m.tobytes(), m.max(axis=0).tobytes(), m.min(axis=0).tobytes(), b""))
    asks = np.flatnonzero(ids % 50 == 0)
    none = np.full(len(asks), topk.NONE, dtype=np.int64)
    rows.append((999, 1, ids[asks].astype(np.int64).tobytes(), vectors[asks].tobytes(), b"", b"", none.tobytes()))
    found = topk.search_cell(pd.DataFrame(rows, columns=["block", "kind", "ids", "rows", "high", "low", "floors"]), 6, 10)
    for q in asks:
        scores = vectors.astype(np.int64) @ vectors[q].astype(np.int64)
        best = sorted(((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[q]))[:10]
        mine = found[found["query_id"] == ids[q]]
        assert sorted(zip((-mine["score"]).tolist(), mine["vec_id"].tolist())) == best


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("only text &amp; more", "only text & more"),
        ("<p>a</p><script>x='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>b &lt;c&gt;", "a\nb <c>"),
        (
            "<body><nav><ul><li><a href=1>Home</a></ul></nav><div class='ad big'>Buy, now</div><article><h1>Title</h1>"
            "<p><b>One,  two\n three<br><p>four</article><div id=comments><p>nice, very nice</p></div><footer>end</footer>",
            "Title\nOne, two three\nfour",
        ),
        (
            "<div class=sidebar><p>no, no, no</p></div><div><div><p>First, with words</p><p>Second, too</p></div>"
            "<ul><li><a href=1>more</a><li><a href=2>links</a></ul></div><form><p>name, please</p></form>",
            "First, with words\nSecond, too",
        ),
        ("<article><p>open <article2", "open"),
        ("<main>" + "<div>" * 3000 + "<p>deep, text</p>", "deep, text"),
        (
            "<body><form id=page><nav><p>Home</p></nav><h1>Title</h1><p>One, two, three</p><p>Four</p></form></body>",
            "Title\nOne, two, three\nFour",
        ),
        ("<body><p>Write to us, please</p><form><p>name, or both</p></form></body>", "Write to us, please"),
    ],
)
def test_main_text(page, text):
    assert page_text.main_text(page) == text


def test_deep_pages_take_linear_time():
    """Open elements that are never closed, with a text and a stray end in each."""
    times = []
    for depth in (4_000, 40_000):
        page = "<article>" + "<div>some, text</section>" * depth
        start = time.perf_counter()
        assert page_text.main_text(page).count("some, text") >= depth - 10
        times.append(time.perf_counter() - start)
    assert times[1] < 40 * times[0]


@pytest.mark.parametrize("how", ["replaced", "missing"])
def test_edited_passages_collide_and_are_covered(how):
    """Passages of 51 to 100 words with an edit in the middle, in other surroundings."""
    rng = np.random.default_rng(11)
    some = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    met = 0
    for size in range(51, 101):
        one = some(size)
        two = np.delete(one, size // 2)
        if how == "replaced":
            two = np.insert(two, size // 2, some(1))
        a, b = np.concatenate([some(40), one, some(40)]), np.concatenate([some(33), two, some(50)])
        met += bool(set(passages.paragraphs(a)[0].tolist()) & set(passages.paragraphs(b)[0].tolist()))
        shifts = (7,) if how == "replaced" else (7, 8)
        assert all(passages.alike(a, b, s) == [(40, 40 + size, 33, 33 + len(two))] for s in shifts)
    assert met >= 48
    assert passages.alike(a[:3], b, 0) == [] and passages.missed(1.0) == 0


def test_numeral_signs_are_no_letters():
    net = language.Network(2, 1)
    assert [a for a, _ in language.answers(["½ ² ٣ Ⅷ", "_ 1", "", "½ é"], net, ["fr"])] == ["und", "und", "und", "fr"]
