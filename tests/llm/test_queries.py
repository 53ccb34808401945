"""The operators on Spark: odd rows, brute force on small tables, whole runs."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, exact_dedup, language, mixing, near_dedup, packing, page_text, passages, token_files, topk, toxicity
from tallyspark.llm.common import remainder
from tallyspark.llm.components import components
from tallyspark.llm.tokens import vocabulary_path

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_dedup_odd_rows(docs, odd_rows):
    rows = exact_dedup.exact_dedup(docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r["text_sha256"]].append(r)
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in groups.values())
    empty = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert {r["keep_id"] for r in empty} == {3}  # the most code points
    assert {r["keep_id"] for r in rows if r["doc_id"] in (5, 6)} == {6}


def test_exact_dedup_with_a_full_filter(docs, prose):
    rows = [(k, prose(k % 40, 5), "en", "a") for k in range(120)]
    small = got(exact_dedup.exact_dedup(docs(rows), bits=3), "doc_id", "keep_id", "group_size")
    assert small == got(exact_dedup.exact_dedup(docs(rows)), "doc_id", "keep_id", "group_size")
    assert {r[1] for r in small} == set(range(40)) and {r[2] for r in small} == {3}


def test_without_copies_keeps_columns(docs, odd_rows):
    table = docs(odd_rows)
    kept = exact_dedup.without_copies(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 6, 7, 8]


def test_components(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(3, 99), (99, 50), (7, 7), (2, 3), (3, 2)] + [(200, k) for k in range(201, 260)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(10, 41)} == {10} and {found[k] for k in (2, 3, 99, 50)} == {2}
    assert {found[k] for k in range(200, 260)} == {200} and 7 not in found


def edited(text, spots, word):
    words = text.split()
    for s in spots:
        words[s] = f"{word}{s}"
    return " ".join(words)


def brute_groups(rows, n, percent):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def test_near_duplicates_against_all_pairs(docs, prose):
    """A family of edited copies around the threshold, chains, equal sets and short texts."""
    base = prose(1, 160)
    rows = [(k, edited(base, range(k % 5, 160, 30 + k % 17), f"e{k}"), "en", "a") for k in range(60)]
    chain = prose(2, 100)
    for k in range(6):
        chain = edited(chain, [k * 16 + 3, k * 16 + 4], f"c{k}")
        rows.append((100 + k, chain, "en", "a"))
    rows += [(200, "a b", "en", "a"), (201, "A B", "en", "a"), (202, "a", "en", "a"), (203, "", "en", "a"), (204, None, "en", "a")]
    rows += [(300 + k, prose(50 + k, 30), "en", "a") for k in range(20)]
    found = near_dedup.near_duplicates(docs(rows), words=3, percent=85)
    assert got(found, "doc_id", "n_shingles", "component_id") == sorted(brute_groups(rows, 3, 85), key=repr)


def test_near_duplicates_odd_rows(docs, odd_rows):
    rows = near_dedup.near_duplicates(docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[5]["kept"]
    assert by[1]["n_shingles"] == 0 and by[None]["kept"] and by[None]["component_id"] is None
    table = docs(odd_rows)
    assert near_dedup.without_near_copies(table).columns == table.columns


def test_mixing(docs, prose):
    rows = [(k, prose(k, 5 + k * 7 % 90), "en", "abcdefg"[k % 7] if k % 9 else None) for k in range(700)]
    rows += [(1000 + k, prose(k, 40), "en", "zz") for k in range(3)]
    found = mixing.mix(docs(rows)).collect()
    again = mixing.mix(docs(rows[::-1])).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    total = sum(len(r[1].split()) for r in rows)
    source = {r[0]: r[3] for r in rows}
    by = defaultdict(list)
    for r in found:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[source[r["doc_id"]]].append(r)
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-3
    level = {}
    for place, name in enumerate(sorted(by, key=lambda s: (s is None, s))):
        g = by[name]
        assert g[0]["source_size"] == sum(r["size"] for r in g)
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= max(6, 0.01 * g[0]["target"])
        if g[0]["target"] < 2 * g[0]["source_size"] - 1e-6:
            level[name] = g[0]["target"] / (3, 1, 2)[place % 3]
    assert max(level.values()) - min(level.values()) < 1e-6 * max(level.values())


def test_mixing_odd_rows(docs, odd_rows):
    table = docs(odd_rows)
    rows = mixing.mix(table).collect()
    assert len(rows) == len(odd_rows) and all(r["taken"] <= 2 * r["size"] for r in rows)
    out = mixing.mixed(table)
    assert out.columns == table.columns and out.count() == sum(r["copies"] for r in rows)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def encoded(whole, text, end):
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_token_files(spark, docs, odd_rows, whole, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs(odd_rows), path, parts=3)
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r["doc_id"] for r in found] == [r[0] for r in rows]
    for r, row in zip(found, rows):
        ids = encoded(whole, row[1], 2)
        assert r["start"] == start and bytes(r["ids"]) == ids.tobytes()
        start += len(ids)


def test_packing(docs, odd_rows, prose, whole):
    rows = odd_rows + [(100 + k, prose(k, 1 + k * 37 % 400), "en", "a") for k in range(60)]
    found = packing.pack(docs(rows), end_id=0, size=64, group_rows=20).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text, *_ in rows:
        ids, pieces = encoded(whole, text, 0), sorted(by_doc[i], key=lambda r: r["start"])
        copies = sum(1 for r in rows if r[0] == i)
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["doc_tokens"] == len(ids) and len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
    for g in by_sequence.values():
        g.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in g] == [sum(x["length"] for x in g[:k]) for k in range(len(g))]
        assert sum(r["length"] for r in g) <= 64
    assert sum(r["length"] for r in found) > 0.97 * 64 * len(by_sequence)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=5)]) for k in range(300)]
    rows += [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 5), (1300, [float("inf")] * 5)]
    rows += [(None, [1.0] * 5), (301, rows[7][1]), (302, rows[7][1]), (400, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as block")
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = np.pad(np.floor(1024 * np.array(v)).astype(np.int64), (0, 5 - len(v)))
    expected = []
    for q in (i for i in vectors if i % 100 == 0):
        best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:10]
        expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert got(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)
    few = topk.top_k(df.filter("vec_id in (0, 1, 2)"))
    assert few.count() == 2


def test_top_k_large_components_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    large = spark.createDataFrame([(100, [1e6]), (1, [2e6]), (2, [3e5]), (3, [-4e6])], kind)
    expected = [(100, n + 1, i, 1024_000_000 * 1024 * int(x)) for n, (i, x) in enumerate([(1, 2e6), (2, 3e5), (3, -4e6)])]
    assert got(topk.top_k(large), "query_id", "rank", "vec_id", "score") == expected
    none = spark.createDataFrame([(100, []), (7, []), (5, [])], kind)
    assert got(topk.top_k(none), "query_id", "rank", "vec_id", "score") == [(100, 1, 5, 0), (100, 2, 7, 0)]
    for value in (1e10, 1e30):
        beyond = spark.createDataFrame([(100, [value]), (1, [value])], kind)
        with pytest.raises(Exception, match="long"):
            topk.top_k(beyond).collect()


def test_page_text(spark):
    rows = [(1, "u", "<article><p>x &amp; y"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>x &amp; y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as text")
    found = got(page_text.extract(df), "page_id", "url", "text", "n_chars")
    assert found == sorted([(1, "u", "x & y", 5), (2, None, "", 0), (None, "u", "", 0), (1, "u", "x & y", 5)], key=repr)


def test_passages(docs, prose):
    shared = prose(900, 70)
    rows = [(k, prose(k, 40 + k * 5), "en", "a") for k in range(20)]
    hit = {}
    for k in (3, 8, 11):
        words = rows[k][1].split()
        at = 10 + k
        rows[k] = (k, " ".join([*words[:at], *shared.split(), *words[at:]]), "en", "a")
        hit[k] = (at, at + 70)
    rows += [(50, None, "en", "a"), (51, "", "en", "a"), (52, "of " * 200, "en", "a"), (53, "of " * 300, "en", "a"), (None, shared, "en", "a")]
    found = passages.repeated_passages(docs(rows)).collect()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert set(by) == {3, 8, 11, 52, 53}
    for k, (a, b) in hit.items():
        assert all(r["start_word"] < b and r["end_word"] > a and r["cluster_id"] == 3 for r in by[k])
        assert sum(r["n_words"] for r in by[k]) >= 26 and all(r["kept"] == (k == 3) for r in by[k])
    clean = {r["doc_id"]: r["text"] for r in passages.without_passages(docs(rows)).collect()}
    assert clean[3] == rows[3][1] and clean[50] is None and len(clean[8].split()) <= len(rows[8][1].split()) - 26


def changed(text, how, spots):
    """``text`` with a word replaced, added or left out at every spot."""
    words = text.split()
    for s in sorted(spots, reverse=True):
        words[s : s + (how != "added")] = [] if how == "missing" else [f"zz{s}"]
    return " ".join(words)


def runs_of(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_passages_with_edits_against_brute_force(docs, prose):
    """Edited copies of 51 to 100 words that are 80 % alike, each found in both documents."""
    rows, planted = [], {}
    for k in range(90):
        size, how = 51 + k * 49 // 89, ("replaced", "added", "missing")[k % 3]
        shared = prose(5000 + k, size)
        spots = [size // 2 if k % 2 else 2 + k * 7 % (size - 4)] + ([size // 4] if size >= 97 and how == "replaced" and k % 2 else [])
        other = changed(shared, how, spots)
        a, b = runs_of(shared.split()), runs_of(other.split())
        assert len(a & b) >= 0.8 * len(a | b)
        for doc, text in ((2 * k, shared), (2 * k + 1, other)):
            rows.append((doc, " ".join([prose(7000 + doc, 20 + k), text, prose(9000 + doc, 30)]), "en", "a"))
            planted[doc] = (20 + k, 20 + k + len(text.split()), min(spots), max(spots))
    found = defaultdict(list)
    for r in passages.repeated_passages(docs(rows)).collect():
        found[r["doc_id"]].append(r)
    for doc, (start, end, first, last) in planted.items():
        (r,) = found[doc]
        assert r["cluster_id"] == doc - doc % 2 and r["kept"] == (doc % 2 == 0)
        # A rest of fewer than four words behind an edit counts as edited too.
        assert r["start_word"] <= start + (first + 1 if first < 4 else 0)
        assert r["end_word"] >= end - (5 if end - start - last < 6 else 0)


def test_passages_chain_and_second_match(docs, prose):
    """One cluster where neighbours only are alike; places unlike the first one of their run."""
    seed, tail = prose(40, 14), prose(41, 60)
    rows = [(1, f"{prose(42, 30)} {seed} {prose(43, 30)}", "en", "a")]
    rows += [(k, f"{prose(50 + k, 30)} {seed} {tail} {prose(60 + k, 30)}", "en", "a") for k in (2, 3)]
    base = prose(44, 200)
    for k in range(4):
        base = edited(base, [40 * k + 20], f"e{k}")
        rows.append((10 + k, base, "en", "a"))
    got_rows = passages.repeated_passages(docs(rows)).collect()
    spans = {r["doc_id"]: r for r in got_rows}
    assert 1 not in spans and spans[2]["kept"] and not spans[3]["kept"]
    assert spans[2]["start_word"] == 30 and spans[2]["n_words"] == 74 == spans[3]["n_words"]
    assert {spans[k]["cluster_id"] for k in range(10, 14)} == {10} and {spans[k]["n_words"] for k in range(10, 14)} == {200}


def test_passages_like_the_first_of_a_bucket_meet_the_others(docs, prose):
    """The second of three is like both others, which are not alike, and the third meets it only in
    buckets that the first is in too."""
    keys = lambda text: set(passages.paragraphs(common.word_hashes(text))[0].tolist())
    rows, k = [], 0
    while len(rows) < 24:
        base, k = prose(8000 + k, 56), k + 1
        three = [changed(base, "replaced", [19]), base, changed(base, "replaced", [37])]
        three = [" ".join([prose(60_000 + 3 * k + n, 30), text, prose(90_000 + 3 * k + n, 50)]) for n, text in enumerate(three)]
        first, second, third = map(keys, three)
        if first & second and second & third and second & third <= first:
            rows += [(len(rows) + n, text, "en", "a") for n, text in enumerate(three)]
    found = defaultdict(list)
    for r in passages.repeated_passages(docs(rows)).collect():
        found[r["doc_id"]].append(r)
    for doc, *_ in rows:
        (r,) = found[doc]
        assert (r["cluster_id"], r["start_word"], r["end_word"], r["kept"]) == (doc - doc % 3, 30, 86, doc % 3 == 0)


def test_passages_are_whole(docs, prose):
    """All words of an exact passage, which then leave the later document altogether."""
    shared = prose(900, 70)
    own = {k: (prose(k, 45), prose(100 + k, 33)) for k in (3, 8, 11)}
    rows = [(k, f"{a} {shared} {b}", "en", "a") for k, (a, b) in own.items()]
    found = passages.repeated_passages(docs(rows))
    assert got(found, "doc_id", "start_word", "end_word", "kept") == [(11, 45, 115, False), (3, 45, 115, True), (8, 45, 115, False)]
    clean = {r["doc_id"]: r["text"].split() for r in passages.without_passages(docs(rows)).collect()}
    assert clean[3] == rows[0][1].split() and all(clean[k] == " ".join(own[k]).split() for k in (8, 11))


def test_passages_send_no_fingerprints_to_the_driver(docs, prose, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self, *args):
        raise AssertionError("rows were fetched by the driver")

    rows = [(k, f"{prose(k, 30)} {prose(900, 20)} w{k} {prose(901, 40)}", "en", "a") for k in range(3)]
    found = passages.matches(docs(rows).select("doc_id", "text"))
    assert found.count() > 0
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    assert passages.repeated_passages(docs(rows)).count() == 3


def test_passages_in_rounds(docs, prose):
    """Rounds give the same stretches, also inside one document, and leave only what is returned."""
    from tallyspark import session

    shared, twice = prose(900, 60), prose(901, 50)
    rows = [(k, f"{prose(k, 30)} {shared} w{k} {twice} {prose(50 + k, 20)} {twice}", "en", "a") for k in range(6)]
    texts = docs(rows).select("doc_id", "text")
    before = len(session._STAGED)
    once, often = (got(passages.matches(texts, n), "doc_id", "start", "end", "to_id", "to_start", "to_end") for n in (10**6, 150))
    assert len(once) > 15 and once == often and any(r[0] == r[3] for r in once)
    assert len(session._STAGED) - before == 2
    passages.repeated_passages(docs(rows))
    assert len(session._STAGED) - before == 3


def test_language(spark, docs):
    english, french = "the and with this that from have ", "les des une dans pour avec être "
    rows = [(k, (english if k % 2 else french) * (2 + k % 9), "en" if k % 2 else "fr", "a") for k in range(200)]
    rows += [(300, None, "en", "a"), (301, "12 .. 3", "fr", "a"), (302, "", None, "a"), (None, english * 900, None, "a")]
    table = docs(rows)
    found = language.identify(table, learn=remainder(F.col("doc_id")) != 2).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(by[k]["lang_pred"] == rows[k][2] for k in range(200))
    assert [by[k]["lang_pred"] for k in (300, 301, 302, None)] == ["und", "und", "und", "en"]
    kept = language.in_known_language(table)
    assert kept.columns == table.columns and kept.count() == 201


def test_toxicity(spark, docs, prose):
    rows = [(k, prose(k, 40) + (" vlastib grumok" if k % 5 == 0 else ""), "en", "a") for k in range(200)]
    rows += [(300, None, "en", "a"), (301, "", "en", "a"), (None, "grumok", "en", "a")]
    labels = [(k, int(k % 5 == 0)) for k in range(200)] + [(5, 1), (None, 1), (6, None), (7, 9), (999, 1)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 as score")
    found = toxicity.toxicity(docs(rows), table, learn=remainder(F.col("doc_id")) != 2).collect()
    by = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == len(rows)
    assert all((by[k] >= 0.3) == (k % 5 == 0) for k in range(200))
    assert by[300] == by[301] < 0.3
    blank = toxicity.toxicity(docs(rows), table.filter("false"), learn=F.lit(True))
    assert max(r["score"] for r in blank.collect()) < 0.01


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    learn = F.lit(True)
    results = [
        topk.top_k(vectors),
        mixing.mix(none),
        mixing.mixed(none),
        near_dedup.near_duplicates(none),
        exact_dedup.exact_dedup(none),
        exact_dedup.without_copies(none),
        page_text.extract(pages),
        passages.repeated_passages(none),
        packing.pack(none),
        toxicity.toxicity(none, labels, learn),
        language.identify(none, learn),
        language.in_known_language(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.agg(F.max("length")).first()[0] <= 1024
