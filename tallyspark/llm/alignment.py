"""Alignment of two tokenizations of the same texts, and which token pairs end together how often.

A is a byte-level vocabulary, B one of word pieces with byte fallback that marks spaces.
Both tokenise the whole text. Where a token of each starts with a space at the same byte,
both have ended together before it: such an anchor cuts the two id sequences into windows,
mostly of one word. How the tokens of a window align depends on its ids alone, so it is
worked out once for each pair of id tuples and remembered.

Documents travel in chunks. A chunk holds the windows of its documents, the pairs these
link and how often; only its distinct pairs are shuffled, summed over the corpus and
brought back to the chunk. No key is hotter than the number of chunks.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm.common import written
from tallyspark.llm.tokens import SPLIT, byte_letters, encoder, kept, vocabulary_path

SECOND = "piece_bpe_32k.model"
CHUNK_WINDOWS = 1 << 17
#: Windows and words a worker remembers, and the longest window in ids of both sides together.
MAX_WINDOWS, MAX_WORDS, MAX_IDS = 50_000, 50_000, 64
#: Added to the ids of B where a window holds those of both.
OF_B = 1 << 31
#: Texts that are tokenised together.
TEXTS = 512
CHUNK = (
    "chunk long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
    "groups_sha256 array<string>, n_windows array<bigint>, windows binary, window_links binary, links binary, "
    "pairs array<bigint>, pair_counts array<bigint>"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
SPACE_MARK = "▁"


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; empty for special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {letter: b for b, letter in byte_letters().items()}
    special = [t["id"] for t in spec.get("added_tokens", [])]
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special]))
    for token, i in spec["model"]["vocab"].items():
        if i not in special:
            out[i] = bytes(byte_of[c] for c in token)
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of every piece of a sentence piece model: the mark is a space, <0xHH> a byte."""
    pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.vocab_size())]
    return [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE_MARK, " ").encode() for p, byte in pieces]


@dataclass
class Side:
    """One tokenizer's token bytes, by id."""

    tokens: list[bytes]
    lengths: np.ndarray = field(init=False)
    spaced: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in self.tokens])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def marks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens that start with a space, and the bytes before each."""
        at = np.flatnonzero(self.spaced[ids])
        lengths = self.lengths[ids]
        return at, (np.cumsum(lengths) - lengths)[at]


class RankEncoder:
    """Encodes texts by a byte-level vocabulary, merging by rank, to little-endian 32-bit ids.

    Merging by the ids of merged tokens gives what the vocabulary's list of merges gives if
    ids follow that list and every token encodes to itself: a pair outside the list that
    spells a token then never comes up. Where this does not hold the vocabulary's own
    encoder is used.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokens = byte_level_tokens(path)
        self.ranks = tiktoken.Encoding(
            "own", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(self.tokens) if t}, special_tokens={}
        )
        own = encoder(path, plain=True)
        model, letters = own.model, byte_letters()
        alone = own.by_word and not own.added and all(
            [m.id for m in model.tokenize("".join([letters[b] for b in t]))] == [i] for i, t in enumerate(self.tokens) if t
        )
        self.encode = self._by_rank if alone and merges_follow_ids(path) else own.encode

    def _by_rank(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.ranks.encode_ordinary(t)).tobytes() for t in texts]


def merges_follow_ids(path: str) -> bool:
    """Whether a later merge of a vocabulary always makes a token of a greater id."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(p)] for p in pairs]
    return all(x < y for x, y in zip(made, made[1:]))


class PieceEncoder:
    """Encodes texts by a sentence piece model to little-endian unsigned 32-bit ids.

    Pieces have the mark of a space at their start only, so words behind single spaces are
    encoded apart; new ones of many texts together, and at most ``max_words`` are
    remembered. Texts with other runs of spaces, or marks of their own, are encoded whole.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        self.by_word = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.max_words = max_words
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def _single_spaces(self, text: str) -> bool:
        return self.by_word and "  " not in text and text[:1] != " " and text[-1:] != " " and SPACE_MARK not in text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [t.split(" ") if t and self._single_spaces(t) else None for t in texts]
        new = list(set(chain.from_iterable(w for w in split if w)).difference(self.known))
        fresh = dict(zip(new, self._encoded(new)))
        room = max(0, self.max_words - len(self.known))
        self.known.update(islice(fresh.items(), room))
        whole = iter(self._encoded([t for t, w in zip(texts, split) if w is None]))
        if room >= len(fresh):
            of = self.known.__getitem__
        else:
            known = self.known
            of = lambda w: known.get(w) or fresh[w]
        return [next(whole) if w is None else b"".join(map(of, w)) for w in split]


class Aligner:
    """Tokenises texts both ways and aligns the ids window by window."""

    def __init__(self, first: str, second: str, max_windows: int = MAX_WINDOWS):
        ranks, pieces = RankEncoder(first), PieceEncoder(second)
        self.encode_a, self.encode_b = ranks.encode, pieces.encode
        self.a, self.b = Side(ranks.tokens), Side(piece_tokens(pieces.model))
        self.max_windows = max_windows
        # An id of A as text before another of its group and at its end, then one of B before
        # another, at the end of its group and at the end of its window.
        sides = [(self.a, ",|"), (self.b, ",;\n")]
        self.written = [f"{i}{c}" for side, marks in sides for c in marks for i in range(len(side.tokens))]
        self.known: dict[bytes, tuple[str, bytes] | None] = {}

    def ids(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none where the text is empty or A does not spell it behind a space."""
        none = np.empty(0, dtype="<u4")
        both = zip(texts, self.encode_a([" " + t for t in texts]), self.encode_b(texts))
        for text, a, b in both:
            a, b = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
            yield (a, b) if text and self.a.joined(a.tolist()) == b" " + text.encode() else (none, none)

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The ids between anchors: of each window those of A, then those of B with OF_B added."""
        if len(a) == 0 or len(b) == 0:
            return []
        at_a, before_a = self.a.marks(a)
        at_b, before_b = self.b.marks(b)
        place = np.searchsorted(before_b, before_a)
        hit = np.append(before_b, -1)[place] == before_a
        from_a, from_b = at_a[hit], at_b[place[hit]]
        if len(from_a) == 0 or from_a[0] or from_b[0]:  # else the space before the text is the first anchor
            from_a, from_b = np.append(0, from_a), np.append(0, from_b)
        n_a, n_b = np.diff(from_a, append=len(a)), np.diff(from_b, append=len(b))
        mixed = np.empty(len(a) + len(b), dtype="<u4")
        mixed[np.arange(len(a)) + np.repeat(from_b, n_a)] = a
        mixed[np.arange(len(b)) + np.repeat(from_a + n_a, n_b)] = b + OF_B
        data, cuts = mixed.tobytes(), (4 * (from_a + from_b)).tolist()
        return [data[p:q] for p, q in zip(cuts, [*cuts[1:], len(data)])]

    def align(self, windows: list[bytes]) -> list[tuple[str, bytes] | None]:
        """Of each window its groups as text and its linked pairs as 64-bit numbers, A's id
        in the upper half; none where the sides spell different bytes."""
        out = list(map(self.known.get, windows))
        new = [k for k, found in enumerate(out) if found is None]
        room = self.max_windows - len(self.known)
        for k, found in zip(new, self._aligned([windows[k] for k in new])):
            out[k] = found
            if room > 0 and len(windows[k]) <= 4 * MAX_IDS:
                self.known[windows[k]] = found
                room -= 1
        return out

    def _aligned(self, windows: list[bytes]) -> list[tuple[str, bytes] | None]:
        """``align`` for windows that are not known, all of them at once."""
        if not windows:
            return []
        mixed = np.frombuffer(b"".join(windows), dtype="<u4")
        of = np.repeat(np.arange(len(windows)), [len(w) // 4 for w in windows])
        in_b = mixed >= OF_B
        ids, of = (mixed[~in_b], mixed[in_b] - OF_B), (of[~in_b], of[in_b])
        lengths = [side.lengths[i] for side, i in zip((self.a, self.b), ids)]
        size_a, size_b = (np.bincount(o, weights=n, minlength=len(windows)) for o, n in zip(of, lengths))
        if self.a.joined(ids[0].tolist()) != self.b.joined(ids[1].tolist()) or (size_a != size_b).any():
            if len(windows) > 1:  # find the ones to blame
                half = len(windows) // 2
                return self._aligned(windows[:half]) + self._aligned(windows[half:])
            return [None]
        ends = [np.cumsum(n) for n in lengths]
        _, last_a, last_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        pairs = ids[0][last_a].astype(np.int64) << 32 | ids[1][last_b].astype(np.int64)
        # Every token as its place in ``written``, in the order of groups, those of A first.
        many_a, many_b = len(self.a.tokens), len(self.b.tokens)
        code_a, code_b = ids[0].astype(np.int64), ids[1] + np.int64(2 * many_a)
        code_a[last_a] += many_a
        code_b[last_b] += many_b
        final = np.append(np.diff(of[0][last_a]) > 0, True)
        code_b[last_b[final]] += many_b
        per_a, per_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        codes = np.empty(len(mixed), dtype=np.int64)
        codes[np.arange(len(code_a)) + np.repeat(np.cumsum(per_b) - per_b, per_a)] = code_a
        codes[np.arange(len(code_b)) + np.repeat(np.cumsum(per_a), per_b)] = code_b
        parts = map(self.written.__getitem__, codes.tolist())
        texts = "".join(parts).split("\n")
        data, cuts = pairs.tobytes(), (8 * np.cumsum(np.bincount(of[0][last_a], minlength=len(windows)))).tolist()
        return [(t, data[p:q]) for t, p, q in zip(texts, [0, *cuts], cuts)]


class _Numbers(dict):
    """Numbers of windows in the order of their first use."""

    def __missing__(self, window: bytes) -> int:
        self[window] = number = len(self)
        return number


def narrow(values: np.ndarray, kinds: int) -> bytes:
    """Numbers below ``kinds`` in two bytes each where they fit, else four."""
    return values.astype("<u2" if kinds <= 1 << 16 else "<u4").tobytes()


def widened(data: bytes, kinds: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if kinds <= 1 << 16 else "<u4")


class Chunk:
    """Some whole documents as runs of windows, each kind of window once."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.number = _Numbers()
        self.docs: list[tuple[int | None, int, int]] = []
        self.seen: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, a: np.ndarray, b: np.ndarray) -> None:
        of = list(map(self.number.__getitem__, self.aligner.windows(a, b)))
        self.docs.append((doc_id, len(a), len(b)))
        self.seen.append(np.array(of, dtype="<u4"))
        self.size += len(of)

    def row(self, number: int) -> dict[str, list]:
        """The chunk with the groups of every document, and the pairs that it links."""
        found = self.aligner.align(list(self.number))
        wrong = np.array([f is None for f in found], dtype=bool)
        texts, aligned = [f[0] if f else "" for f in found], [f[1] if f else b"" for f in found]
        some_wrong = wrong.any()
        columns: list[list] = [[] for _ in range(6)]
        for k, (doc_id, n_a, n_b) in enumerate(self.docs):
            if some_wrong and wrong[self.seen[k]].any():  # the sides differ: the text has no tokens
                self.seen[k] = self.seen[k][:0]
            of = self.seen[k].tolist()
            groups = ";".join(map(texts.__getitem__, of))
            sha = hashlib.sha256(groups.encode()).hexdigest() if of else ""
            values = (doc_id, *((n_a, n_b) if of else (0, 0)), groups.count("|"), sha, len(of))
            for column, value in zip(columns, values):
                column.append(value)
        seen = np.concatenate(self.seen)
        used = np.bincount(seen, minlength=len(aligned))
        aligned = [p if n else b"" for p, n in zip(aligned, used.tolist())]
        links = np.frombuffer(b"".join(aligned), dtype="<i8")
        per_window = np.array([len(p) // 8 for p in aligned], dtype="<u4")
        pairs, place = np.unique(links, return_inverse=True)
        counts = np.bincount(place, weights=np.repeat(used, per_window), minlength=len(pairs)).astype(np.int64)
        values = [
            number, *columns, narrow(seen, len(per_window)), per_window.tobytes(), narrow(place, len(pairs)),
            pairs.tolist(), counts.tolist(),
        ]
        return {name: [v] for name, v in zip(_names(CHUNK), values)}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {"array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def chunks(docs: DataFrame, first: str, second: str, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """Documents (doc_id, text) as aligned chunks of at least ``chunk_windows`` windows, or what a task has."""
    schema = pa.schema(list(zip(_names(CHUNK), _types(CHUNK))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept((first, second), lambda: Aligner(first, second))
        number, chunk = TaskContext.get().partitionId() << 32, Chunk(aligner)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                ids, texts = (batch.column(c).slice(at, TEXTS).to_pylist() for c in ("doc_id", "text"))
                for doc_id, (a, b) in zip(ids, aligner.ids([t or "" for t in texts])):
                    chunk.add(doc_id, a, b)
                    if chunk.size >= chunk_windows or len(chunk.docs) >= chunk_windows:
                        yield pa.RecordBatch.from_pydict(chunk.row(number), schema)
                        number, chunk = number + 1, Chunk(aligner)
        if chunk.docs:
            yield pa.RecordBatch.from_pydict(chunk.row(number), schema)

    return docs.mapInArrow(run, CHUNK)


def pair_counts(chunked: DataFrame) -> DataFrame:
    """Per linked pair of ids in the corpus: pair, n and whether n is the highest of its B id."""
    entries = chunked.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("e"))
    counts = entries.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.pair_counts").alias("n"))
    # At most one row for each id of A in the window of a B id.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def with_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a chunk with the corpus counts of what they link; ``right`` has the chunk's pairs."""
    columns = {c: [] for c in _names(ALIGNED)}
    order = np.argsort(right.column("pair").to_numpy())
    n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
    for row in left.to_pylist():
        per_window = np.frombuffer(row["window_links"], dtype="<u4")
        seen, links = widened(row["windows"], len(per_window)), widened(row["links"], len(order))
        first = np.cumsum(per_window, dtype=np.int64) - per_window
        running = [np.append(0, np.cumsum(v[links])) for v in (n, best)]
        sums = [(r[first + per_window] - r[first])[seen] for r in running]
        ends = np.cumsum(np.array(row["n_windows"], dtype=np.int64))
        total, bests = (np.diff(np.concatenate([[0], np.cumsum(s)])[ends], prepend=0) for s in sums)
        columns["n_links"] += row["n_groups"]
        columns["n_best"] += bests.tolist()
        columns["count_sum"] += total.tolist()
        for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"):
            columns[c] += row[c]
    return pa.table(columns, pa.schema(list(zip(_names(ALIGNED), _types(ALIGNED)))))


def align(
    docs: DataFrame,
    first: str | None = None,
    second: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_windows: int = CHUNK_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: how its tokens by two vocabularies align.

    Groups end where a token of both ends. A link is a pair of tokens that end together,
    one for each group. n_best counts the links whose pair is as frequent in the corpus as
    any of its B id, count_sum adds the corpus counts of the pairs of all links;
    groups_sha256 is the digest of all groups as text.

    A text that is null or empty, or that a side does not spell byte for byte behind a
    space, has no tokens: all counts are 0 and the digest is empty. Rows that repeat count
    each time. Null ids are kept. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    paths = first or vocabulary_path(), second or vocabulary_path(SECOND)
    made = written(chunks(rows, *paths, chunk_windows))
    counts = written(pair_counts(made))
    wanted = made.select(F.col("chunk").alias("of_chunk"), F.explode("pairs").alias("pair")).join(counts, "pair")
    left = made.drop("pairs", "pair_counts").groupBy("chunk")
    return left.cogroup(wanted.groupBy("of_chunk")).applyInArrow(with_counts, ALIGNED)
