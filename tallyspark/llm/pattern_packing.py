"""Packing by patterns: which lengths share a window is fitted to the histogram of lengths.

Documents longer than a window are cut into windows; only their first piece can be
shorter. The pieces then differ by length alone, and what is planned is a histogram of
at most ``size`` numbers, whatever the number of documents:

1. patterns of up to three lengths that fill a window exactly are enumerated,
2. their repeat counts are fitted to the histogram by non-negative least squares and
   rounded, without using a length more often than it occurs,
3. the lengths that remain are packed by best fit, all pieces of a length at once.

The plan says for every range of ranks within a length which windows it goes to. A piece
finds its rank from the counts of the tasks that cut it, so no piece passes through the
driver or is sorted.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm.common import texts, written
from tallyspark.llm.tokens import encoder, vocabulary_path

#: Steps of the fit of all patterns, and of the fit of those that got most of it.
SCREEN, STEPS = 60, 400
RANK_BITS = 44
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: the first may be shorter than ``size``."""
    first = (total - 1) % size + 1
    return [(0, first)] + [(start, size) for start in range(first, total, size)]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """The pieces of each document (doc_id, text) with their checksums; ``nth`` counts the
    pieces of one length in a task."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [c.split()[0] for c in PIECE.split(", ")][1:]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary).encode, TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            ids_of, all_texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 256):
                rows, whose = [], []
                for row, ids in enumerate(encode(all_texts.slice(at, 256).to_pylist()), at):
                    ids += end
                    total = len(ids) // 4
                    for k, (start, n) in enumerate(cut(total, size)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                        rows.append((k, start, n, crc, total, task, seen[n]))
                        whose.append(row)
                        seen[n] += 1
                # Ids pass as they are: no float in between.
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(whose)), *columns], ["doc_id", *names])

    return docs.mapInArrow(run, PIECE)


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill ``size`` exactly with two or three of ``lengths``: rows of three, 0 for none."""
    there = np.zeros(size + 1, dtype=bool)
    there[lengths] = True
    found = []
    for a in lengths.tolist():
        if 3 * a > size:
            break
        b = np.arange(a, (size - a) // 2 + 1)
        b = b[there[b] & there[size - a - b]]
        found.append(np.stack([np.full(len(b), a), b, size - a - b], axis=1))
    b = np.arange(1, size // 2 + 1)
    b = b[there[b] & there[size - b]]
    found.append(np.stack([np.zeros(len(b), dtype=int), b, size - b], axis=1))
    return np.concatenate(found).astype(np.int64)


def fitted(rows: np.ndarray, counts: np.ndarray, steps: int) -> np.ndarray:
    """Repeat counts x >= 0 of patterns, so that the lengths they use are near ``counts``.

    Least squares by accelerated projected gradients; every length is weighed by one over
    the root of its count, as a length that occurs often may be missed by more.
    """
    size = len(counts) - 1
    weight = np.zeros(size + 1)
    weight[counts > 0] = 1 / counts[counts > 0]
    weight[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], weights=x, minlength=size + 1) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    # Diagonal scaling: the step of a pattern is one over the sum of its row of A'WA.
    scale = 1 / np.maximum(back(weight * used(np.ones(len(rows)))), 1e-300)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y + scale * back(weight * (counts - used(y))))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


#: A window as (length, how often) from its start, and how many windows are like it.
Windows = tuple[list[tuple[int, int]], int]


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[Windows]:
    """Whole repeats of the patterns, most frequent first, taken off ``left`` as far as it reaches."""
    plan = []
    for p in np.argsort(-x, kind="stable").tolist():
        lengths, many = np.unique(rows[p][rows[p] > 0], return_counts=True)
        repeat = min(int(x[p] + 0.5), int((left[lengths] // many).min()))
        if repeat:
            left[lengths] -= many * repeat
            plan.append(([(int(n), int(m)) for n, m in zip(lengths, many)], repeat))
    return plan


def best_fit(left: np.ndarray, size: int) -> list[Windows]:
    """Windows for ``left[n]`` pieces of each length n by best fit decreasing, alike windows as one."""
    open_at: dict[int, list[Windows]] = {}
    rooms: list[int] = []  # capacities of open windows, ascending
    plan: list[Windows] = []

    def put(room: int, window: list[tuple[int, int]], many: int) -> None:
        if room == 0:
            plan.append((window, many))
        else:
            if not open_at.get(room):
                insort(rooms, room)
            open_at.setdefault(room, []).append((window, many))

    for n in range(size, 0, -1):
        todo = int(left[n])
        while todo:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                window, many = open_at[room].pop()
                if not open_at[room]:
                    del rooms[at]
            else:
                room, window, many = size, [], -(-todo // (size // n))
            each = room // n  # one window takes them all before the next one is the fullest
            whole = min(many, todo // each)
            if whole:
                put(room - each * n, [*window, (n, each)], whole)
                many, todo = many - whole, todo - whole * each
            if many and 0 < todo < each:
                put(room - todo * n, [*window, (n, todo)], 1)
                many, todo = many - 1, 0
            if many and window:
                put(room, window, many)
    for room in rooms:
        plan += open_at[room]
    return plan


def plan(counts: np.ndarray, size: int) -> list[Windows]:
    """Windows of ``size`` for ``counts[n]`` pieces of each length n."""
    left = counts.copy()
    whole = [([(size, 1)], int(left[size]))] if left[size] else []
    left[size] = 0
    rows = patterns(np.flatnonzero(left), size)
    goal = left.astype(float)
    if len(rows) > size:
        rows = rows[np.argsort(-fitted(rows, goal, SCREEN), kind="stable")[:size]]
    by_pattern = rounded(rows, fitted(rows, goal, STEPS), left) if len(rows) else []
    return whole + by_pattern + best_fit(left, size)


class Places:
    """Where the pieces of each length go, by their rank among all pieces of that length."""

    def __init__(self, windows: list[Windows], size: int):
        used, made, ranges = [0] * (size + 1), 0, []
        for window, many in windows:
            offset = 0
            for n, each in window:
                ranges.append((n << RANK_BITS | used[n], made, offset, each))
                used[n] += many * each
                offset += n * each
            made += many
        self.key, self.sequence, self.offset, self.each = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 4).T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        key = length << RANK_BITS | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        window, turn = np.divmod(key - self.key[at], self.each[at])
        return self.sequence[at] + window, self.offset[at] + turn * length


def pack_by_patterns(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 0,
    size: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and ``end_id``; null texts count as empty and are
    ``end_id`` alone. Only documents longer than ``size`` are cut, into pieces of ``size``
    behind a first one that may be shorter. The pieces of a sequence follow each other
    without gaps from 0. Rows that repeat, also with the same id, are documents of their
    own. Null ids are kept. An empty table gives no rows. Other columns are ignored.

    The histogram (at most ``size`` rows) and the plan (at most ``size`` patterns and what
    best fit makes of as many lengths) are all that passes through the driver.
    """
    made = written(pieces(texts(docs, id_col, text_col), vocabulary or vocabulary_path(), end_id, size))
    by_task = written(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    places = Places(plan(counts, size), size)
    # One row for each length and task, so no window holds more rows than there are tasks.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = [c.split()[0] for c in PACKED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = places.of(length, rank)
            columns = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    ranked = made.join(bases, ["length", "task"]).select(*names[:-2], (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
