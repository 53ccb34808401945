"""Packing of tokenised documents into windows of one size by best-fit decreasing.

Documents longer than a window are first cut into full windows. What remains of each is
dealt to groups of bounded size; a group takes its pieces from the longest to the
shortest and puts each into the fullest open window that still has room for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import texts, written, whole_ids
from tallyspark.llm.tokens import encoder, vocabulary_path

GROUP_ROWS = 2_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, full boolean, slot long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that tells which capacities occur."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.tree[node]:
            self.tree[node] = 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """The capacity and number of the open window that ``need`` fits most tightly."""
        node, tree = self.leaves + need, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            tree[node] = 0
            while node > 1 and not tree[node ^ 1]:
                node //= 2
                tree[node] = 0
        return capacity, window


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` descend and are at most ``size``."""
    open_windows, made = OpenWindows(size), 0
    window_of, offset_of = [], []
    for n in lengths:
        found = open_windows.take(n)
        if found is None:
            found, made = (size, made), made + 1
        capacity, window = found
        window_of.append(window)
        offset_of.append(size - capacity)
        if capacity > n:
            open_windows.put(capacity - n, window)
    return window_of, offset_of


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """The full windows of each document and what remains of it, with checksums of the ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slot = encoder(vocabulary).encode, TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, rows = batch.slice(at, 256), []
                for doc, ids in zip(some.column("doc_id").to_pylist(), encode(some.column("text").to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        part = ids[4 * start : 4 * (start + size)]
                        n = len(part) // 4
                        rows.append((doc, start, n, zlib.crc32(part), total, n == size, slot))
                        slot += 1
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "full", "slot"]
                kinds = [pa.bool_() if n == "full" else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(run, PIECE)


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 0,
    size: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and ``end_id``; null texts count as empty and are
    ``end_id`` alone. Every id lies in one piece, and the pieces of a sequence follow each
    other without gaps from 0. Rows that repeat, also with the same id, are documents of
    their own. Null ids are kept. An empty table gives no rows.
    """
    cut = written(pieces(texts(docs, id_col, text_col), vocabulary or vocabulary_path(), end_id, size))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = cut.filter("full").select(*keep, (F.col("slot") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter("not full")
    groups = max(1, -(-rest.count() // group_rows))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "slot"], ascending=[False, True])
        window, offset = best_fit(rows["length"].tolist(), size)
        number = ((key[0] << 36) + np.array(window, dtype=np.int64)) * 2 + 1
        return rows[keep].assign(doc_id=whole_ids(rows["doc_id"]), sequence_id=number, offset=offset)

    grouped = rest.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("_group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    return full.unionByName(grouped.groupBy("_group").applyInPandas(fit, PACKED))
