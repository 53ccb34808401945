"""What the operators of this package share: input columns, staging and hashed words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.session import scratch, written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACE", "WORD", "table", "texts", "scratch", "written", "remainder", "checked_broadcast", "whole_ids"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``more`` columns; whatever else is there is left out."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in more],
    )


def remainder(doc_id: Column, parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def whole_ids(column: pd.Series) -> pd.arrays.IntegerArray:
    """Ids that crossed over as text: pandas reads whole numbers beside a null as floats, which
    changes those above 2**53."""
    return pd.array([None if pd.isna(i) else int(i) for i in column], dtype="Int64")


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a table of a few fixed-width columns if it has at most ``max_rows``
    rows; else leave its join to Spark, which splits skewed partitions. Both ways
    give the same rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of non-space bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.empty(len(raw) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    solid[1:-1] &= 1
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data`` from running sums of a polynomial."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * _powers(n, _P), out=sums[1:])
    inverse = _powers(n + 1, pow(_P, -1, 1 << 64))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def range_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of word hashes from running sums of a polynomial."""
    n = len(words)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _powers(n, _P), out=sums[1:])
    inverse = _powers(n + 1, pow(_P, -1, 1 << 64))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text, in order; A-Z are lower-cased first."""
    data = text.encode("utf-8", "surrogatepass")
    if lower:
        data = data.translate(LOWER)
    start, end = word_spans(data)
    return span_hashes(data, start, end)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words; a shorter text is one run, an empty one none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = out * np.uint64(_P) + words[k : len(words) - size + 1 + k]
    return np.unique(mix(out + np.uint64(size)))
