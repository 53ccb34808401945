"""Toxicity of whole texts by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are whether it holds a word, the first five bytes of a word, a pair of
neighbouring words, or a pair with one word skipped between. Their hashes index one table
of weights. Rates per coordinate and an L1 term leave few weights that are not zero, and
these are what travels to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.common import LOWER, mix, span_hashes, texts, written

BITS = 20
STEM = 5
#: Labelled texts of each class that are learned from, at most.
MAX_PER_CLASS = 3_000
#: Features of all texts of a class that are learned from, at most (4 bytes each); one text has up to 2**BITS.
MAX_FEATURES = 6_000_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
EPOCHS = 12

_LETTER = np.zeros(256, dtype=np.int8)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Indices of all features, with repeats; A-Z count as a-z."""
    data = text.encode("utf-8", "surrogatepass").translate(LOWER)
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = _LETTER[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    both = span_hashes(data, np.concatenate([start, start]), np.concatenate([end, np.minimum(end, start + STEM)]))
    word, stem = both[: len(start)], both[len(start) :]
    odd = np.uint64(0x9E3779B97F4A7C15)
    pair, skip = word[:-1] * odd + word[1:], word[:-2] * odd + (word[2:] ^ np.uint64(0x5851F42D4C957F2D))
    every = np.concatenate([word, stem ^ np.uint64(0x2545F4914F6CDD1D), mix(pair), mix(skip)])
    return (every >> np.uint64(64 - bits)).astype(np.int32)


def learn_weights(examples: list[tuple[np.ndarray, int]], importance: dict[int, float], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from examples (indices, label); ``importance`` weighs the classes."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    last = 1 << bits  # the bias, without L1; it starts from the share of the classes
    share = [sum(importance[y] for _, y in examples if y == c) + 1.0 for c in (0, 1)]
    prior = float(np.log(share[1] / share[0]))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            index, label = examples[k]
            index = np.append(index, last)
            own_z, root = z[index], np.sqrt(n[index])
            shrunk = np.sign(own_z) * np.maximum(np.abs(own_z) - L1, 0.0)
            shrunk[-1] = own_z[-1]
            w = -shrunk / ((BETA + root) / ALPHA + L2)
            p = 1 / (1 + np.exp(-np.clip(prior + w.sum(), -30, 30)))
            g = (p - label) * importance[label]
            if abs(g) < 1e-4:
                continue
            grown = np.sqrt(n[index] + g * g)
            z[index] += g - (grown - root) / ALPHA * w
            n[index] += g * g
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
    shrunk[-1] = z[-1]
    weights = (-shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)
    weights[-1] += prior
    return weights


def score(texts_: list[str], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    out = np.empty(len(texts_))
    for k, text in enumerate(texts_):
        index = features(text, bits)
        index = np.unique(index[weights[index] != 0])
        out[k] = weights[-1] + weights[index].sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def training_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, max_per_class: int = MAX_PER_CLASS, max_features: int = MAX_FEATURES
) -> tuple[pd.DataFrame, dict[int, float]]:
    """Features of at most ``max_per_class`` labelled texts of each class, with at most ``max_features``
    together, and how many labelled rows each of them stands for. Ids are picked by their hash, whatever
    the length of their texts; of several texts of an id one is taken."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for c in (0, 1):
        some = known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = some if picked is None else picked.unionByName(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = batch.iloc[at : at + 100]
                found = [np.unique(features(t)).astype("<i4").tobytes() for t in some["text"]]
                yield some[["doc_id", "toxic"]].assign(found=found)

    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    held = rows.mapInPandas(run, "doc_id long, toxic int, found binary")
    held = written(held.groupBy("doc_id", "toxic").agg(F.max("found").alias("found")))
    # At most max_per_class rows of three numbers for each class.
    sizes = held.select("doc_id", "toxic", (F.length("found") / 4).alias("n"), F.xxhash64("doc_id").alias("draw")).toPandas()
    sizes = sizes.sort_values(["draw", "doc_id"])
    beyond = sizes[sizes.groupby("toxic")["n"].cumsum() > max_features]
    if len(beyond):
        left_out = docs.sparkSession.createDataFrame(beyond[["doc_id"]], "doc_id long")
        held = held.join(F.broadcast(left_out), "doc_id", "left_anti")
    sample = held.toPandas().sort_values("doc_id").reset_index(drop=True)
    counts = sample["toxic"].value_counts()
    return sample, {c: totals.get(c, 0) / max(1, int(counts.get(c, 0))) for c in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not zero; the last one is the bias."""
    sample, importance = training_sample(docs, labels, learn)
    if len(sample) == 0:
        return np.array([1 << BITS]), np.array([-30.0], dtype=np.float32)
    examples = [(np.frombuffer(f, dtype="<i4"), int(y)) for f, y in zip(sample["found"], sample["toxic"])]
    weights = learn_weights(examples, importance)
    index = np.append(np.flatnonzero(weights[:-1]), 1 << BITS)
    return index, weights[index]


def toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, score from 0 to 1.

    ``labels`` has doc_id and toxic (0 or 1; other values and null ids are left out, of
    several labels of one id the highest counts); ``learn`` says, over doc_id, which labels
    may be learned from. At most MAX_PER_CLASS texts of each class with MAX_FEATURES are; all texts are scored
    as a whole. Null and empty texts get the score of a text without features. Without any
    label every score is about 0. An empty table gives no rows. Other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    index, values = fit(rows, labels.select("doc_id", "toxic"), learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
        weights[index] = values
        for batch in batches:
            scores = pa.array(score(batch.column("text").to_pylist(), weights), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
