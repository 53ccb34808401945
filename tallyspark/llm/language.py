"""Language of whole texts by a bidirectional recurrent network over their bytes.

A text is cut into windows of bytes, all of them read; the network labels every position,
and the probabilities of all positions of a text are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.common import texts
from tallyspark.llm.gru import PAD, Network

WINDOW = 64
HIDDEN = 8
#: Bounds of the training sample: languages, windows in all, windows of one text.
MAX_LABELS, MAX_WINDOWS, MAX_PER_TEXT = 256, 8_000, 32
EPOCHS = 6
UNKNOWN = "und"


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def windows(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last one filled up with PAD."""
    out = np.full(-(-len(data) // size) * size, PAD, dtype=np.int16)
    out[: len(data)] = data
    return out.reshape(-1, size)


def training_sample(docs: DataFrame, learn: Column, lang_col: str = "lang", max_windows: int = MAX_WINDOWS) -> pd.DataFrame:
    """At most ``max_windows`` windows of texts with a language, evenly over languages.

    Texts are picked by a hash of their text; windows lie evenly in a text. Columns: lang, window.
    """
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(MAX_LABELS).collect()
    if not counts:
        return pd.DataFrame({"lang": [], "window": []})
    share = max(1, max_windows // len(counts))
    each = {r[0]: min(MAX_PER_TEXT, max(2, -(-share // r["n"]))) for r in counts}
    odds = {r[0]: min(1.0, share / (each[r[0]] * r["n"])) for r in counts}
    table = F.create_map(*[F.lit(v) for pair in odds.items() for v in pair])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.withColumn("draw", draw).filter(F.col("draw") < table[F.col(lang_col)])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, lang, draw in zip(batch["text"], batch["lang"], batch["draw"]):
                data, k = _bytes(text), each[lang]
                for i in range(min(k, -(-len(data) // WINDOW))):
                    at = int((i + 0.5) / k * max(0, len(data) - WINDOW))
                    rows.append((lang, draw, data[at : at + WINDOW].tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "draw", "window"])

    chosen = picked.select("text", F.col(lang_col).alias("lang"), "draw").mapInPandas(cut, "lang string, draw double, window binary")
    return chosen.orderBy("draw", "lang", "window").limit(max_windows).toPandas()


def train(sample: pd.DataFrame, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> tuple[Network, list[str]]:
    """The network and its languages, from windows with a language."""
    labels = sorted(set(sample["lang"]))
    x = np.full((len(sample), WINDOW), PAD, dtype=np.int16)
    for row, window in zip(x, sample["window"]):
        row[: len(window)] = np.frombuffer(window, dtype=np.uint8)
    y = np.array([labels.index(v) for v in sample["lang"]], dtype=np.int64)
    net = Network(hidden, max(1, len(labels)), seed)
    if labels:
        net.fit(x, y, epochs, seed=seed)
    return net, labels


def pooled(net: Network, column: list[str], n_labels: int, at_once: int = 4096) -> np.ndarray:
    """Mean probabilities over all positions of each text."""
    sums, held, owners, size = np.zeros((len(column), n_labels)), [], [], 0

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            np.add.at(sums, np.concatenate(owners), net.label(np.concatenate(held)))
        held, owners, size = [], [], 0

    for k, text in enumerate(column):
        every = windows(_bytes(text))
        for at in range(0, len(every), at_once):
            part = every[at : at + at_once]
            held.append(part)
            owners.append(np.full(len(part), k))
            size += len(part)
            if size >= at_once:
                flush()
    flush()
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)


def answers(column: list[str], net: Network, labels: list[str]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    speaks = [any(map(str.isalpha, t)) for t in column]  # letters only: no numeral signs
    if not labels:
        return [(UNKNOWN, 0.0)] * len(column)
    p = pooled(net, [t if s else "" for t, s in zip(column, speaks)], len(labels))
    best = p.argmax(axis=1)
    return [(labels[b], float(q[b])) if s else (UNKNOWN, 0.0) for b, q, s in zip(best, p, speaks)]


def predict(docs: DataFrame, net: Network, labels: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of docs (one of them text) with lang_pred and score, without the text."""
    kept = [c for c in columns if c != "text"]
    fields = [f for f in docs.select(*kept).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                found = answers(some.column("text").to_pylist(), net, labels)
                answer = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *answer], [*kept, "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(run, schema)


def identify(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    ``learn`` says, over doc_id, which rows may be learned from; of these a sample of at
    most MAX_WINDOWS windows is used. Texts that are null or without letters, and all texts
    if nothing can be learned, are ``und`` with score 0. Null ids are kept, repeated rows get
    equal answers, an empty table gives no rows. Other columns are ignored.
    """
    rows = texts(docs, id_col, text_col, lang_col)
    if lang_col != "lang":
        rows = rows.withColumnRenamed(lang_col, "lang")
    net, labels = train(training_sample(rows, learn))
    return predict(rows, net, labels, ["doc_id", "text"])


def in_known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that are ``und``, all columns as they are.

    What is learned from are all rows with a language, within the bounds above. If nothing
    can be learned, no text has a known language and none stays.
    """
    rows = texts(docs, docs.columns[0], text_col, lang_col).withColumnRenamed(lang_col, "lang")
    net, labels = train(training_sample(rows, F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for at in range(0, batch.num_rows, 1000):
                some = [t or "" for t in column.slice(at, 1000).to_pylist()]
                yield batch.slice(at, 1000).filter(pa.array([a != UNKNOWN for a, _ in answers(some, net, labels)]))

    return docs.mapInArrow(run, docs.schema)
