"""Token files: ids of all documents in id order, Simple-8b coded, written and read by Spark.

A file is a Parquet table of segments. A segment holds the ids of some whole documents
one after the other as 64-bit words, the place of every block of words, and the ids and
sizes of its documents. Segments of a part follow each other by ``first``, the ids of the
part before them; parts follow each other by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyspark.llm import simple8b
from tallyspark.llm.common import texts, whole_ids
from tallyspark.llm.tokens import encoder, vocabulary_path

SEGMENT_IDS = 1 << 17
SEGMENT = (
    "part int, first long, n_ids long, doc_ids array<bigint>, doc_sizes array<bigint>, offsets binary, words binary"
)


def segments(docs: DataFrame, vocabulary: str, end_id: int, parts: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Coded segments of ``docs`` (doc_id, text), one range of ids to a part."""
    ordered = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_at"))
        .repartitionByRange(parts, "doc_id", "_at")
        .sortWithinPartitions("doc_id", "_at")
        .select(F.col("doc_id").cast("string"), "text")
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def coded(part: int, first: int, held: list[tuple[object, bytes]]) -> dict:
        ids = np.frombuffer(b"".join(b for _, b in held), dtype="<u4")
        words, offsets = simple8b.encode(ids)
        return {
            "part": part,
            "first": first,
            "n_ids": len(ids),
            "doc_ids": [None if pd.isna(d) else int(d) for d, _ in held],
            "doc_sizes": [len(b) // 4 for _, b in held],
            "offsets": offsets.tobytes(),
            "words": words.tobytes(),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        first, size, held = 0, 0, []
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                for doc, ids in zip(some["doc_id"], encode(some["text"])):
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield pd.DataFrame([coded(part, first, held)])
                        first, size, held = first + size, 0, []
        if held:
            yield pd.DataFrame([coded(part, first, held)])

    return ordered.mapInPandas(run, SEGMENT)


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
) -> None:
    """Write the ids of every text and ``end_id`` behind each, in ascending order of ids.

    Null texts count as empty: their document is ``end_id`` alone. Null ids come first.
    Documents with one id keep the order of the table. An empty table gives an empty file.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = segments(texts(docs, id_col, text_col), vocabulary or vocabulary_path(), end_id, parts)
    out.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32 bits)."""
    stored = spark.read.parquet(path)
    # One row for each part, so at most as many as the file was written with.
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                words, offsets = np.frombuffer(s.words, dtype="<u8"), np.frombuffer(s.offsets, dtype="<u4")
                ids = simple8b.decode(words, offsets, s.n_ids).astype("<u4").tobytes()
                sizes = np.asarray(s.doc_sizes, dtype=np.int64)
                start = np.cumsum(sizes) - sizes
                yield pd.DataFrame(
                    {
                        "part": s.part,
                        "doc_id": whole_ids(s.doc_ids),
                        "start": start + s.first,
                        "ids": [ids[4 * a : 4 * (a + n)] for a, n in zip(start.tolist(), sizes.tolist())],
                    }
                )

    columns = stored.select("part", "first", "n_ids", F.col("doc_ids").cast("array<string>"), "doc_sizes", "offsets", "words")
    docs = columns.mapInPandas(run, "part int, doc_id long, start long, ids binary")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "ids")
