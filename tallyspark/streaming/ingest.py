"""A folder import that can be run again and loads each row once.

The file source remembers finished files in its checkpoint. Each micro-batch is
also deduplicated against the ledger table, so a replayed batch, a new
checkpoint or a renamed copy of a file adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark import schema
from tallyspark.functions.dates import month_key
from tallyspark.operators.dedupe import (
    dedupe_by_reference,
    dedupe_card_feed,
    dedupe_cross_format,
    dedupe_positional,
)
from tallyspark.operators.ingest import append_new

Dedupe = Callable[[DataFrame, DataFrame], DataFrame]

MAX_LITERALS = 2_000

# Rules whose keys hold the date or the file; ids that are unique for ever are not.
LOCAL_KEYS = (dedupe_by_reference, dedupe_card_feed, dedupe_cross_format, dedupe_positional)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table with its month column, empty before its first write."""
    columns = f"{schema.TRANSACTION}, month string"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(path)


def _values(df: DataFrame, column: str) -> list | None:
    """Distinct values of a batch column, or None if there are too many to list."""
    found = [r[0] for r in df.select(column).distinct().limit(MAX_LITERALS + 1).collect()]
    return found if len(found) <= MAX_LITERALS else None


def related(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Loaded rows that can have a key of the batch: those of its months (equal
    references and amounts are equal in date too) and those of its files.

    Months prune partitions and file names reach the scan as a literal filter. A
    batch with too many of either is compared with the whole table.
    """
    months = _values(batch.select(month_key(F.col("date")).alias("month")), "month")
    files = _values(batch, "source_file")
    if months is None or files is None or None in months:
        return known
    near = known.filter(F.col("month").isin(*months))
    same_file = known.filter(~F.col("month").isin(*months) & F.col("source_file").isin(*[f for f in files if f]))
    return near.unionByName(same_file)


def ingest_stream(
    staged: DataFrame, table_path: str, checkpoint: str, dedupe: Dedupe = dedupe_card_feed
) -> StreamingQuery:
    """Load everything a streaming source holds now, then stop.

    ``staged`` is a streaming DataFrame with ledger columns. A rule outside
    ``LOCAL_KEYS`` is given the whole ledger table.
    """

    def load(batch: DataFrame, _: int) -> None:
        rows = schema.align_schema(batch, schema.TRANSACTION)
        known = read_table(batch.sparkSession, table_path)
        if dedupe in LOCAL_KEYS:
            known = related(known, rows)
        append_new(dedupe(rows, known), table_path)

    return (
        staged.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
