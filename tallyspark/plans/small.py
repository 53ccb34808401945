"""Small inputs: dimensions to broadcast, names to look up, files with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_ROWS = 100_000


def small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows.

    A join on a key with few values (a category, say) would otherwise send each
    value's rows to one task. The count stops after ``max_rows`` + 1 rows. A larger
    table stays as it is, and its join is left to Spark and its skew handling.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def only_named(rows: DataFrame, key: str, named: DataFrame, name: str, value: str, max_ids: int = 1_000) -> DataFrame:
    """Rows whose ``key`` belongs to entries of ``named`` with ``name`` = ``value``.

    A name stands for one entry or a few, so their keys become a literal filter
    that reaches the scan. More than ``max_ids`` keys are joined instead.
    """
    hits = named.filter(F.col(name) == value).select(key)
    ids = [r[0] for r in hits.limit(max_ids + 1).collect()]
    if len(ids) > max_ids:
        return rows.join(hits, key, "left_semi")
    return rows.filter(F.col(key).isin(*ids)) if ids else rows.filter(F.lit(False))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of a single split out to all cores.

    A small file with one row group is one task, which costs more than the shuffle
    when each row is expensive (patterns, parsing). A split has a bounded size
    (``spark.sql.files.maxPartitionBytes``), so no more than that is ever dealt out.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df
