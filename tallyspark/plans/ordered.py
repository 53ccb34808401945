"""Running sums and carried values that do not depend on the size of a group.

A plain window sorts every row of one group in one task. Here a group is cut
into chunks by its own order columns. Each level of the chain
``group -> chunk -> finer chunk -> row`` is one window over its parent, and the
totals of the coarser levels are aggregated before they are shuffled. The
caller picks chunk columns whose number of values below one parent has a bound,
e.g. days below an account, blocks of line numbers below a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 100_000


def block_of(position: Column, size: int = BLOCK) -> Column:
    """Chunk number of a unique whole-number position."""
    return F.floor(position / F.lit(size))


def _key(columns: list[str]) -> Column:
    """The columns as one struct: never NULL itself, and equal where they are
    equal or both NULL. Windows and joins on it share one shuffle."""
    return F.struct(*columns)


def running_sum(
    df: DataFrame, group: list[str], chunks: list[str], order: list[str], value: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row of its group.

    ``chunks`` go from coarse to fine and sort in the same direction as the
    rows; ``order`` is a unique order inside the finest chunk.
    """
    rows = df.withColumn("_v", value)
    levels = [group + chunks[: i + 1] for i in range(len(chunks))]
    # Totals of the finest chunks, then of each coarser level from the finer one.
    totals = {len(levels) - 1: rows.groupBy(*levels[-1]).agg(F.sum("_v").alias("_t"))}
    for i in range(len(levels) - 2, -1, -1):
        totals[i] = totals[i + 1].groupBy(*levels[i]).agg(F.sum("_t").alias("_t"))
    start = None
    for i, keys in enumerate(levels):
        parent = group if i == 0 else levels[i - 1]
        before = Window.partitionBy("_k").orderBy(chunks[i]).rowsBetween(Window.unboundedPreceding, -1)
        here = totals[i].withColumn("_k", _key(parent)).select(
            *keys, "_k", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s")
        )
        if start is not None:
            coarse = start.select(_key(parent).alias("_k"), F.col("_s").alias("_p"))
            here = here.join(coarse, "_k").withColumn("_s", F.col("_s") + F.col("_p"))
        start = here.select(*keys, "_s")
    local = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_k", _key(levels[-1])).withColumn("_l", F.sum("_v").over(local))
    offsets = start.select(_key(levels[-1]).alias("_k"), "_s")
    return inner.join(offsets, "_k").withColumn(out, F.col("_l") + F.col("_s")).drop("_k", "_v", "_l", "_s")


def carry_forward(
    df: DataFrame, group: list[str], chunk: str, order: list[str], value: Column, out: str
) -> DataFrame:
    """Add ``out``: the last non-NULL ``value`` up to and including each row."""
    rows = df.withColumn("_v", value)
    keys = group + [chunk]
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_t")
    ends = rows.groupBy(*keys).agg(last)
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select(_key(keys).alias("_k"), F.last("_t", ignorenulls=True).over(before).alias("_s"))
    local = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_k", _key(keys)).withColumn("_l", F.last("_v", ignorenulls=True).over(local))
    return inner.join(start, "_k").withColumn(out, F.coalesce("_l", "_s")).drop("_k", "_v", "_l", "_s")
