"""One row per key, and rows that are missing from another table.

Both are written as aggregations and joins instead of ranking windows. An
aggregation combines inside each map task first, so a key with a third of all
rows reaches its reducer as one row per task; a window would send every row of
that key to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: list[str], order: list[Column], picker) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = picker(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the smallest ``order``; NULL keys are a group."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the greatest ``order``; NULL keys are a group."""
    return _pick(df, keys, order, F.max_by)


def without_known(new: DataFrame, known: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """Rows of ``new`` whose key does not occur in ``known`` (duplicates stay).

    ``known`` is cut to its distinct keys, so a key it repeats costs nothing in
    the join. With ``null_safe`` two NULLs are the same key (the key is compared
    as one struct); without it a NULL key never matches.
    """
    if null_safe and keys != ["_key"]:
        key = F.struct(*keys)
        return without_known(new.withColumn("_key", key), known.select(key.alias("_key")), ["_key"]).drop("_key")
    seen = known.select(*[F.col(k).alias(f"_known_{k}") for k in keys]).distinct()
    condition = reduce(lambda a, b: a & b, [new[k] == seen[f"_known_{k}"] for k in keys])
    return new.join(seen, condition, "left_anti")
