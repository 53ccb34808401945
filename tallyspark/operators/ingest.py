"""Writing new rows, dimension upserts and manual overlays."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tallyspark.functions.dates import month_key
from tallyspark.plans.picks import without_known


def append_new(fresh: DataFrame, path: str) -> int:
    """Append rows to the ledger table, one folder per month; returns their number.

    Rows are rebalanced by month before the write: small months are packed into
    few files, and a month that is too big for one writer is split over several.
    """
    seen = Observation("appended")
    rows = fresh.withColumn("month", month_key(F.col("date"))).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)
    try:
        return int(seen.get["rows"])
    except Py4JJavaError:
        # Nothing to write: Spark cut the plan short, the counter with it.
        return 0


def upsert_dimension(existing: DataFrame, incoming: DataFrame, keys: list[str], refreshed: list[str]) -> DataFrame:
    """Add rows with a new key; of known rows refresh only the listed columns.

    A column that ``incoming`` does not have, or has as NULL, is left as it is.
    """
    columns = existing.columns
    old = existing.select(*[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_old"))
    new = incoming.select(
        *[F.col(c).alias(f"_n_{c}") for c in columns if c in incoming.columns], F.lit(True).alias("_new")
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}"))
    both = old.join(new, condition, "full_outer")

    def pick(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"_o_{c}").alias(c)
        if c in refreshed:
            known = F.coalesce(f"_n_{c}", f"_o_{c}")
        else:
            known = F.col(f"_o_{c}")
        return F.when(F.col("_old"), known).otherwise(F.col(f"_n_{c}")).alias(c)

    return both.select(*[pick(c) for c in columns])


def overlay_manual(table: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """Add hand-entered rows whose key is not in the table yet."""
    return table.unionByName(without_known(manual, table, keys), allowMissingColumns=True)


def resolve_account(rows: DataFrame, accounts: DataFrame, prefix: str = "Contract ") -> DataFrame:
    """Join a contract code with the account whose notes name it.

    Files with an unknown code keep all their rows, marked ``rejected``. The rows are made
    once: a file's rows meet in a window, which is as large as one file.
    """
    code = accounts.filter(F.col("notes").startswith(prefix)).select(
        F.regexp_replace("notes", f"^{prefix}", "").alias("contract"), "account_id"
    )
    joined = rows.join(code, "contract", "left")
    unknown = F.max(F.col("account_id").isNull()).over(Window.partitionBy("source_file"))
    return joined.withColumn("rejected", F.col("source_file").isNotNull() & unknown)
