"""Account listing with the next card dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions.dates import due_date, next_cutoff
from tallyspark.operators.reports import with_parent


def account_calendar(accounts: DataFrame, as_of: date | str) -> DataFrame:
    """Every account with its parent; credit cards also with next cutoff and due date."""
    card = F.col("is_credit_card")
    rows = with_parent(accounts).withColumn(
        "next_cutoff_date", F.when(card, next_cutoff(F.lit(as_of).cast("date"), F.col("statement_cutoff_day")))
    )
    due = due_date(F.col("next_cutoff_date"), F.col("payment_due_offset_days"), F.col("payment_due_offset_type"))
    return rows.select(
        "account_id",
        "owner_id",
        "name",
        "institution",
        "kind",
        "currency",
        "parent",
        "is_credit_card",
        "next_cutoff_date",
        F.when(card, due).alias("next_payment_due_date"),
    ).orderBy("account_id")
