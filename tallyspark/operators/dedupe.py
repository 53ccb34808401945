"""Which staged rows are new: one rule per feed family.

``staged`` are rows of a batch, ``ledger`` the rows already loaded. Files count
in the order of their names and rows in the order of the file, as if they had
been imported one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions.text import file_extension
from tallyspark.plans.picks import first_per_key, without_known

FILE_ORDER = ("source_file", "source_row")


def _order() -> list[Column]:
    return [F.col(c) for c in FILE_ORDER]


def dedupe_positional(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """New by (account, file, row); a row without a number is always new."""
    return without_known(staged, ledger, ["account_id", "source_file", "source_row"], null_safe=False)


def _with_reference_key(df: DataFrame) -> DataFrame:
    """Add ``_key``: (reference, date, amount) where a reference is printed, else
    (file, row). One struct serves grouping and joining, so they share a shuffle."""
    has = F.col("external_ref").isNotNull()
    return df.withColumn(
        "_key",
        F.struct(
            "account_id",
            F.when(has, F.concat(F.lit("r:"), "external_ref"))
            .otherwise(F.concat(F.lit("f:"), "source_file"))
            .alias("text"),
            F.when(has, F.col("date")).alias("date"),
            F.when(has, F.col("amount")).alias("amount"),
            F.when(~has, F.col("source_row")).alias("row"),
        ),
    )


def dedupe_by_reference(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """New by reference, date and amount, inside the batch too (first row wins);
    rows without a reference are new by file and row."""
    # Rows that share a file and a row number: the smallest amount, so that a replay picks the same one.
    # The least row is its own order, so no column crosses the network twice for it; nor does what the
    # key holds already: account, reference, date and amount of one kind of rows, file and row of the other.
    has = F.col("external_ref").isNotNull()
    order = [F.when(has, F.col(c)).alias(c) for c in FILE_ORDER] + [F.when(~has, F.col(c)).alias(c) for c in ("amount", "date")]
    in_key = ("account_id", "external_ref", *FILE_ORDER, "amount", "date")
    least = F.min(F.struct(*order, *[c for c in staged.columns if c not in in_key])).alias("_row")
    key, row = F.col("_key"), F.col("_row")
    named, value = F.coalesce(F.startswith(key["text"], F.lit("r:")), F.lit(False)), F.substr(key["text"], F.lit(3))
    held = {
        "account_id": key["account_id"],
        "external_ref": F.when(named, value),
        "source_file": F.when(named, row["source_file"]).otherwise(value),
        "source_row": F.when(named, row["source_row"]).otherwise(key["row"]),
        "amount": F.when(named, key["amount"]).otherwise(row["amount"]),
        "date": F.when(named, key["date"]).otherwise(row["date"]),
    }
    picked = _with_reference_key(staged).groupBy("_key").agg(least)
    once = picked.select("_key", *[held.get(c, row[c]).alias(c) for c in staged.columns])
    return without_known(once, _with_reference_key(ledger), ["_key"]).drop("_key")


_AMOUNT_KEY = ["account_id", "date", "amount"]


def _other_format(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keep rows whose (account, date, amount) no other file format has brought."""
    rows = staged.withColumn("_ext", file_extension(F.col("source_file")))
    loaded = (
        ledger.filter(F.col("source_file").isNotNull())
        .groupBy(*_AMOUNT_KEY)
        .agg(
            F.min(file_extension(F.col("source_file"))).alias("_lo"),
            F.max(file_extension(F.col("source_file"))).alias("_hi"),
        )
    )
    opening = rows.groupBy(*_AMOUNT_KEY).agg(F.min_by("_ext", F.struct(*FILE_ORDER)).alias("_first"))
    winner = opening.join(loaded, _AMOUNT_KEY, "left").select(
        *_AMOUNT_KEY,
        F.when(F.col("_lo").isNull(), F.col("_first"))
        .when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        .alias("_winner"),
    )
    return rows.join(winner, _AMOUNT_KEY).filter(F.col("_ext") == F.col("_winner")).select(*staged.columns)


def dedupe_cross_format(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """Drop a row if its date and amount came from a file of another extension.

    The format of the loaded rows wins, otherwise that of the first file of the
    batch; several formats already loaded drop every row.
    """
    return _other_format(staged, ledger)


def dedupe_card_feed(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """Both rules of a card feed: known references first, then other formats,
    then repeats inside the batch."""
    fresh = without_known(_with_reference_key(staged), _with_reference_key(ledger), ["_key"])
    one_format = _other_format(fresh, ledger)
    return first_per_key(one_format, ["_key"], _order()).drop("_key")


def _first_unknown(staged: DataFrame, known: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key that ``known`` does not have."""
    key = F.struct(*keys)
    once = first_per_key(staged.withColumn("_key", key), ["_key"], order)
    return without_known(once, known.select(key.alias("_key")), ["_key"]).drop("_key")


def dedupe_by_id(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """New by movement id within an account, inside the batch too."""
    known = ledger.filter(F.col("external_ref").isNotNull())
    return _first_unknown(staged, known, ["account_id", "external_ref"], _order())


def dedupe_snapshots(staged: DataFrame, known: DataFrame) -> DataFrame:
    """New by (account, date, sub-portfolio); no sub-portfolio equals itself."""
    keys = ["account_id", "date", "sub_portfolio"]
    return _first_unknown(staged, known, keys, [F.col("source_file"), F.col("id")])


def dedupe_periods(staged: DataFrame, known: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Period entries that are not loaded yet: an entry is never overwritten.

    ``keys`` is (account, period start, period end) for income statements and
    (account, date) for equity statements. Of several entries of a batch the first by
    ``order`` (the file, where there is one, and the row) is taken.
    """
    given = order or [c for c in ("source_file", "id") if c in staged.columns]
    rest = [c for c in staged.columns if c not in keys and c not in given]
    return _first_unknown(staged, known, keys, [F.col(c) for c in (*given, *rest)])


def append_statements(staged: DataFrame, known: DataFrame) -> DataFrame:
    """Statements that are not registered by (account, file) yet."""
    return without_known(staged, known, ["account_id", "source_file"])
