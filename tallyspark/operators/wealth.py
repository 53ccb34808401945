"""Account balances, net worth and running balances.

Balances come from four tables. Each is first reduced to one row per account (by
aggregation, so a hot account is combined inside the map tasks) and only then
joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions.money import SUM
from tallyspark.plans.ordered import BLOCK, block_of, running_sum
from tallyspark.plans.picks import last_per_key


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest valuation of each (account, sub-portfolio); no sub-portfolio is
    a group of its own; on one date the lowest id wins."""
    return last_per_key(snapshots, ["account_id", "sub_portfolio"], [F.col("date"), -F.col("id")])


def latest_equity(equity: DataFrame) -> DataFrame:
    """The newest equity statement of each account, even if it prints no value."""
    return last_per_key(equity, ["account_id"], [F.col("date"), -F.col("id")])


def _snapshot_totals(snapshots: DataFrame) -> DataFrame:
    """Per account: sum of the newest values, currency of the sub-portfolio that was
    seen first, and whether any valuation was entered by hand."""
    value = F.struct("market_value", "currency")
    newest = snapshots.groupBy("account_id", "sub_portfolio").agg(
        F.max_by(value, F.struct("date", -F.col("id"))).alias("v"),
        F.min("id").alias("first_id"),
        F.max(F.col("source_file").isNull()).alias("manual"),
    )
    return newest.groupBy("account_id").agg(
        F.sum("v.market_value").cast(SUM).alias("snapshot_value"),
        F.min_by("v.currency", "first_id").alias("snapshot_currency"),
        F.max("manual").alias("manual"),
    )


def distribution_return(alternatives: DataFrame, accounts: DataFrame) -> DataFrame:
    """Fixed-principal accounts: cash paid out and mean monthly return in per cent."""
    paid = alternatives.groupBy("account_id").agg(
        F.count("*").alias("months"), F.sum("proportional_income").cast(SUM).alias("paid")
    )
    principal = accounts.filter(F.col("principal").isNotNull()).select("account_id", "principal")
    rate = F.try_divide(F.col("paid") / F.col("months"), F.col("principal")) * 100
    return principal.join(paid, "account_id", "left").select(
        "account_id",
        F.col("principal").cast(SUM).alias("initial_investment"),
        F.coalesce("paid", F.lit(0)).cast(SUM).alias("cash_distributed_to_date"),
        F.round(rate, 3).cast("decimal(12,3)").alias("average_monthly_return_pct"),
    )


def account_balance(
    ledger: DataFrame,
    snapshots: DataFrame,
    equity: DataFrame,
    alternatives: DataFrame,
    accounts: DataFrame,
    mode: str = "reference",
) -> DataFrame:
    """Balance of every account.

    ``reference`` adds ledger amounts of all currencies and labels the balance
    with the account's currency, overridden by the snapshots' and then by the
    equity plan's. ``by_currency`` keeps one balance per currency instead.

    A fixed-principal account counts its principal, never its distributions.
    """
    if mode == "by_currency":
        return _balance_by_currency(ledger, snapshots, equity, alternatives, accounts)
    if mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    moved = ledger.groupBy("account_id").agg(F.sum("amount").cast(SUM).alias("moved"))
    held = _snapshot_totals(snapshots)
    vested = latest_equity(equity).filter(F.col("market_value").isNotNull()).select(
        "account_id", F.col("market_value").alias("vested"), F.col("currency").alias("vested_currency")
    )
    shared = alternatives.groupBy("account_id").agg(
        F.sum("proportional_income").cast(SUM).alias("shared")
    )
    zero = F.lit(0).cast(SUM)
    n = lambda c: F.coalesce(F.col(c).cast(SUM), zero)
    rows = accounts
    for branch in (moved, held, vested, shared):
        rows = rows.join(branch, "account_id", "left")
    fixed = F.col("principal").isNotNull()
    return rows.select(
        "account_id",
        "owner_id",
        "name",
        "kind",
        "parent_account_id",
        (n("moved") + n("snapshot_value") + n("vested") + F.when(fixed, n("principal")).otherwise(n("shared")))
        .cast(SUM)
        .alias("balance"),
        F.coalesce("vested_currency", "snapshot_currency", "currency").alias("currency"),
        n("moved").alias("moved"),
        F.col("snapshot_value").isNotNull().alias("has_snapshot"),
        F.coalesce("manual", F.lit(False)).alias("manual"),
        fixed.alias("fixed_principal"),
        n("shared").alias("shared"),
    )


def _balance_by_currency(
    ledger: DataFrame, snapshots: DataFrame, equity: DataFrame, alternatives: DataFrame, accounts: DataFrame
) -> DataFrame:
    newest = latest_snapshot(snapshots)
    parts = [
        ledger.groupBy("account_id", "currency").agg(F.sum("amount").cast(SUM).alias("amount")),
        newest.groupBy("account_id", "currency").agg(F.sum("market_value").cast(SUM).alias("amount")),
        latest_equity(equity)
        .filter(F.col("market_value").isNotNull())
        .select("account_id", "currency", F.col("market_value").cast(SUM).alias("amount")),
        alternatives.groupBy("account_id", "currency")
        .agg(F.sum("proportional_income").cast(SUM).alias("amount"))
        .join(accounts.filter(F.col("principal").isNotNull()).select("account_id"), "account_id", "left_anti"),
        accounts.filter(F.col("principal").isNotNull()).select(
            "account_id", "currency", F.col("principal").cast(SUM).alias("amount")
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    totals = stacked.groupBy("account_id", "currency").agg(F.sum("amount").cast(SUM).alias("balance"))
    manual = snapshots.filter(F.col("source_file").isNull()).select("account_id").distinct()
    held = manual.withColumn("manual", F.lit(True))
    about = accounts.select("account_id", "owner_id", "name", "kind", "parent_account_id")
    return (
        totals.join(about, "account_id")
        .join(held, "account_id", "left")
        .withColumn("manual", F.coalesce("manual", F.lit(False)))
    )


def _folded(balances: DataFrame) -> DataFrame:
    """Add ``excluded``: the parent's own balance was entered by hand, so the
    child is already inside it."""
    parents = (
        balances.filter(F.col("manual"))
        .select(F.col("account_id").alias("_manual_parent"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return balances.join(
        parents, balances.parent_account_id == parents["_manual_parent"], "left"
    ).withColumn("excluded", F.coalesce("_hit", F.lit(False))).drop("_hit", "_manual_parent")


def _caveats() -> Column:
    """Codes for what a balance does not tell."""
    child = F.col("parent_account_id").isNotNull()
    return F.array_compact(
        F.array(
            F.when(F.col("fixed_principal"), "principal_only"),
            F.when(~F.col("fixed_principal") & (F.col("shared") != 0), "income_only"),
            F.when(F.col("excluded"), "folded_into_parent").when(
                child & (F.col("moved") != 0) & ~F.col("has_snapshot"), "movements_only"
            ),
            F.when(F.col("manual"), "manual_value"),
        )
    )


def net_worth_by_account(balances: DataFrame) -> DataFrame:
    """Accounts with a balance other than zero, with flags and caveat codes."""
    rows = _folded(balances).filter(F.col("balance") != 0)
    columns = ["account_id", "owner_id", "name", "kind", "balance", "currency", "excluded"]
    if "fixed_principal" in balances.columns:
        return rows.select(*columns, _caveats().alias("caveats"))
    return rows.select(*columns)


def net_worth(balances: DataFrame) -> DataFrame:
    """Totals per owner and currency; children of a hand-valued parent are left out."""
    return (
        _folded(balances)
        .filter((F.col("balance") != 0) & ~F.col("excluded"))
        .groupBy("owner_id", "currency")
        .agg(F.sum("balance").cast(SUM).alias("total"))
    )


def running_balance(ledger: DataFrame, anchors: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Balance of an account after each of its transactions, by date, id and amount.

    ``anchors`` (``account_id, opening``) holds opening balances, one per account.
    Days cut an account, blocks of ids cut a day, so neither a hot account nor a
    hot day is sorted in one task. ``block`` is the width of a block; ids with
    gaps need a wider one.
    """
    rows = ledger.withColumn("_block", block_of(F.col("id"), block))
    summed = running_sum(rows, ["account_id"], ["date", "_block"], ["id", "amount"], F.col("amount").cast(SUM), "_run")
    if anchors is None:
        return summed.withColumn("balance", F.col("_run").cast(SUM)).drop("_run", "_block")
    joined = summed.join(anchors.select("account_id", "opening"), "account_id", "left")
    return joined.withColumn(
        "balance", (F.coalesce("opening", F.lit(0)) + F.col("_run")).cast(SUM)
    ).drop("_run", "_block", "opening")
