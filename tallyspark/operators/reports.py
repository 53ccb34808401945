"""Netted spending, monthly cash flow, the category matrix, search and export.

Sign convention: a ledger amount below zero is money out. Spending is shown
positive and is net: money that comes back in a category lowers it.

Every report first sums the ledger per account, month, category and tag. Only
that summary is joined with accounts and categories, so the size of one account
or one owner never decides how long a join or a reducer takes.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions.dates import month_key
from tallyspark.functions.money import SUM
from tallyspark.functions.text import (
    FREQUENCY_LABEL,
    KIND_LABEL,
    NATURE_LABEL,
    UNCATEGORISED,
    labelled,
)
from tallyspark.plans.small import only_named, small



def in_dates(df: DataFrame, date_from: date | str | None = None, date_to: date | str | None = None) -> DataFrame:
    """Optional date range, both ends included."""
    if date_from is not None:
        df = df.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.filter(F.col("date") <= F.lit(date_to).cast("date"))
    return df


def is_uncategorised_charge() -> Column:
    return F.col("category_id").isNull() & (F.col("amount") < 0)


def is_spend(kind: Column, category_id: Column, amount: Column) -> Column:
    """Real spending: an expense category, or no category and money out."""
    return F.coalesce(kind == "expense", F.lit(False)) | (category_id.isNull() & (amount < 0))


def with_parent(accounts: DataFrame) -> DataFrame:
    """Each account with its parent's name (NULL without one)."""
    parent = accounts.select(
        F.col("account_id").alias("_parent_id"), F.col("name").alias("parent")
    )
    return accounts.join(parent, accounts.parent_account_id == parent["_parent_id"], "left").drop("_parent_id")


def enrich(ledger: DataFrame, accounts: DataFrame, categories: DataFrame, keep_uncategorised: bool = True) -> DataFrame:
    """Ledger rows with account and category columns.

    Accounts join inner, categories left (or inner). Categories have few values
    and are broadcast once their size is checked. Accounts grow with the data, so
    Spark decides by their size and splits a hot account when it has to sort and
    merge.
    """
    account = accounts.select(
        "account_id", F.col("owner_id"), F.col("name").alias("account"), F.col("institution")
    )
    category = categories.select(
        "category_id", F.col("name").alias("category"), F.col("kind"), F.col("nature")
    )
    return ledger.join(account, "account_id").join(
        small(category), "category_id", "left" if keep_uncategorised else "inner"
    )


def monthly_base(
    ledger: DataFrame,
    accounts: DataFrame,
    categories: DataFrame,
    currency: str | None = None,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
) -> DataFrame:
    """Ledger sums per owner, currency, month, category, tag and direction."""
    rows = in_dates(ledger, date_from, date_to)
    if currency is not None:
        rows = rows.filter(F.col("currency") == currency)
    summed = (
        rows.groupBy(
            "account_id",
            "currency",
            F.trunc("date", "month").alias("_first"),
            "category_id",
            "spend_frequency",
            (F.col("amount") < 0).alias("is_charge"),
        )
        .agg(F.sum("amount").cast(SUM).alias("amount"))
        .withColumn("month", month_key(F.col("_first")))
        .drop("_first")
    )
    owner = accounts.select("account_id", "owner_id")
    category = categories.select("category_id", F.col("name").alias("category"), "kind", "nature")
    return summed.join(owner, "account_id").join(small(category), "category_id", "left").drop("account_id")


def _uncategorised() -> Column:
    return F.col("category_id").isNull() & F.col("is_charge")


def _sum_where(condition: Column, sign: int = 1) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("amount") * sign)), F.lit(0)).cast(SUM)


def monthly_category(base: DataFrame) -> DataFrame:
    """Net spending per owner, currency, month and expense category."""
    return (
        base.filter(F.col("kind") == "expense")
        .groupBy("owner_id", "currency", "month", "category", "nature")
        .agg((-F.sum("amount")).cast(SUM).alias("amount"))
    )


def monthly_summary(base: DataFrame, with_categories: bool = False) -> DataFrame:
    """Cash flow per owner, currency and month.

    A month is present when it has income, an expense category, an uncategorised
    charge or a tagged row; transfers alone do not make one. Sums are exact
    decimals, so rounding the categories first changes nothing.
    """
    kind, tag = F.col("kind"), F.col("spend_frequency")
    counted = base.filter(kind.isin("income", "expense") | _uncategorised() | tag.isNotNull())
    parts = {
        "income": _sum_where(kind == "income"),
        "spent": _sum_where(kind == "expense", -1),
        "uncategorized_expense": _sum_where(_uncategorised(), -1),
        "fijo_total": _sum_where(tag == "fijo", -1),
        "variable_total": _sum_where(tag == "variable", -1),
    }
    keys = ["owner_id", "currency", "month"]
    if not with_categories:
        months = counted.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])
    else:
        per_category = counted.groupBy(*keys, "kind", "category", "nature").agg(
            *[c.alias(n) for n, c in parts.items()]
        )
        # One entry per category of the dimension, not per ledger row.
        entry = F.when(kind == "expense", F.struct((-F.col("spent")).alias("k"), "category", "nature"))
        months = per_category.groupBy(*keys).agg(
            *[F.sum(n).cast(SUM).alias(n) for n in parts],
            F.transform(
                F.array_sort(F.collect_list(entry)),
                lambda e: F.struct(e["category"].alias("category"), e["nature"].alias("nature"), (-e["k"]).alias("amount")),
            ).alias("categories"),
        )
    total = (F.col("spent") + F.col("uncategorized_expense")).cast(SUM)
    extra = ["categories"] if with_categories else []
    return months.select(
        *keys,
        "income",
        "uncategorized_expense",
        "fijo_total",
        "variable_total",
        total.alias("total_expense"),
        (F.col("income") - total).cast(SUM).alias("net"),
        *extra,
    )


def _net_by_category(base: DataFrame, keys: list[str]) -> DataFrame:
    """Net spending per category, with one row for uncategorised charges unless
    they come to nothing; a single pass over ``base``."""
    spent = base.filter((F.col("kind") == "expense") | _uncategorised())
    netted = spent.groupBy(*keys, "category", "nature", _uncategorised().alias("_open")).agg(
        (-F.sum("amount")).cast(SUM).alias("amount")
    )
    return netted.filter(~F.col("_open") | (F.col("amount") != 0)).select(
        *keys,
        F.when(F.col("_open"), UNCATEGORISED).otherwise(F.col("category")).alias("category"),
        "nature",
        "amount",
    )


def spending_by_category(
    ledger: DataFrame,
    accounts: DataFrame,
    categories: DataFrame,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    currency: str | None = None,
) -> DataFrame:
    """Net spending per owner and category over a date range, largest first.

    Without ``currency`` amounts of all currencies are added. Rows without a
    category count only when money went out, and only if the sum is not zero.
    """
    base = monthly_base(ledger, accounts, categories, currency, date_from, date_to)
    return _net_by_category(base, ["owner_id"]).orderBy("owner_id", F.desc("amount"), "category")


def month_breakdown(base: DataFrame, month: str) -> DataFrame:
    """One month's categories with the uncategorised row, largest first."""
    rows = base.filter(F.col("month") == month)
    return _net_by_category(rows, ["owner_id", "currency"]).orderBy(
        "owner_id", "currency", F.desc("amount"), "category"
    )


def category_month_cells(base: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category in every month of an owner and currency; empty cells are 0."""
    keys = ["owner_id", "currency", "month"]
    kind, tag = F.col("kind"), F.col("spend_frequency")
    label = F.when(kind == "expense", F.col("category")).when(_uncategorised(), F.lit(UNCATEGORISED))
    seen = base.filter(kind.isin("income", "expense") | _uncategorised() | tag.isNotNull())
    # The categories of the dimension become literals; their number has no limit here.
    expense = categories.filter((F.col("kind") == "expense") & F.col("name").isNotNull())
    names = [*sorted(r["name"] for r in expense.select("name").distinct().collect()), UNCATEGORISED]
    listed = F.explode(F.array(*[F.lit(n) for n in names])).alias("category")
    # One aggregation: a month's sums by label become a map, which also tells the months.
    spent = seen.groupBy(*keys, label.alias("category")).agg((-F.sum("amount")).alias("amount"))
    entry = F.when(F.col("category").isNotNull(), F.struct("category", "amount"))
    months = spent.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_spent"))
    whole = F.col("owner_id").isNotNull() & F.col("currency").isNotNull() & F.col("month").isNotNull()
    found = F.when(whole, F.try_element_at("_spent", F.col("category")))
    cells = months.select(*keys, "_spent", listed)
    return cells.select(*keys, "category", F.coalesce(found, F.lit(0)).cast(SUM).alias("amount"))


def category_month_matrix(base: DataFrame, categories: DataFrame) -> DataFrame:
    """The cells with the totals of each category, each month and all of them."""
    cells = category_month_cells(base, categories)
    owner = [F.col("owner_id"), F.col("currency")]
    sets = [owner + s for s in ([F.col("category"), F.col("month")], [F.col("category")], [F.col("month")], [])]
    out = cells.groupingSets(sets, "owner_id", "currency", "category", "month").agg(
        F.sum("amount").cast(SUM).alias("amount")
    )
    return out.select(
        "owner_id",
        "currency",
        F.coalesce("category", F.lit("Total")).alias("category"),
        F.coalesce("month", F.lit("Total")).alias("month"),
        "amount",
    )


def category_month_view(base: DataFrame, categories: DataFrame, months: list[str]) -> DataFrame:
    """The matrix spread out: one row per category, one column per month."""
    cells = category_month_matrix(base, categories)
    return (
        cells.groupBy("owner_id", "currency", "category")
        .pivot("month", [*months, "Total"])
        .agg(F.sum("amount"))
        .na.fill(0)
    )


def category_month_lookup(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Cell values for (owner_id, currency, category, month) requests; absent is 0."""
    keys = ["owner_id", "currency", "category", "month"]
    return wanted.join(cells.select(*keys, "amount"), keys, "left").withColumn(
        "amount", F.coalesce("amount", F.lit(0)).cast(SUM)
    )


def expense_ratio(monthly: DataFrame) -> DataFrame:
    """Spending as a share of income: whole per cent, capped at +-999; NULL
    without income. ``over`` tells whether the uncapped share is above 100."""
    raw = F.when(F.col("income") > 0, F.col("total_expense") * 100 / F.col("income"))
    return monthly.select(
        "owner_id",
        "currency",
        "month",
        # greatest and least skip NULLs, so the missing share is kept apart.
        F.when(
            raw.isNotNull(),
            F.greatest(F.least(F.floor(raw + F.lit("0.5").cast("decimal(2,1)")), F.lit(999)), F.lit(-999)),
        )
        .cast("int")
        .alias("ratio_pct"),
        (F.abs(raw) > 999).alias("capped"),
        (raw > 100).alias("over"),
    )


def tag_surplus(monthly: DataFrame) -> DataFrame:
    """Months whose tagged spending is above their total spending.

    A tagged charge that later becomes a transfer keeps its tag, so this can
    happen; it is reported, not mended.
    """
    surplus = F.col("fijo_total") + F.col("variable_total") - F.col("total_expense")
    return monthly.filter(surplus > 0).select("owner_id", "currency", "month", surplus.cast(SUM).alias("surplus"))


def kpi_tiles(monthly: DataFrame, totals: DataFrame) -> DataFrame:
    """Total wealth and the last month's income, spending and net."""
    last = monthly.groupBy("owner_id", "currency").agg(
        F.max_by(F.struct("month", "income", "total_expense", "net"), "month").alias("m")
    )
    return last.join(totals, ["owner_id", "currency"], "full").select(
        "owner_id",
        "currency",
        "total",
        F.col("m.month").alias("last_month"),
        F.col("m.income").alias("income"),
        F.col("m.total_expense").alias("total_expense"),
        F.col("m.net").alias("net"),
    )


def search_transactions(
    ledger: DataFrame,
    accounts: DataFrame,
    categories: DataFrame,
    account: str | None = None,
    category: str | None = None,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    limit: int = 200,
) -> DataFrame:
    """Newest transactions first. Names join the rows that are left by the limit,
    unless a name is what is searched for; rows without an account do not count for it."""
    rows = in_dates(ledger, date_from, date_to)
    names = accounts.select("account_id", F.col("name").alias("account"))
    labels = categories.select("category_id", F.col("name").alias("category"))
    if account is not None:
        rows = only_named(rows, "account_id", names, "account", account)
    else:
        rows = rows.join(names.select("account_id"), "account_id", "left_semi")
    if category is not None:
        rows = only_named(rows, "category_id", labels, "category", category)
    order = [F.desc("date"), F.asc("id")]
    top = rows.orderBy(*order).limit(limit)
    return (
        top.join(names, "account_id")
        .join(labels, "category_id", "left")
        .select("id", "account", "date", "amount", "currency", "description", "category")
        .orderBy(*order)
    )


def export_ledger(ledger: DataFrame, accounts: DataFrame, categories: DataFrame) -> DataFrame:
    """The denormalised ledger in the order of date and id."""
    rows = enrich(ledger, accounts, categories)
    empty = F.lit("")
    return rows.select(
        "id",
        "date",
        month_key(F.col("date")).alias("month"),
        "account",
        "institution",
        "currency",
        "amount",
        "description",
        F.coalesce("category", empty).alias("category"),
        F.coalesce(labelled(F.col("kind"), KIND_LABEL), empty).alias("kind"),
        F.coalesce(labelled(F.col("nature"), NATURE_LABEL), empty).alias("nature"),
        F.coalesce(labelled(F.col("spend_frequency"), FREQUENCY_LABEL), empty).alias("frequency"),
        F.coalesce("source_file", empty).alias("source_file"),
    ).orderBy("date", "id")


def write_export(export: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an export as parquet or as CSV with a header."""
    writer = export.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
