"""The ledger model's tables, derived from the given parquet tables.

Each function reads only the columns it needs; joins that a report does not use
(the part text, for instance) are left out unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyspark.functions.dates import month_key
from tallyspark.functions.money import MONEY, SUM, UNITS
from tallyspark.plans.small import spread

# The category dimension: (id, name, kind, nature).
CATEGORIES = (
    (1, "Housing", "expense", "basico"),
    (2, "Groceries", "expense", "basico"),
    (3, "Transport", "expense", "necesario"),
    (4, "Health", "expense", "necesario"),
    (5, "Dining", "expense", "estilo_de_vida"),
    (6, "Travel", "expense", "estilo_de_vida"),
    (7, "Salary", "income", None),
    (8, "Other income", "income", None),
    (9, "Own transfer", "transfer", None),
    (10, "Card payment", "transfer", None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def categories(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("category_id"),
            F.lit(n).alias("name"),
            F.lit(k).alias("kind"),
            F.lit(t).cast("string").alias("nature"),
            F.lit(None).cast("long").alias("parent_id"),
        )
        for i, n, k, t in CATEGORIES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts; the nation is the owner, its region the currency."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    region = F.col("n_regionkey")
    segment = F.col("c_mktsegment")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("account_id"),
        F.col("c_nationkey").cast("long").alias("owner_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("Bank "), F.col("n_name")).alias("institution"),
        F.when(segment.isin("BUILDING", "MACHINERY"), "transactional")
        .when(segment == "AUTOMOBILE", "investment_formal")
        .when(segment == "FURNITURE", "investment_informal")
        .otherwise("equity_compensation")
        .alias("kind"),
        F.when(region.isin(0, 1), "MXN").when(region.isin(2, 3), "USD").otherwise("EUR").alias("currency"),
        F.when((key % 10).isin(1, 2), key - key % 10).alias("parent_account_id"),
        (segment == "MACHINERY").alias("is_credit_card"),
        (1 + key % 31).cast("int").alias("statement_cutoff_day"),
        (10 + key % 15).cast("int").alias("payment_due_offset_days"),
        F.when(key % 2 == 0, "natural").otherwise("habil").alias("payment_due_offset_type"),
        F.when(key % 29 == 0, F.lit("50000.00").cast(MONEY)).alias("principal"),
        F.concat(F.lit("Contract C"), key.cast("string")).alias("notes"),
    )


def ledger(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Line items as signed transactions; ``text=True`` joins the part's words.

    Without the words a row is worked out before it meets its order, so that only the
    columns a report uses cross the network, not those they are made of."""
    item = table(spark, sf_dir, "lineitem")
    if text:
        item = spread(item)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if text:
        rows = item.join(orders, item.l_orderkey == orders.o_orderkey)
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
        rows = rows.join(part, rows.l_partkey == part.p_partkey)
    price = money("l_extendedprice")
    part_no, supplier, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    # Category 1 + part % 10, none for every 11th part; 1-6 expense, 7-8 income, 9-10 transfer.
    digit, unknown = part_no % 10, part_no % 11 == 0
    is_open = F.col("l_linestatus") == "O"
    one = lambda n: F.lit(n).cast("decimal(1,0)")  # noqa: E731  (small factors keep the product in a long)
    factor = (
        F.when(unknown | (digit >= 8), F.when(is_open, one(-1)).otherwise(one(1)))
        .when(digit <= 5, F.when(F.col("l_returnflag") == "R", one(1)).otherwise(one(-1)))
        .when(digit == 6, one(2))
        .otherwise(one(1))
    )
    amount = (price * factor).cast(MONEY)
    category = F.when(~unknown, 1 + digit)
    tag = F.when(supplier % 3 == 0, "fijo").otherwise("variable")
    is_spend = F.when(unknown, is_open & (F.col("l_extendedprice") > 0)).otherwise(digit <= 5)
    columns = [
        ((F.col("l_orderkey") * 8 + line) * 1048576 + (part_no * 509 + supplier) % 1048576).alias("id"),
        F.col("l_shipdate").cast("date").alias("date"),
        amount.alias("amount"),
        F.when(supplier % 20 == 0, "USD").when(supplier % 20 == 1, "EUR").otherwise("MXN").alias("currency"),
        category.alias("category_id"),
        F.when((is_spend & (line != 7)) | (part_no % 97 == 0), tag).alias("spend_frequency"),
        F.when(line % 3 != 0, F.col("l_orderkey").cast("string")).alias("external_ref"),
        F.concat(F.lit("s"), supplier.cast("string"), F.when(is_open, ".csv").otherwise(".pdf")).alias("source_file"),
        line.alias("source_row"),
    ]
    account = F.col("o_custkey").alias("account_id")
    if not text:
        rows = item.select(F.col("l_orderkey").alias("_order"), *columns)
        names = [c for c in rows.columns if c != "_order"]
        return rows.join(orders, F.col("_order") == F.col("o_orderkey")).select(names[0], account, *names[1:])
    columns += [
        F.col("p_name").alias("description"),
        F.when(supplier % 7 != 0, F.col("p_brand")).alias("raw_description"),
    ]
    return rows.select(columns[0], account, *columns[1:])


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated valuations of sub-portfolios; a NULL file is a manual one."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("sub_portfolio"),
        money("o_totalprice").alias("market_value"),
        F.when((F.col("o_custkey") + key) % 13 == 0, "EUR").otherwise("MXN").alias("currency"),
        F.when(key % 50 != 0, F.concat(F.lit("v"), (key % 40).cast("string"), F.lit(".pdf"))).alias("source_file"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as equity-plan statements."""
    events = table(spark, sf_dir, "events")
    value = money("value")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").cast("date").alias("date"),
        F.when(F.col("event_id") % 9 != 0, (value * 100).cast(MONEY)).alias("market_value"),
        value.alias("own_contribution"),
        F.col("value").cast(UNITS).alias("vested_units"),
        F.lit("USD").alias("currency"),
    )


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per supplier and month: revenue, net income and a 2 % share."""
    item = table(spark, sf_dir, "lineitem")
    first = F.trunc(F.col("l_shipdate").cast("date"), "month")
    price = money("l_extendedprice")
    kept = (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    entry = item.groupBy(F.col("l_suppkey").alias("account_id"), first.alias("period_start")).agg(
        F.sum(price).cast(SUM).alias("revenue"), F.sum(kept).cast(SUM).alias("net_income")
    )
    return entry.select(
        "account_id",
        "period_start",
        F.last_day("period_start").alias("period_end"),
        "revenue",
        (F.col("revenue") - F.col("net_income")).cast(SUM).alias("expenses"),
        "net_income",
        F.lit("0.0200").cast("decimal(6,4)").alias("participation_pct"),
        (F.col("net_income") * F.lit("0.02").cast("decimal(4,2)")).cast(SUM).alias("proportional_income"),
        F.lit("MXN").alias("currency"),
    )


def statement_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger cut into one statement file per account and month."""
    rows = ledger(spark, sf_dir)
    return rows.select(
        "account_id",
        statement_name().alias("source_file"),
        F.col("id").alias("source_row"),
        F.col("date").alias("op_date"),
        "amount",
        "currency",
    )


def statement_name() -> Column:
    return F.concat(F.lit("a"), F.col("account_id").cast("string"), F.lit("-"), month_key(F.col("date")), F.lit(".pdf"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed statements of those files, some of them with planted faults.

    Balances follow from the movements. Faults by account: 17 prints charges that
    are 1.00 too high, 19 one credit too many, 23 a closing balance 5.00 too high
    in every fourth month (which also breaks the chain to the next month).
    """
    month = F.trunc("date", "month")
    amount = F.col("amount")
    monthly = (
        ledger(spark, sf_dir)
        .groupBy("account_id", month.alias("period_start"))
        .agg(
            F.sum("amount").cast(SUM).alias("_delta"),
            F.sum(F.when(amount < 0, -amount).otherwise(0)).cast(SUM).alias("_charges"),
            F.sum(F.when(amount > 0, amount).otherwise(0)).cast(SUM).alias("_credits"),
            F.count_if(amount < 0).alias("_n_charges"),
            F.count_if(amount > 0).alias("_n_credits"),
        )
    )
    # One row per account and month from here on, so this window is bounded by the calendar.
    w = Window.partitionBy("account_id").orderBy("period_start").rowsBetween(Window.unboundedPreceding, 0)
    key = F.col("account_id")

    def fault(modulus: int, size: str) -> Column:
        return F.when(key % modulus == 0, F.lit(size).cast(SUM)).otherwise(F.lit("0.00").cast(SUM))

    run = F.sum("_delta").over(w).cast(SUM)
    return monthly.select(
        "account_id",
        F.concat(
            F.lit("a"), key.cast("string"), F.lit("-"), F.date_format("period_start", "yyyy-MM"), F.lit(".pdf")
        ).alias("source_file"),
        "period_start",
        F.last_day("period_start").alias("period_end"),
        (run - F.col("_delta")).cast(SUM).alias("opening"),
        (run + F.when(F.month("period_start") % 4 == 0, fault(23, "5.00")).otherwise(0)).cast(SUM).alias("closing"),
        (F.col("_charges") + fault(17, "1.00")).cast(SUM).alias("printed_charges"),
        F.col("_credits").cast(SUM).alias("printed_credits"),
        F.col("_n_charges").cast("int").alias("n_charges"),
        (F.col("_n_credits") + F.when(key % 19 == 0, 1).otherwise(0)).cast("int").alias("n_credits"),
    )
