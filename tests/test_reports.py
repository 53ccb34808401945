from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.operators import calendar, goals, reports as rp, wealth as wl

SHORT = "id long, account_id long, date date, amount decimal(14,2), currency string, category_id long, spend_frequency string"
CATEGORIES = [
    (1, "Food", "expense", "basico", None),
    (2, "Trips", "expense", "estilo_de_vida", None),
    (3, "Pay", "income", None, None),
    (4, "Move", "transfer", None, None),
]


def D(x):
    return Decimal(x)


@pytest.fixture
def world(spark):
    accounts = schema.align_schema(
        spark.createDataFrame([(1, 10, "A"), (2, 20, "B")], "account_id long, owner_id long, name string"), schema.ACCOUNT
    )
    ledger = spark.createDataFrame(
        [
            (1, 1, date(2024, 1, 5), D("1000"), "MXN", 3, None),
            (2, 1, date(2024, 1, 6), D("-300"), "MXN", 1, "fijo"),
            (3, 1, date(2024, 1, 7), D("-50"), "MXN", None, "variable"),
            (4, 1, date(2024, 1, 8), D("70"), "MXN", None, None),
            (5, 1, date(2024, 2, 1), D("-400"), "MXN", 2, "variable"),
            (6, 1, date(2024, 2, 2), D("500"), "MXN", 2, "variable"),
            (7, 1, date(2024, 3, 1), D("-10"), "MXN", 4, None),
            (8, 1, date(2024, 4, 1), D("-20"), "MXN", None, None),
            (9, 1, date(2024, 5, 1), D("-25"), "MXN", 4, "fijo"),
            (10, 1, date(2024, 1, 9), D("-9"), "USD", 1, None),
            (11, 2, date(2024, 1, 9), D("-1"), "MXN", 1, None),
        ],
        SHORT,
    )
    return ledger, accounts, spark.createDataFrame(CATEGORIES, schema.CATEGORY)


def monthly(world, owner=10, currency="MXN"):
    df = rp.monthly_summary(rp.monthly_base(*world), with_categories=True)
    return {
        r["month"]: r for r in df.filter((F.col("owner_id") == owner) & (F.col("currency") == currency)).collect()
    }


def test_months_that_exist(world):
    assert sorted(monthly(world)) == ["2024-01", "2024-02", "2024-04", "2024-05"]


def test_month_with_income_and_charges(world):
    jan = monthly(world)["2024-01"]
    assert (jan["income"], jan["uncategorized_expense"], jan["total_expense"], jan["net"]) == (
        D("1000"), D("50"), D("350"), D("650"),
    )
    assert [(c["category"], c["amount"]) for c in jan["categories"]] == [("Food", D("300"))]


def test_inflows_above_outflows_show_negative_spending(world):
    feb = monthly(world)["2024-02"]
    assert feb["total_expense"] == D("-100") and feb["net"] == D("100")
    assert feb["variable_total"] == D("-100")


def test_transfer_keeps_its_tag(world):
    may = monthly(world)["2024-05"]
    assert may["fijo_total"] == D("25") and may["total_expense"] == 0
    surplus = rp.tag_surplus(rp.monthly_summary(rp.monthly_base(*world))).collect()
    assert [(r["month"], r["surplus"]) for r in surplus] == [("2024-05", D("25"))]


def test_spending_adds_currencies_unless_told_otherwise(world):
    both = {r["category"]: r["amount"] for r in rp.spending_by_category(*world).filter("owner_id = 10").collect()}
    assert both == {"Food": D("309"), "Trips": D("-100"), "Sin categoría": D("70")}
    one = rp.spending_by_category(*world, currency="USD").filter("owner_id = 10").collect()
    assert [(r["category"], r["amount"]) for r in one] == [("Food", D("9"))]


def test_spending_range_is_inclusive(world):
    got = rp.spending_by_category(*world, date_from="2024-01-06", date_to="2024-01-07").filter("owner_id = 10").collect()
    assert {r["category"]: r["amount"] for r in got} == {"Food": D("300"), "Sin categoría": D("50")}


def test_sums_are_conserved(world):
    ledger, accounts, categories = world
    base = rp.monthly_base(ledger, accounts, categories)
    spent = rp.spending_by_category(ledger, accounts, categories).agg(F.sum("amount")).first()[0]
    rest = base.filter(
        F.coalesce(F.col("kind") != "expense", F.lit(True)) & ~(F.col("category_id").isNull() & F.col("is_charge"))
    ).agg(F.sum("amount")).first()[0]
    assert rest - spent == ledger.agg(F.sum("amount")).first()[0]


def test_matrix_is_dense_and_its_totals_add_up(world):
    m = rp.category_month_matrix(rp.monthly_base(*world, currency="MXN"), world[2]).filter("owner_id = 10")
    cells = {(r["category"], r["month"]): r["amount"] for r in m.collect()}
    assert cells[("Trips", "2024-01")] == 0 and cells[("Sin categoría", "2024-04")] == D("20")
    assert cells[("Food", "Total")] == D("300") and cells[("Total", "2024-02")] == D("-100")
    assert cells[("Total", "Total")] == D("270")
    assert len(cells) == (3 + 1) * (4 + 1)


def test_search_limit_has_a_total_order(spark, world):
    ledger, accounts, categories = world
    ledger = ledger.withColumn("description", F.lit("x"))
    got = rp.search_transactions(ledger, accounts, categories, limit=3).collect()
    assert [r["id"] for r in got] == [9, 8, 7]
    assert [r["id"] for r in rp.search_transactions(ledger, accounts, categories, category="Trips").collect()] == [6, 5]
    assert [r["id"] for r in rp.search_transactions(ledger, accounts, categories, account="B").collect()] == [11]
    same_day = rp.search_transactions(ledger, accounts, categories, date_from="2024-01-09", date_to="2024-01-09").collect()
    assert [r["id"] for r in same_day] == [10, 11]


def test_search_limit_is_filled_by_rows_with_an_account(spark, world):
    ledger, accounts, categories = world
    ledger = ledger.withColumn("description", F.lit("x"))
    stray = ledger.filter("id = 9").withColumn("id", F.lit(99).cast("long")).withColumn("account_id", F.lit(77).cast("long"))
    got = rp.search_transactions(ledger.unionByName(stray.withColumn("date", F.lit("2030-01-01").cast("date"))), accounts, categories, limit=3)
    assert [r["id"] for r in got.collect()] == [9, 8, 7]


def test_expense_ratio(spark):
    rows = [(1, "MXN", "a", D("0"), D("5")), (1, "MXN", "b", D("1"), D("50")), (1, "MXN", "c", D("200"), D("101"))]
    df = spark.createDataFrame(rows, "owner_id long, currency string, month string, income decimal(24,2), total_expense decimal(24,2)")
    got = {r["month"]: (r["ratio_pct"], r["capped"], r["over"]) for r in rp.expense_ratio(df).collect()}
    assert got == {"a": (None, None, None), "b": (999, True, True), "c": (51, False, False)}


MONTHLY = "owner_id long, currency string, month string, income decimal(24,2), fijo_total decimal(24,2), net decimal(24,2)"


def months(spark, rows):
    return spark.createDataFrame([(1, "MXN", m, D(i), D(f), D(n)) for m, i, f, n in rows], MONTHLY)


def test_goal_and_streak(spark):
    df = months(spark, [("2024-01", "100", "0", "10"), ("2024-02", "100", "0", "15"), ("2024-03", "0", "0", "-5"), ("2024-04", "100", "0", "40")])
    goal = goals.savings_goal(df)
    assert {r["month"]: r["met"] for r in goal.collect()} == {"2024-01": False, "2024-02": True, "2024-03": None, "2024-04": True}
    s = goals.savings_goal_summary(goal).first()
    assert (s["months_evaluated"], s["months_met"], s["current_streak"]) == (3, 2, 2)
    assert s["historical_savings_rate_pct"] == D("21.67")
    assert goals.current_streak(goal).first()["current_streak"] == 2


def test_goal_without_income(spark):
    s = goals.savings_goal_summary(goals.savings_goal(months(spark, [("2024-01", "0", "0", "-5")]))).first()
    assert (s["months_evaluated"], s["current_streak"], s["historical_savings_rate_pct"]) == (0, 0, 0)


def test_projection(spark):
    rows = [(f"2023-{m:02d}", "100", str(m), "0") for m in range(1, 13)] + [("2024-01", "400", "50", "0"), ("2024-02", "900", "9", "0")]
    worth = spark.createDataFrame([(1, D("1000"))], "owner_id long, current_net_worth decimal(24,2)")
    out = goals.savings_projection(months(spark, rows), worth, "2024-02-10", years=(2023, 2024)).collect()
    got = {(r["label"], r["year"]): r for r in out}
    low = got[("minimo", 2024)]
    # Twelve present months before the open one: February 2023 to January 2024.
    assert low["window_months_used"] == 12 and low["median_monthly_income"] == 100
    assert low["median_monthly_fijo"] == D("7.50") and low["monthly_savings"] == 15
    assert low["monthly_variable_budget"] == D("77.50")
    assert (low["months_remaining"], low["cumulative_savings"], low["projected_net_worth"]) == (10, 150, 1150)
    assert got[("ambicioso", 2023)]["cumulative_savings"] == -60


def test_trailing_window_keeps_later_months(spark):
    df = months(spark, [("2024-01", "1", "0", "0"), ("2024-02", "1", "0", "0"), ("2024-03", "1", "0", "0")])
    got = goals.trailing_window(df, "2024-02-15", 12).collect()
    assert sorted(r["month"] for r in got) == ["2024-01", "2024-03"]


def test_projection_without_income_is_marked(spark):
    df = months(spark, [("2024-01", "0", "5", "0")])
    worth = spark.createDataFrame([], "owner_id long, current_net_worth decimal(24,2)")
    out = goals.savings_projection(df, worth, "2024-02-10").collect()
    assert len(out) == 6 and not any(r["has_sample"] for r in out) and out[0]["monthly_savings"] is None


@pytest.fixture
def wealth(spark):
    accounts = schema.align_schema(
        spark.createDataFrame(
            [
                (1, 10, "Parent", "MXN", None, None), (2, 10, "Child", "MXN", 1, None),
                (3, 10, "Plan", "MXN", None, None), (4, 10, "Fixed", "MXN", None, D("500")), (5, 10, "Zero", "MXN", None, None),
            ],
            "account_id long, owner_id long, name string, currency string, parent_account_id long, principal decimal(14,2)",
        ),
        schema.ACCOUNT,
    )
    ledger = spark.createDataFrame(
        [(1, 2, date(2024, 1, 1), D("7"), "MXN", None, None), (2, 1, date(2024, 1, 1), D("5"), "USD", None, None)], SHORT
    )
    snaps = schema.align_schema(
        spark.createDataFrame(
            [
                (1, 1, date(2024, 1, 1), None, D("100"), "USD", "a.pdf"),
                (2, 1, date(2024, 2, 1), None, D("110"), "EUR", None),
                (3, 1, date(2024, 2, 1), None, D("999"), "EUR", "b.pdf"),
                (4, 1, date(2024, 1, 1), "x", D("50"), "MXN", "a.pdf"),
            ],
            "id long, account_id long, date date, sub_portfolio string, market_value decimal(14,2), currency string, source_file string",
        ),
        schema.HOLDING_SNAPSHOT,
    )
    equity = schema.align_schema(
        spark.createDataFrame(
            [(1, 3, date(2024, 1, 1), D("80"), "USD"), (2, 3, date(2024, 2, 1), None, "USD")],
            "id long, account_id long, date date, market_value decimal(14,2), currency string",
        ),
        schema.EQUITY_ENTRY,
    )
    alternative = schema.align_schema(
        spark.createDataFrame(
            [(4, date(2024, 1, 1), D("10"), "MXN"), (4, date(2024, 2, 1), D("5"), "MXN")],
            "account_id long, period_start date, proportional_income decimal(14,2), currency string",
        ),
        schema.ALTERNATIVE_ENTRY,
    )
    return ledger, snaps, equity, alternative, accounts


def test_balances_and_net_worth(wealth):
    balances = wl.account_balance(*wealth)
    got = {r["account_id"]: (r["balance"], r["currency"]) for r in balances.collect()}
    # Newest snapshot per sub-portfolio (lowest id on one date); currency of the first seen.
    assert got[1] == (D("165"), "EUR")
    # The newest equity statement has no value: nothing is added, no older one is used.
    assert got[3] == (D("0"), "MXN")
    assert got[4] == (D("500"), "MXN")
    listed = {r["account_id"]: r for r in wl.net_worth_by_account(balances).collect()}
    assert sorted(listed) == [1, 2, 4]
    assert listed[2]["excluded"] and listed[2]["caveats"] == ["folded_into_parent"]
    assert listed[1]["caveats"] == ["manual_value"] and listed[4]["caveats"] == ["principal_only"]
    totals = {r["currency"]: r["total"] for r in wl.net_worth(balances).collect()}
    assert totals == {"EUR": D("165"), "MXN": D("500")}


def test_balances_by_currency_do_not_mix(wealth):
    rows = wl.account_balance(*wealth, mode="by_currency").collect()
    got = {(r["account_id"], r["currency"]): r["balance"] for r in rows}
    assert got[(1, "USD")] == 5 and got[(1, "EUR")] == 110 and got[(1, "MXN")] == 50
    assert got[(4, "MXN")] == 500


def test_distribution_return(wealth):
    r = wl.distribution_return(wealth[3], wealth[4]).first()
    assert (r["initial_investment"], r["cash_distributed_to_date"], r["average_monthly_return_pct"]) == (500, 15, D("1.500"))


def test_running_balance_with_anchor(spark):
    ledger = spark.createDataFrame(
        [(3, 1, date(2024, 1, 2), D("-1")), (1, 1, date(2024, 1, 2), D("5")), (2, 1, date(2024, 1, 1), D("2"))],
        "id long, account_id long, date date, amount decimal(14,2)",
    )
    anchors = spark.createDataFrame([(1, D("100"))], "account_id long, opening decimal(14,2)")
    got = {r["id"]: r["balance"] for r in wl.running_balance(ledger, anchors).collect()}
    assert got == {2: 102, 1: 107, 3: 106}


def test_calendar_only_fills_cards(spark):
    accounts = schema.align_schema(
        spark.createDataFrame(
            [(1, "Card", True, 31, 20, "natural", None), (2, "Bank", False, None, None, None, 1)],
            "account_id long, name string, is_credit_card boolean, statement_cutoff_day int, payment_due_offset_days int,"
            " payment_due_offset_type string, parent_account_id long",
        ),
        schema.ACCOUNT,
    )
    card, bank = calendar.account_calendar(accounts, "2024-02-10").collect()
    assert card["next_cutoff_date"] == date(2024, 2, 29) and card["next_payment_due_date"] == date(2024, 3, 20)
    assert bank["next_cutoff_date"] is None and bank["parent"] == "Card"


def test_ledger_rows_are_made_before_their_order_is_joined(spark, tmp_path):
    """Only what a report uses meets the orders, not the columns it is made of."""
    from tallyspark.sources import bindings

    sf = str(tmp_path)
    spark.createDataFrame(
        [(1, 11, 3, 1, 10.0, "N", "O", "1997-05-02"), (1, 12, 4, 2, 20.0, "R", "F", "1997-06-02"), (9, 12, 4, 1, 5.0, "N", "O", None)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, "
        "l_linestatus string, l_shipdate string",
    ).write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(1, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{sf}/orders.parquet")
    found = bindings.ledger(spark, sf).select("account_id", "date", "amount", "currency", "category_id")
    got = sorted((r.account_id, str(r.date), str(r.amount), r.currency, r.category_id) for r in found.collect())
    assert got == [(7, "1997-05-02", "-10.00", "MXN", None), (7, "1997-06-02", "20.00", "MXN", 3)]
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    item = plan.children().head().output().mkString(",")
    assert "amount" in item and "l_partkey" not in item and "l_extendedprice" not in item


def test_matrix_reads_its_base_once(spark):
    base = spark.createDataFrame(
        [
            (1, "MXN", "2024-01", "Food", "expense", "fijo", True, D("-5")),
            (1, "MXN", "2024-01", "Pay", "income", None, False, D("9")),
            (1, "MXN", "2024-02", "Pay", "income", None, False, D("9")),
            (1, "MXN", "2024-03", None, None, None, True, D("-2")),
            (1, "MXN", "2024-04", "Move", "transfer", None, True, D("-2")),
            (None, "MXN", "2024-01", "Food", "expense", None, True, D("-7")),
        ],
        "owner_id int, currency string, month string, category string, kind string, spend_frequency string, is_charge boolean, amount decimal(24,2)",
    ).withColumn("category_id", F.when(F.col("category").isNotNull(), 1)).withColumn("month", F.reverse(F.reverse("month")))
    cells = rp.category_month_cells(base, spark.createDataFrame(CATEGORIES, "category_id int, name string, kind string, nature string, parent_id int"))
    got = {(r.owner_id, r.month, r.category): str(r.amount) for r in cells.collect()}
    assert len(got) == 4 * 3
    assert {k: v for k, v in got.items() if v != "0.00"} == {(1, "2024-01", "Food"): "5.00", (1, "2024-03", rp.UNCATEGORISED): "2.00"}
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1
