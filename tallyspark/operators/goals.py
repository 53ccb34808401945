"""Savings goal, streak, typical month and linear projection.

All inputs are monthly rows, whose number per owner and currency is bounded by
the calendar, so windows over (owner, currency) stay small.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.functions.dates import month_key, months_to_year_end
from tallyspark.functions.money import SUM

# Savings rates in per cent, years and window of the projection.
TARGET_PCT = Decimal("15")
SCENARIOS = (("minimo", Decimal("15")), ("ambicioso", Decimal("30")))
MILESTONE_YEARS = (2026, 2027, 2028)
WINDOW_MONTHS = 12

OWNER = ["owner_id", "currency"]


def _share(amount: Column, pct: Column) -> Column:
    return F.round(amount * pct / F.lit(100), 2).cast(SUM)


def savings_goal(monthly: DataFrame, target_pct: Decimal = TARGET_PCT) -> DataFrame:
    """Target and result of each month; without income the result is NULL."""
    has_income = F.col("income") > 0
    pct = F.lit(target_pct).cast("decimal(5,2)")
    target = F.when(has_income, _share(F.col("income"), pct)).otherwise(F.lit(0).cast(SUM))
    return monthly.select(*OWNER, "month", "income", "net", target.alias("target_amount")).withColumn(
        "met", F.when(has_income, F.col("net") >= F.col("target_amount"))
    )


def current_streak(goal: DataFrame) -> DataFrame:
    """Months met without a break, counted back from the last month with a result."""
    back = Window.partitionBy(*OWNER).orderBy(F.desc("month"))
    judged = goal.filter(F.col("met").isNotNull())
    missed = judged.withColumn("_missed", F.sum((~F.col("met")).cast("int")).over(back))
    return missed.groupBy(*OWNER).agg(F.count_if(F.col("_missed") == 0).alias("current_streak"))


def savings_goal_summary(goal: DataFrame, target_pct: Decimal = TARGET_PCT) -> DataFrame:
    """Months judged and met, streak and rate over the judged months."""
    back = Window.partitionBy(*OWNER).orderBy(F.desc_nulls_last("month"))
    met = F.col("met")
    marked = goal.withColumn("_missed", F.sum(F.coalesce((~met).cast("int"), F.lit(0))).over(back))
    judged = met.isNotNull()
    income = F.sum(F.when(judged, F.col("income")))
    net = F.sum(F.when(judged, F.col("net")))
    return marked.groupBy(*OWNER).agg(
        F.count_if(judged).alias("months_evaluated"),
        F.count_if(met).alias("months_met"),
        F.count_if(judged & (F.col("_missed") == 0)).alias("current_streak"),
        F.coalesce(F.round(F.try_divide(net * 100, income), 2), F.lit(0)).cast("decimal(12,2)").alias(
            "historical_savings_rate_pct"
        ),
        F.lit(target_pct).cast("decimal(5,2)").alias("target_pct"),
    )


def trailing_window(monthly: DataFrame, as_of: date | str, months: int = WINDOW_MONTHS) -> DataFrame:
    """The last ``months`` rows other than ``as_of``'s own month (later months stay)."""
    closed = monthly.filter(F.col("month") != month_key(F.lit(as_of).cast("date")))
    back = Window.partitionBy(*OWNER).orderBy(F.desc("month"))
    return closed.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= months).drop("_n")


def _median(value: Column) -> Column:
    """Exact median, rounded to cents as a decimal."""
    return F.round(F.median(value.cast("double")).cast("decimal(20,3)"), 2).cast(SUM)


def projection_basis(monthly: DataFrame, as_of: date | str, months: int = WINDOW_MONTHS) -> DataFrame:
    """The typical month: median income (of months with income) and fixed spending."""
    return trailing_window(monthly, as_of, months).groupBy(*OWNER).agg(
        F.count("*").alias("window_months_used"),
        F.count_if(F.col("income") > 0).alias("income_months"),
        _median(F.when(F.col("income") > 0, F.col("income"))).alias("median_monthly_income"),
        _median(F.col("fijo_total")).alias("median_monthly_fijo"),
    )


def savings_projection(
    monthly: DataFrame,
    net_worth: DataFrame,
    as_of: date | str,
    scenarios: tuple[tuple[str, Decimal], ...] = SCENARIOS,
    years: tuple[int, ...] = MILESTONE_YEARS,
    months: int = WINDOW_MONTHS,
) -> DataFrame:
    """One row per owner, currency, scenario and year.

    ``net_worth`` has one row per owner (``owner_id, current_net_worth``); owners
    without one start from zero. Owners without an income month keep their rows
    with NULL savings and ``has_sample`` false.
    """
    basis = projection_basis(monthly, as_of, months).join(net_worth, "owner_id", "left")
    worth = F.coalesce("current_net_worth", F.lit(0)).cast(SUM)
    options = F.array(
        *[F.struct(F.lit(n).alias("label"), F.lit(r).cast("decimal(5,2)").alias("rate_pct")) for n, r in scenarios]
    )
    spread = basis.select("*", F.explode(options).alias("s")).select("*", F.explode(F.array(*map(F.lit, years))).alias("year"))
    income, fixed = F.col("median_monthly_income"), F.col("median_monthly_fijo")
    saved = _share(income, F.col("s.rate_pct"))
    left = months_to_year_end(F.lit(as_of).cast("date"), F.col("year"))
    return spread.select(
        *OWNER,
        F.col("s.label").alias("label"),
        F.col("s.rate_pct").alias("rate_pct"),
        "year",
        "window_months_used",
        income,
        fixed,
        worth.alias("current_net_worth"),
        (F.col("income_months") > 0).alias("has_sample"),
        saved.alias("monthly_savings"),
        (income - fixed - saved).cast(SUM).alias("monthly_variable_budget"),
        left.alias("months_remaining"),
        (saved * left).cast(SUM).alias("cumulative_savings"),
        (worth + saved * left).cast(SUM).alias("projected_net_worth"),
    )


def scenario_budget(projection: DataFrame) -> DataFrame:
    """Monthly split of each scenario into fixed, variable and savings."""
    return projection.groupBy(*OWNER, "label").agg(
        F.first("median_monthly_fijo").alias("fixed"),
        F.first("monthly_variable_budget").alias("variable"),
        F.first("monthly_savings").alias("savings"),
    )


def scenario_matrix(
    projection: DataFrame, scenarios: tuple[tuple[str, Decimal], ...] = SCENARIOS
) -> DataFrame:
    """Cumulative savings: one row per year, one column per scenario."""
    return projection.groupBy(*OWNER, "year").pivot("label", [n for n, _ in scenarios]).agg(F.first("cumulative_savings"))
