from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.operators import classify as cl
from tallyspark.operators.classify import Rule

DDL = "id int, account_id long, date date, amount decimal(14,2), raw_description string, description string, category_id long, spend_frequency string"
CATS = [(1, "Food", "expense", None, None), (2, "Trips", "expense", None, None), (3, "Pay", "income", None, None), (4, "Move", "transfer", None, None)]


def rows(spark, *items):
    out = []
    for i, item in enumerate(items):
        base = {"date": date(2024, 5, 1), "amount": Decimal("-10"), "raw": None, "text": "", "cat": None, "tag": None, "account": 1}
        base.update(item)
        out.append((i, base["account"], base["date"], base["amount"], base["raw"], base["text"], base["cat"], base["tag"]))
    return spark.createDataFrame(out, DDL)


@pytest.fixture
def cats(spark):
    return spark.createDataFrame(CATS, schema.CATEGORY)


def run(df, rules, cats):
    return [r["category_id"] for r in cl.classify(df, rules, cats).orderBy("id").collect()]


def test_first_rule_wins_by_stage_then_priority(spark, cats):
    rules = [Rule(3, 2, 1, "Trips", "shop"), Rule(2, 1, 2, "Pay", "shop"), Rule(1, 1, 1, "Food", "shop x")]
    assert run(rows(spark, {"text": "SHOP X"}, {"text": "Shop y"}), rules, cats) == [1, 3]


def test_known_categories_stay(spark, cats):
    assert run(rows(spark, {"text": "shop", "cat": 4}), [Rule(1, 1, 1, "Food", "shop")], cats) == [4]


def test_missing_category_does_not_fall_through(spark, cats):
    rules = [Rule(1, 1, 1, "Ghost", "shop"), Rule(2, 1, 2, "Food", "shop")]
    assert run(rows(spark, {"text": "shop"}), rules, cats) == [None]


def test_of_equal_names_the_last_category_counts(spark, cats):
    twice = cats.unionByName(spark.createDataFrame([(9, "Food", "income", None, None)], schema.CATEGORY))
    out = cl.classify(rows(spark, {"text": "shop"}), [Rule(1, 1, 1, "Food", "shop")], twice)
    assert [r["category_id"] for r in out.collect()] == [9]


def test_anchored_rule_never_hits_without_raw_text(spark, cats):
    rules = [Rule(1, 1, 1, "Food", "^shop")]
    df = rows(spark, {"text": "shop"}, {"text": "x", "raw": "shop"})
    assert run(df, rules, cats) == [None, 1]
    audit = cl.rule_audit(df.limit(1), rules).first()
    assert audit["zero_hit"] and not audit["shadowed"]


def test_merged_rules_keep_alternatives_apart(spark, cats):
    rules = [Rule(1, 1, 1, "Food", "ab|cd"), Rule(2, 1, 2, "Food", "x$"), Rule(3, 1, 3, "Trips", "y")]
    assert len(cl.merged(rules)) == 2
    assert run(rows(spark, {"text": "cd"}, {"text": "zx"}, {"text": "xy"}), rules, cats) == [1, 1, 2]


def test_dates_are_inclusive_and_open_ended(spark, cats):
    lo, hi = date(2024, 5, 1), date(2024, 5, 31)
    df = rows(
        spark,
        {"text": "a", "date": lo}, {"text": "a", "date": hi}, {"text": "a", "date": date(2024, 4, 30)}, {"text": "a", "date": date(2024, 6, 1)},
    )
    assert run(df, [Rule(1, 1, 1, "Food", "a", valid_from=lo, valid_until=hi)], cats) == [1, 1, None, None]
    assert run(df, [Rule(1, 1, 1, "Food", "a", valid_from=lo)], cats) == [1, 1, None, 1]
    assert run(df, [Rule(1, 1, 1, "Food", "a", valid_until=lo)], cats) == [1, None, 1, None]


def test_sign_amount_and_second_pattern(spark, cats):
    df = rows(
        spark,
        {"text": "trip", "amount": Decimal("5")}, {"text": "trip"}, {"text": "zzz", "amount": Decimal("-20.00")},
        {"text": "zzz", "amount": Decimal("20.01")}, {"text": "acct rent"}, {"text": "acct"},
    )
    rules = [
        Rule(1, 1, 1, "Trips", "trip", sign=1),
        Rule(2, 2, 1, "Pay", "memo", abs_amount=Decimal("20.00")),
        Rule(3, 3, 1, "Food", "acct", pattern2="rent"),
    ]
    assert run(df, rules, cats) == [2, None, 3, None, 1, None]


def test_transfers_fold_accents_and_skip_accounts(spark, cats):
    accounts = schema.align_schema(spark.createDataFrame([(1, "Bank"), (2, "Card")], "account_id long, name string"), schema.ACCOUNT)
    df = rows(spark, {"text": "a JOSÉ PÉREZ"}, {"text": "jose perez", "account": 2}, {"text": "other"})
    out = cl.classify_transfers(df, accounts, ["jose perez"], "Move", cats, ["Card"])
    assert [r["category_id"] for r in out.orderBy("id").collect()] == [4, None, None]
    assert cl.classify_transfers(df, accounts, [], "Move", cats) is df


def test_frequency_only_on_untagged_spending(spark, cats):
    df = rows(
        spark,
        {"text": "rent", "cat": 1}, {"text": "shop", "cat": 1}, {"text": "rent"}, {"text": "rent", "amount": Decimal("1")},
        {"text": "rent", "cat": 3}, {"text": "rent", "cat": 4}, {"text": "rent", "cat": 1, "tag": "variable"},
    )
    out = cl.tag_frequency(df, cats, ["rent"]).orderBy("id").collect()
    assert [r["spend_frequency"] for r in out] == ["fijo", "variable", "fijo", None, None, None, "variable"]


def test_all_steps_are_idempotent_and_counted(spark, cats):
    accounts = schema.align_schema(spark.createDataFrame([(1, "Bank")], "account_id long, name string"), schema.ACCOUNT)
    df = rows(spark, {"text": "holder"}, {"text": "shop"}, {"text": "nothing"})
    args = (accounts, cats, ["holder"], "Move", [Rule(1, 1, 1, "Food", "shop")], ["shop"])
    once = cl.classify_all(df, *args)
    counts = cl.classification_counts(cl.classify_all(df, *args, trace=True)).first()
    assert tuple(counts) == (1, 1, 2)
    assert once.exceptAll(cl.classify_all(once, *args)).count() == 0
    assert tuple(cl.classification_counts(cl.classify_all(once, *args, trace=True)).first()) == (0, 0, 0)


def test_audit_finds_shadowed_rules(spark):
    rules = [Rule(1, 1, 1, "Food", "shop"), Rule(2, 1, 2, "Trips", "shop a"), Rule(3, 1, 3, "Trips", "zzz")]
    out = {r["rule_id"]: r for r in cl.rule_audit(rows(spark, {"text": "shop a"}, {"text": "shop b"}), rules).collect()}
    assert (out[1]["any_hits"], out[1]["first_hits"]) == (2, 2)
    assert out[2]["shadowed"] and out[2]["any_hits"] == 1 and out[3]["zero_hit"]


def test_rules_from_a_table_are_bounded(spark):
    df = spark.createDataFrame([(1, 1, 1, "Food", "a", date(2024, 1, 1))], "rule_id int, stage int, priority int, category string, pattern string, valid_from date")
    assert cl.rules_from_table(df) == [Rule(1, 1, 1, "Food", "a", valid_from=date(2024, 1, 1))]
    with pytest.raises(ValueError):
        cl.rules_from_table(df.union(df), limit=1)


def test_rule_audit_counts_lists_of_hits(spark):
    """Sums do not grow with the rules; a row that several rules hit counts for each of them."""
    rules = [cl.Rule(k, 1, k, "Travel" if k % 2 else "Dining", f"w{k}x") for k in range(40)]
    df = rows(spark, {"text": "w3x w20x"}, {"text": "w3x"}, {"text": "w20x w39x"}, {"text": "none"})
    audit = cl.rule_audit(df, rules)
    hit = {r["rule_id"]: (r["any_hits"], r["first_hits"], r["shadowed"]) for r in audit.collect() if not r["zero_hit"]}
    assert hit == {3: (2, 2, False), 20: (2, 1, False), 39: (1, 0, True)}
    assert audit.count() == 40
    assert audit._jdf.queryExecution().optimizedPlan().toString().count("sum(") + audit._jdf.queryExecution().optimizedPlan().toString().count("count(") < 10
