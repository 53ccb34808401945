from __future__ import annotations

import os
import random
import time

from pyspark.sql import functions as F

from tallyspark.plans.ordered import block_of, carry_forward, running_sum
from tallyspark.plans.picks import first_per_key, last_per_key, without_known
from tallyspark.plans.small import only_named, small
from tallyspark.session import drop_staged, in_rounds, rounds_of, written


def hot_rows(n=600, seed=1):
    """Group 0 holds most rows; group None is a group of its own."""
    rng = random.Random(seed)
    groups = [rng.choice([0, 0, 0, 0, 1, 2, None]) for _ in range(n)]
    return [(g, i // 50, i, rng.randint(-9, 9), rng.choice([None, None, f"v{i}"])) for i, g in enumerate(groups)]


SCHEMA = "g int, day int, id long, v int, s string"


def test_running_sum_equals_plain_loop(spark):
    rows = hot_rows()
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA).withColumn("b", block_of(F.col("id"), 7))
    out = running_sum(df, ["g"], ["day", "b"], ["id"], F.col("v").cast("long"), "run")
    got = {r["id"]: r["run"] for r in out.collect()}
    total = {}
    for g, _, i, v, _ in rows:
        total[g] = total.get(g, 0) + v
        assert got[i] == total[g]
    assert len(got) == len(rows)


def test_carry_forward_equals_plain_loop(spark):
    rows = hot_rows(seed=3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("b", block_of(F.col("id"), 5)).repartition(7)
    out = carry_forward(df, ["g"], "b", ["id"], F.col("s"), "last")
    got = {r["id"]: r["last"] for r in out.collect()}
    last = {}
    for g, _, i, _, s in rows:
        last[g] = s or last.get(g)
        assert got[i] == last[g]


def test_picks_treat_null_as_a_key(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), (1, 5, "c"), (1, 6, "d")], "k int, o int, t string")
    assert {r["t"] for r in first_per_key(df, ["k"], [F.col("o")]).collect()} == {"a", "c"}
    assert {r["t"] for r in last_per_key(df, ["k"], [F.col("o")]).collect()} == {"b", "d"}


def test_without_known_keeps_duplicates(spark):
    new = spark.createDataFrame([(1, None), (1, None), (2, None), (3, "x"), (3, "x")], "a int, b string")
    known = spark.createDataFrame([(1, None), (3, "y")], "a int, b string")
    assert sorted(r["a"] for r in without_known(new, known, ["a", "b"]).collect()) == [2, 3, 3]
    assert sorted(r["a"] for r in without_known(new, known, ["a", "b"], null_safe=False).collect()) == [1, 1, 2, 3, 3]


def test_small_hints_only_below_the_bound(spark):
    df = spark.range(10)
    assert "broadcast" in small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_only_named_agrees_on_both_sides_of_the_bound(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(12)], "id int, k int")
    named = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "k int, n string")
    a = only_named(rows, "k", named, "n", "x").collect()
    b = only_named(rows, "k", named, "n", "x", max_ids=1).collect()
    assert sorted(r["id"] for r in a) == sorted(r["id"] for r in b) and len(a) == 8
    assert only_named(rows, "k", named, "n", "none").count() == 0


def test_no_plan_gathers_the_ledger_in_one_task(spark):
    """Windows always have a partition key, and no join is a nested loop."""
    from tallyspark.catalog import QUERIES

    for name, query in QUERIES.items():
        df = query(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        if name not in ("rule_audit", "rule_audit_many", "classification_counts"):
            assert "SinglePartition" not in plan, name


def test_staged_tables_are_removed(spark):
    table = written(spark.range(3))
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 3 and os.path.exists(path)
    assert drop_staged(spark) >= 1 and not os.path.exists(path)


def test_shuffles_of_a_staged_table_are_removed(spark):
    """The files go when the table is whole; the setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        files = folders.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    first = held()
    rows = spark.range(1000).repartition("id")
    assert len(rows.collect()) == 1000 and held() - first
    first = held()
    assert written(rows).count() == 1000 and spark.conf.get(key, None) == setting
    # Only those of the count may be left; files are removed in the background.
    ends = time.time() + 20
    while len(held() - first) > 4 and time.time() < ends:
        time.sleep(0.1)
    assert sum(1 for n in held() - first) <= 4


def test_rounds_hold_every_row_once(spark):
    rows = spark.createDataFrame([(None if k % 5 == 0 else f"f{k % 7}", k) for k in range(50)], "file string, n int")
    counted = lambda some: some.groupBy("file").agg(F.count("*").alias("n"))
    once, often = (sorted(map(str, in_rounds(counted, "file", rows, rounds=n).collect())) for n in (1, 4))
    assert once == often and len(once) == 8
    assert rounds_of(written(rows)) == 1
