"""Every registered query against its SQL equivalent in DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.catalog import QUERIES
from tallyspark.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    if isinstance(value, (date, datetime)):
        return value.isoformat()[:10]
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    sql = entry.oracle_sql()[name]
    con = duck
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in places]) for r in cursor.fetchall())
    assert len(ours) == len(theirs) and ours == theirs


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "net" in df.columns


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(entry.oracle_sql()) <= set(entry.queries())
