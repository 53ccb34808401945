"""Registered queries of the package against DuckDB, where SQL can express them."""

from __future__ import annotations

import duckdb
import pytest

from tallyspark.llm.oracle import ORACLE
from tallyspark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
