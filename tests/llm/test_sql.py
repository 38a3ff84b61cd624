"""The corpus queries that SQL can express, against DuckDB over whole tables."""

import duckdb
import pytest

from takewise.llm import entries

TABLES = ("documents", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entries.queries()[name](spark, sf)
    cursor = con.execute(entries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(cursor.fetchall(), key=repr)
