"""Each query with SQL against DuckDB, as rows of rounded values."""

import math

import duckdb
import pytest

from takewise.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_means_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """Means of 32 values in hundredths end in half a unit of the sixth digit; the rows come in another order, in parts."""
    con = duckdb.connect(config={"threads": 1})
    con.execute("""create table events as select i as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, i % 600 as user_id, 'view' as event_type,
      case when i % 601 <> 7 then hash(i) % 15000 / 100.0::double end as value from range(600 * 16) r(i)""")
    path = str(tmp_path / "events.parquet")
    con.execute(f"copy (select * from events order by hash(event_id + 1)) to '{tmp_path}/rows.parquet' (format parquet)")
    spark.read.parquet(f"{tmp_path}/rows.parquet").repartition(5).write.parquet(path)
    got = sorted(tuple(r) for r in catalogue.queries()["report_lines"](spark, str(tmp_path)).select("pair_id", "line_no", "line").collect())
    assert got == sorted(con.execute(f"select pair_id, line_no, line from ({catalogue.oracle_sql()['report_lines']})").fetchall())
