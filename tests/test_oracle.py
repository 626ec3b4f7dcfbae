"""Every query with comparison SQL gives the same rows in Spark and DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLE = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    picked = [tuple(r[i] for i in order) for r in rows]
    return [cols[i] for i in order], sorted(picked, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, data, name):
    cur = duck.execute(ORACLE[name])
    want = table(cur.fetchall(), [d[0] for d in cur.description])
    df = QUERIES[name](spark, data)
    got = table([tuple(r) for r in df.collect()], df.columns)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_statement_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_point(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "rider_id" and df.count() > 0


def test_wide_table_has_all_columns(spark, data):
    assert len(QUERIES["pivot_features"](spark, data).columns) == 269
