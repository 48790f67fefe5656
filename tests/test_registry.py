"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.run import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) == set(catalog.SQL)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.SQL])
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for refused in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert refused not in plan
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "horizon_minutes", "n", "mae_seconds", "median_seconds", "p90_seconds", "bias_seconds"]
    assert df.count() == 4
