"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLE = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v + 0.0:.9f}" if isinstance(v, float) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    cur = sql.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_queries_without_sql_run(spark):
    queries = entry.queries()
    for name in (n for n in queries if n not in ORACLE and not n.startswith(("op", "pipeline"))):
        assert queries[name](spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
