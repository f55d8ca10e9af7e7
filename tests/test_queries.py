"""Registered queries against their SQL twins, on the smallest tables; plans without Python or products of rows."""

import math
import re

import duckdb
import pytest

import __spark_entry__
from contrail import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, int | float) else str(v)
    return sorted(([cell(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_is_its_sql(spark, tiny, con, name):
    df = q.QUERIES[name](spark, tiny)
    want = con.sql(q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, want = plain([tuple(r) for r in df.collect()], df.columns), plain(want.fetchall(), want.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_without_sql_gives_rows(spark, tiny, name):
    assert q.QUERIES[name](spark, tiny).count() > 0


@pytest.mark.parametrize("name", ["j2_asof_grid", "c3_resample", "c5_cas_segments", "c15_replay_metrics", "q5_a15_quality", "l2_rate_height_joint", "d6_altitude_envelope", "w15_plateaus"])
def test_plans_have_no_python_and_no_product(spark, tiny, name):
    plan = q.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filters_and_columns_reach_the_scan(spark, tiny):
    d = spark.read.parquet(f"{tiny}/lineitem.parquet").filter("l_quantity > 10").select("l_suppkey", "l_quantity")
    plan = d.groupBy("l_suppkey").sum("l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
