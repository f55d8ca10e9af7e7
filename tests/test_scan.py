"""Scans and joins by time in slices: the same results as series by series, and one long series in many tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contrail.operators import asof, scan, series

T0 = datetime(2024, 1, 1)
K = list(series.KEYS)
PLAIN = "route string, flight_id string, timestamp timestamp, i long, v double, s string"


def rows(n, seed):
    r = random.Random(seed)
    return [("R", f"F{r.randrange(4)}", T0 + timedelta(seconds=r.randrange(-5000, 9000), microseconds=r.randrange(1000)), i, r.choice([None, None, float(i % 37)]), r.choice([None, "a", "b"])) for i in range(n)]


@pytest.mark.parametrize("slice_s", [1.0, 300.0, 1e6])
def test_scans_are_windows_over_the_series(spark, slice_s):
    d = spark.createDataFrame(rows(700, 1), PLAIN)
    w, up, down = series.series(), series.before(series.series()), series.before(series.backwards())
    want = d.select("i", F.row_number().over(w).alias("row"), F.last("v", True).over(up).alias("last"), F.last("s", True).over(down).alias("next"), F.sum("v").over(up).alias("sum"), F.min("v").over(up).alias("lo"), F.max("v").over(up).alias("hi"))
    running = {"row": ("row", None), "last": ("last", F.col("v")), "next": ("next", F.col("s")), "sum": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    got = scan.scanned(d, running, scan.slice_of(F.unix_micros("timestamp"), slice_s))
    at = {(r.flight_id, r.row): r for r in got.collect()}
    for r in at.values():
        assert r.last is None or at[r.flight_id, r.last.n].v == r.last.v
        assert r.next is None or (at[r.flight_id, r.next.n].s == r.next.v and r.next.n >= r.row)
    flat = got.select("i", "row", F.col("last.v").alias("last"), F.col("next.v").alias("next"), "sum", "lo", "hi")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, want.collect()))


def test_scans_of_nothing_and_of_a_name_that_is_there(spark):
    d = spark.createDataFrame([], PLAIN)
    assert scan.scanned(d, {"v": ("sum", F.col("v"))}, F.lit(0)).count() == 0
    got = scan.scanned(spark.createDataFrame(rows(50, 2), PLAIN), {"v": ("row", None)}, scan.slice_of(F.unix_micros("timestamp"), 60.0))
    assert got.columns.count("v") == 1 and got.filter("v is null").count() == 0


@pytest.mark.parametrize("slice_s", [7.0, 100.0])
def test_joins_in_slices_are_those_of_series(spark, slice_s):
    a, b = spark.createDataFrame(rows(300, 3), PLAIN), spark.createDataFrame(rows(400, 4), PLAIN)
    for values in ({"x": (F.col("v"), 2.5), "y": (F.struct("i"), 30.0)}, {"x": (F.col("v"), None), "y": (F.col("s"), 50.0)}):
        got = asof.asof_nearest(a, b, values, right_order=["i"], slice_s=slice_s)
        assert sorted(map(str, got.collect())) == sorted(map(str, asof.asof_nearest(a, b, values, right_order=["i"], slice_s=None).collect()))
    forward = {"x": F.col("v"), "k": F.col("i")}
    got = asof.asof_forward(a, b, forward, right_order=["i"], slice_s=slice_s)
    assert sorted(map(str, got.collect())) == sorted(map(str, asof.asof_forward(a, b, forward, right_order=["i"], slice_s=None).collect()))


def test_one_long_series_is_many_tasks(spark):
    n = 200_000
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("timestamp")
    long = spark.range(n).select(F.lit("R").alias("route"), F.lit("F").alias("flight_id"), at, F.when(F.col("id") % 50_000 == 7, F.col("id").cast("double")).alias("v"), "id")
    some = long.filter("id % 3 = 0").select(*K, "timestamp", F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = scan.scanned(long, {"row": ("row", None), "last": ("last", F.col("v"))}, scan.slice_of(F.unix_micros("timestamp"), 3600.0))
        near = asof.asof_nearest(long, some, {"k": (F.col("k"), 2.0)}, slice_s=3600.0)
        free = asof.asof_nearest(long, some, {"k": (F.col("k"), None)}, slice_s=3600.0)
        for d in (filled, near, free):
            sizes = [r[0] for r in d.groupBy(F.spark_partition_id()).count().select("count").collect()]
            assert sum(sizes) == n and len(sizes) == 4 and max(sizes) < n / 2
        assert filled.filter((F.col("row") != F.col("id") + 1) | (F.coalesce("last.v", F.lit(-1)) != F.when(F.col("id") < 7, -1).otherwise(F.floor((F.col("id") - 7) / 50_000) * 50_000 + 7))).count() == 0
        assert near.filter(F.col("k") != F.rint(F.col("id") / 3) * 3).filter(f"id < {n - 2}").count() == 0 and free.filter("k is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_grid_in_slices_is_that_of_one_slice(spark):
    from contrail.plans import trajectory

    r = random.Random(9)
    at = sorted({r.randrange(-900, 2500) + r.choice([0, 0.25, 0.5]) for _ in range(700)})
    known = lambda x, share: x if r.random() < share else None
    made = [("R", f"F{k % 2}", T0 + timedelta(seconds=t), known(1000.0 + t, 0.7), known(250.0 + k % 9, 0.05), known(0.7 + k % 5 / 100, 0.03), known(3000.0 + k, 0.01), known(64.0 * (k % 30), 0.2)) for k, t in enumerate(at)]
    d = spark.createDataFrame(made, "route string, flight_id string, timestamp timestamp, altitude_ft double, IAS double, Mach double, selected_mcp double, vertical_rate_fpm double")
    want = sorted(map(str, trajectory.resample(d, slice_s=1_000_000_000).collect()))
    assert len(want) > 1000 and sorted(map(str, trajectory.resample(d, slice_s=700).collect())) == want


def test_columns_are_dealt_once_and_slices_written(spark):
    """Values given by name are not copied beside their columns, and the rows of slices are not found again beside the scan."""
    d = spark.createDataFrame(rows(3, 120), PLAIN)
    part = scan.slice_of(F.unix_micros("timestamp"), 10.0)
    got = scan.scanned(d, {"last": ("last", "v"), "next": ("next", "v"), "top": ("max", "v")}, part)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "_v_" not in text and "_rows" not in text
    want = scan.scanned(d, {"last": ("last", F.col("v")), "next": ("next", F.col("v")), "top": ("max", F.col("v"))}, part)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("limit", [1, 3, 60])
def test_held_values_are_those_of_a_frame(spark, limit):
    d = series.with_rows(spark.createDataFrame(rows(400, 5), PLAIN), name="n")
    w = series.series()
    got = d.select(series.held("v", "n", w, limit).alias("held"), series.forward_fill("v", w, limit).alias("want")).collect()
    assert [r.held for r in got] == [r.want for r in got]


def test_rows_that_come_in_slices_stay_in_them(spark, monkeypatch):
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "ROWS_A_TASK", 50)
    d = spark.createDataFrame(rows(300, 6), PLAIN)
    left = d.withColumn("s", scan.slice_of(F.unix_micros("timestamp"), 600.0))
    got = asof.asof_nearest(left, d.select(*K, "timestamp", "v"), {"near": (F.col("v"), 30.0)}, slice_s=600.0, part="s", rows=600)
    w = series.series([*K, "s"], ["timestamp", "i"])
    text = got.withColumn("k", F.row_number().over(w))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    want = asof.asof_nearest(left, d.select(*K, "timestamp", "v"), {"near": (F.col("v"), 30.0)}, slice_s=None)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
