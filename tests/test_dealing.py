"""Large tables: rows a task, shuffles, and joins that Spark must not take through the driver."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from contrail.operators import islands, series
from contrail.sources import tables
from contrail.plans.views import Tables
from contrail.queries import QUERIES

COMMANDS = ("mach_sel", "cas_sel", "vz_sel")


@pytest.fixture
def everything_dealt(monkeypatch):
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "ROWS_A_TASK", 500)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark):
    r = random.Random(3)
    rows = [(f"F{k}", i, *[r.choice([None, 0.7, 0.71, 0.9]) for _ in COMMANDS]) for k in range(3) for i in range(60)]
    return spark.createDataFrame(rows, "flight_id string, t long, mach_sel double, cas_sel double, vz_sel double").select(F.lit("R").alias("route"), "flight_id", F.timestamp_seconds("t").alias("timestamp"), *COMMANDS)


def test_plateaus_join_nothing_by_broadcast(spark):
    d = series.fill_rate(grid(spark), "vz_sel", "filled", tol=0.1)
    assert "Broadcast" not in plan(d) and "SortMergeJoin" in plan(d)


def test_holding_without_bridges_looks_for_no_plateaus(spark):
    d = grid(spark)
    assert "Join" not in plan(series.fill_rate(d, "vz_sel", "held", bridge=False, hold_rows=3, fill=False))


def test_events_shuffle_rows_once_and_not_once_a_command(spark):
    d = grid(spark)
    steps = dict.fromkeys(COMMANDS, 0.01)
    found = islands.command_events(d, steps)
    text = plan(found)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and text.index("explode") < text.index("Exchange hashpartitioning")
    # The same as for each command by itself.
    for c in COMMANDS:
        one = islands.segments(islands.value_islands(d, c, 0.01), c, list(series.KEYS)).drop("island")
        assert sorted(map(tuple, found.filter(F.col("command") == c).drop("command").collect())) == sorted(map(tuple, one.collect()))


def test_a_task_has_about_as_many_rows_as_it_is_dealt(spark, tiny, everything_dealt):
    t = Tables(spark, tiny)
    track = t.track
    assert track.count() == t.rows and track.rdd.getNumPartitions() == -(-t.rows // 500)
    placed = track.select(*series.KEYS, F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == track.select(*series.KEYS).distinct().count()


@pytest.mark.parametrize("name", ["c6_rate_segments", "w14_stable_segments", "w8_parabola", "w5_rolling_spread", "c4_mach_segments"])
def test_windows_take_dealt_series_as_they_are(spark, tiny, everything_dealt, name):
    text = plan(QUERIES[name](spark, tiny))
    assert "REPARTITION_BY_NUM" in text and not re.search(r"hashpartitioning\(route.*ENSURE_REQUIREMENTS", text)


@pytest.mark.parametrize("name", ["j1_asof_nearest", "j2_asof_grid", "j6_asof_forward", "c3_resample", "c15_replay_metrics"])
def test_slices_of_joins_by_time_are_dealt_by_rows(spark, tiny, name, monkeypatch):
    want = sorted(map(repr, QUERIES[name](spark, tiny).collect()))
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "ROWS_A_TASK", 500)
    df = QUERIES[name](spark, tiny)
    assert re.search(r"hashpartitioning\(route[^)]*_part[^)]*\), REPARTITION_BY_NUM", plan(df))
    assert sorted(map(repr, df.collect())) == want


@pytest.mark.parametrize("name", ["w16_merge_blocks", "c14_replay"])
def test_no_window_shuffles_series_that_are_dealt(spark, tiny, everything_dealt, name):
    text = plan(QUERIES[name](spark, tiny))
    assert "REPARTITION_BY_NUM" in text and not re.search(r"hashpartitioning\(route.*ENSURE_REQUIREMENTS", text)


@pytest.mark.parametrize("name", ["c7_paint", "c5_cas_segments", "c6_selected_altitude"])
def test_painting_dealt_series_shuffles_and_joins_no_rows(spark, tiny, name, monkeypatch):
    want = sorted(map(repr, QUERIES[name](spark, tiny).collect()))
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "ROWS_A_TASK", 500)
    df = QUERIES[name](spark, tiny)
    assert "Join" not in plan(df) and not re.search(r"hashpartitioning\(route.*ENSURE_REQUIREMENTS", plan(df))
    assert sorted(map(repr, df.collect())) == want


def test_what_is_dealt_is_read_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "SCANNED_BYTES", 1 << 20)
    name, path = "spark.sql.files.maxPartitionBytes", "/root/testdata/sf0.1/lineitem.parquet"
    was = spark.conf.get(name)
    tasks = lambda: spark.read.parquet(path).rdd.getNumPartitions()
    try:
        for own in ("128MB", "134217728b", "1g"):
            spark.conf.set(name, own)
            assert tasks() < 10
            series.dealt(spark.read.parquet(path), 600_000, ["l_suppkey"])
            assert tasks() >= 10
        spark.conf.set(name, "512k")  # a bound of the session's own
        series.dealt(spark.read.parquet(path), 600_000, ["l_suppkey"])
        assert spark.conf.get(name) == "512k"
    finally:
        spark.conf.set(name, was)


def test_transitions_of_dealt_series_without_broadcasts(spark, tiny, monkeypatch):
    want = sorted(map(repr, QUERIES["l5_transitions"](spark, tiny).collect()))
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "ROWS_A_TASK", 500)
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")  # no side is small enough in large tables
    try:
        assert want and sorted(map(repr, QUERIES["l5_transitions"](spark, tiny).collect())) == want
    finally:
        spark.conf.set(name, was)


@pytest.mark.parametrize("name", ["w15_plateaus", "w21_fill_rate", "c8_extract_commands"])
def test_plateaus_of_dealt_series_join_no_rows_by_place(spark, tiny, name, monkeypatch):
    want = sorted(map(repr, QUERIES[name](spark, tiny).collect()))
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "ROWS_A_TASK", 500)
    df = QUERIES[name](spark, tiny)
    assert "Join" not in plan(df) and not re.search(r"hashpartitioning\(route[^)]*rn", plan(df))
    assert sorted(map(repr, df.collect())) == want


def test_what_is_written_leaves_no_shuffle_files(spark):
    name = tables.CLEANUP
    was, env = spark.conf.get(name), spark._jvm.org.apache.spark.SparkEnv.get()
    shuffled = lambda: {str(b) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllBlocks()) if str(b).startswith("shuffle")}
    before = shuffled()
    d = tables.settle(spark.range(5000).repartition(7, "id"))
    for _ in range(50):  # they are deleted in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and d.count() == 5000 and spark.conf.get(name) == was


def test_positions_of_tops_of_descent_are_dealt_by_rows(spark, tiny, monkeypatch):
    want = sorted(map(repr, QUERIES["l8_descent_phi"](spark, tiny).collect()))
    monkeypatch.setattr(series, "DEALT_FROM", 1)
    monkeypatch.setattr(series, "ROWS_A_TASK", 500)
    df = QUERIES["l8_descent_phi"](spark, tiny)
    assert re.search(r"hashpartitioning\(route[^)]*_part[^)]*\), REPARTITION_BY_NUM", plan(df))
    assert sorted(map(repr, df.collect())) == want
