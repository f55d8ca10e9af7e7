"""Plateaus against a fold over the rows, in pieces of every size, with and without stretches that know nothing of each other."""

import random

import pytest
from pyspark.sql import functions as F

from contrail.operators import series

SCHEMA = "route string, flight_id string, timestamp long, v double"


def folded(values, tol):
    out, held = [], None
    for i, v in enumerate(values, 1):
        held = None if v is None else held if held and abs(v - held[1]) <= tol else (i, v)
        out.append(held or (None, None))
    return out


def noise(n, seed):
    r = random.Random(seed)
    return [None if r.random() < 0.02 else r.choice([0.0, 3000.0]) * (r.random() < 0.05) + r.uniform(-45, 45) for _ in range(n)]


SHAPES = {
    "noise": noise(400, 1),
    "steps": [100.0 * (i // 9 % 5) for i in range(90)],
    "ramp": [7.0 * i for i in range(60)],  # the folds of two pieces never meet
    "within": [float(i * 37 % 90) for i in range(60)],  # one stretch
    "at twice": [50.0 * (i % 3) for i in range(90)],
    "nulls": [None] * 30,
    "ends": [None, 1.0, 1.0, None],
    "one": [7.0],
}


@pytest.mark.parametrize("piece", [1, 17, series.PIECE])
def test_plateaus_are_those_of_a_fold(spark, piece):
    shapes = SHAPES if piece > 1 else {k: v[:5] for k, v in SHAPES.items()}
    df = spark.createDataFrame([("r", name, i, v) for name, values in shapes.items() for i, v in enumerate(values)], SCHEMA)
    got = {}
    for r in series.plateaus(df, "v", 50.0, piece=piece).orderBy("timestamp").collect():
        got.setdefault(r.flight_id, []).append((r.plateau_start, r.plateau_value))
    assert got == {name: folded(values, 50.0) for name, values in shapes.items()}


def test_a_tolerance_of_nothing_and_no_rows(spark):
    df = spark.createDataFrame([("r", "f", i, v) for i, v in enumerate([1.0, 1.0, 2.0, None, 2.0])], SCHEMA)
    assert [r.plateau_start for r in series.plateaus(df, "v", 0.0).orderBy("timestamp").collect()] == [1, 1, 3, None, 5]
    assert series.plateaus(df.limit(0), "v", 50.0).count() == 0


def test_one_series_of_half_a_million_changes(spark):
    n = 500_000
    # No two neighbours are more than twice the tolerance apart: one stretch of eight pieces.
    v = ((F.col("id") * 7919) % 83 + F.floor(F.col("id") / 4000)).cast("double")
    df = spark.range(n).select(F.lit("r").alias("route"), F.lit("f").alias("flight_id"), F.col("id").alias("timestamp"), v.alias("v"))
    got = series.plateaus(df, "v", 50.0).select("rn", "plateau_start", "plateau_value").toPandas().sort_values("rn")
    want = folded([float(i * 7919 % 83 + i // 4000) for i in range(n)], 50.0)
    assert list(zip(got.plateau_start, got.plateau_value)) == want
