"""Operators against plain single-machine versions, on edge cases and on random series."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.functions import aero, bins, keys
from contrail.operators import asof, islands, series
from contrail.plans import assembly, compare, laws, manifest, quality, replay, reports, trajectory
from contrail.plans.views import Tables
from contrail.queries import QUERIES
from contrail.sources import tables

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def flight(spark, columns, schema, n=None, route="R", fid="F"):
    n = n or len(next(iter(columns.values())))
    rows = [(route, fid, at(i), float(i), *[columns[c][i] for c in columns]) for i in range(n)]
    return spark.createDataFrame(rows, f"route string, flight_id string, timestamp timestamp, time double, {schema}")


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("route", "flight_id", "timestamp").collect()]


def test_asof_nearest_like_brute_force(spark):
    r = random.Random(1)
    left = [("R", f"F{f}", at(r.randrange(0, 400) / 2), i) for i, f in enumerate([r.randrange(3) for _ in range(120)])]
    right = [("R", f"F{f}", at(r.randrange(0, 400) / 2), i, r.choice([None, float(i)])) for i, f in enumerate([r.randrange(3) for _ in range(60)])]
    a = spark.createDataFrame(left, "route string, flight_id string, timestamp timestamp, i int")
    b = spark.createDataFrame(right, "route string, flight_id string, timestamp timestamp, k int, v double")
    got = {x.i: x.v for x in asof.asof_nearest(a, b, {"v": (F.col("v"), 2.0)}, right_order=["k"]).collect()}
    for _, f, t, i in left:
        have = sorted((x[2], x[3], x[4]) for x in right if x[1] == f and x[4] is not None)
        behind, ahead = [x for x in have if x[0] <= t], [x for x in have if x[0] >= t]
        best = None
        if behind:
            best = ((t - behind[-1][0]).total_seconds(), behind[-1][2])
        if ahead and (best is None or (ahead[0][0] - t).total_seconds() < best[0]):
            best = ((ahead[0][0] - t).total_seconds(), ahead[0][2])
        assert got[i] == (best[1] if best and best[0] <= 2 else None)


def test_asof_ties_duplicates_and_exact_tolerance(spark):
    right = spark.createDataFrame([("R", "F", at(8), 1, 1.0), ("R", "F", at(8), 2, 2.0), ("R", "F", at(12), 3, 3.0), ("R", "F", at(12), 4, 4.0)], "route string, flight_id string, timestamp timestamp, k int, v double")
    left = spark.createDataFrame([("R", "F", at(x), x) for x in (10, 11, 8, 14, 15, 6)] + [("R", "G", at(8), 99)], "route string, flight_id string, timestamp timestamp, i int")
    got = {x.i: x.v for x in asof.asof_nearest(left, right, {"v": (F.col("v"), 2.0)}, right_order=["k"]).collect()}
    assert got == {10: 2.0, 11: 3.0, 8: 2.0, 14: 4.0, 15: None, 6: 1.0, 99: None}
    fwd = {x.i: x.v for x in asof.asof_forward(left, right, {"v": F.col("v")}, right_order=["k"]).collect()}
    assert fwd == {10: 3.0, 11: 3.0, 8: 1.0, 14: 4.0, 15: 4.0, 6: 1.0, 99: None}


def test_fills_like_pandas(spark):
    r = random.Random(2)
    v = [r.choice([None, None, float(i)]) for i in range(80)]
    d = series.with_rows(flight(spark, {"v": v}, "v double"))
    w, b = series.series(), series.backwards()
    out = d.select("route", "flight_id", "timestamp", series.forward_fill("v", w, 2).alias("f"), series.backward_fill("v", b, 1).alias("b"), series.fill_both("v", w, b).alias("fb"), series.interpolate("v", "rn", w, b).alias("ip"))
    s = pd.Series(v, dtype=float)
    for name, want in (("f", s.ffill(limit=2)), ("b", s.bfill(limit=1)), ("fb", s.ffill().bfill()), ("ip", s.interpolate(limit_direction="both"))):
        got = pd.Series([x[0] for x in ordered(out, name)], dtype=float)
        assert np.allclose(got, want, equal_nan=True), name
    empty = series.with_rows(flight(spark, {"v": [None, None]}, "v double"))
    assert ordered(empty.withColumn("x", series.interpolate("v", "rn", w, b, 0.0)), "x") == [(0.0,), (0.0,)]


@pytest.mark.parametrize("width", [4, 5, 120])
def test_rolling_like_pandas(spark, width):
    r = random.Random(3)
    v = [r.choice([None, r.random()]) for _ in range(300)]
    d, w, s = flight(spark, {"v": v}, "v double"), series.series(), pd.Series(v, dtype=float)
    out = d.select("route", "flight_id", "timestamp", *[series.rolling("v", w, width, h).alias(h) for h in ("mean", "min", "max", "median")])
    for h in ("mean", "min", "max", "median"):
        want = getattr(s.rolling(width, center=True, min_periods=1), h)()
        assert np.allclose(pd.Series([x[0] for x in ordered(out, h)], dtype=float), want, equal_nan=True), h


@pytest.mark.parametrize("n,width", [(300, 1), (300, 2), (300, 7), (300, 120), (299, 60), (300, 300), (300, 299), (5, 60), (61, 60), (1, 4)])
def test_extremes_by_blocks_are_those_of_frames(spark, n, width):
    r = random.Random(n + width)
    v = [r.choice([None, r.random(), r.random()]) for _ in range(n)]
    got = ordered(series.rolling_extremes(flight(spark, {"v": v}, "v double"), "v", width, "low", "high"), "low", "high")
    for i, (low, high) in enumerate(got):
        inside = [x for x in v[max(0, i - width // 2) : i + width - width // 2] if x is not None]
        assert (low, high) == (min(inside, default=None), max(inside, default=None)), i


def test_parabola_keeps_digits_far_into_a_series_and_holds_no_arrays(spark):
    n = 30_000
    y = (1e4 + np.cumsum(np.random.default_rng(1).normal(size=n))).tolist()
    d = series.quadratic_smooth(flight(spark, {"v": y}, "v double"), "v", "s", 51)
    assert "collect_list" not in d._jdf.queryExecution().executedPlan().toString()
    got = [x[0] for x in ordered(d, "s")]
    for i in (30, 76, 15_000, 29_900):
        k = np.arange(i - 25, i + 26)
        assert math.isclose(got[i], np.polyval(np.polyfit(k - i, np.array(y)[k], 2), 0), rel_tol=1e-11)


@pytest.mark.parametrize("n,width", [(40, 11), (40, 10), (11, 11), (12, 11), (22, 11), (13, 11), (200, 51), (9, 51), (8, 51), (3, 5), (2, 5)])
def test_parabola_is_least_squares(spark, n, width):
    r = np.random.default_rng(4)
    y = r.normal(size=n)
    got = np.array([x[0] for x in ordered(series.quadratic_smooth(flight(spark, {"v": y.tolist()}, "v double"), "v", "s", width), "s")])
    if n < 3:
        assert np.allclose(got, y)
        return
    m = (min(max(3, width + (width + 1) % 2), n - (n % 2 == 0)) - 1) // 2
    for i in range(n):
        c = min(max(i, m), n - 1 - m)
        k = np.arange(c - m, c + m + 1)
        assert math.isclose(got[i], np.polyval(np.polyfit(k - c, y[k], 2), i - c), abs_tol=1e-9)


def anchored(v, tol):
    out, i = [None] * len(v), 0
    while i < len(v):
        if v[i] is None:
            i += 1
            continue
        j = i
        while j < len(v) and v[j] is not None and abs(v[j] - v[i]) <= tol:
            out[j] = (i + 1, v[i])
            j += 1
        i = j
    return out


def test_plateaus_and_filled_rates(spark):
    r = random.Random(5)
    for _ in range(4):
        v = [r.choice([None, 0.0, 40.0, 60.0, 100.0, 140.0]) for _ in range(120)]
        d = flight(spark, {"v": v}, "v double")
        got = ordered(series.plateaus(d, "v", 50.0), "plateau_start", "plateau_value")
        assert got == [x or (None, None) for x in anchored(v, 50.0)]
        filled = [x[0] for x in ordered(series.fill_rate(d, "v", "o"), "o")]
        a = anchored(v, 50.0)
        first, last = next(i for i, x in enumerate(v) if x is not None), max(i for i, x in enumerate(v) if x is not None)
        for i, x in enumerate(v):
            if x is not None:
                assert filled[i] == x
            elif i < first or i > last:
                assert filled[i] == (v[first] if i < first else v[last])
            else:
                p, q = max(k for k in range(i) if v[k] is not None), min(k for k in range(i, len(v)) if v[k] is not None)
                assert math.isclose(filled[i], a[p][1] + (i - p) / (q - p) * (a[q][1] - a[p][1]))
    hold = series.fill_rate(flight(spark, {"v": [None, 5.0, None, None, 7.0, None, None, None]}, "v double"), "v", "o", bridge=False, hold_rows=2, fill=False)
    assert [x[0] for x in ordered(hold, "o")] == [None, 5.0, 5.0, 5.0, 7.0, None, None, None]
    ramp = series.fill_rate(flight(spark, {"v": [0.0, 0.0, 100.0, 100.0, 100.0]}, "v double"), "v", "o", ramp_rows=2)
    assert [x[0] for x in ordered(ramp, "o")] == [0.0, 0.0, 50.0, 100.0, 100.0]
    assert ordered(series.fill_rate(flight(spark, {"v": [None, None]}, "v double"), "v", "o"), "o") == [(None,), (None,)]


def test_islands_break_on_nulls_and_jumps_over_a_step(spark):
    v = [100.0, 149.0, 151.0, None, 151.0, 200.0, 250.0, 301.0, 1000.0]
    d = flight(spark, {"vz_sel": v}, "vz_sel double")
    e = islands.command_events(d, {"vz_sel": 50.0, "absent": 1.0}).orderBy("start_timestamp").collect()
    assert [(x.duration_s, x.value) for x in e] == [(2.0, 400 / 3), (3.0, (151 + 200 + 250 + 301) / 4), (0.0, 1000.0)]
    assert sum(1 for x in v if x is not None) == islands.value_islands(d, "vz_sel", 50.0).count()


def test_stable_segments_need_min_len_rows(spark):
    v = [1.0] * 10 + [9.0] + [2.0] * 9
    d = flight(spark, {"v": v, "alt": [30000.0] * 20}, "v double, alt double")
    got = islands.stable_segments(d, "v", 0.5, 4, "alt", 20000.0).orderBy("start_row").collect()
    assert [(x.start_row, x.end_row) for x in got] == [(2, 9), (14, 20)] and [x.var_mean for x in got] == [1.0, 2.0]
    assert islands.stable_segments(d, "v", 0.5, 9, "alt", 20000.0).count() == 0 and islands.stable_segments(d, "v", 0.5, 4, "alt", 30000.0).count() == 0
    painted = islands.paint(series.with_rows(d), islands.stable_segments(d, "v", 0.5, 4), "p")
    assert [x[0] for x in ordered(painted, "p")] == [None] + [1.0] * 8 + [None] * 4 + [2.0] * 7


def test_blocks_join_up_to_the_bridge(spark):
    rows = [("R", "F", 0.0, 10.0), ("R", "F", 3.0, 4.0), ("R", "F", 20.0, 30.0), ("R", "F", 40.1, 50.0)]
    b = islands.merge_blocks(spark.createDataFrame(rows, "route string, flight_id string, start_time double, end_time double"), 10.0)
    assert sorted((x.block_start, x.block_end) for x in b.collect()) == [(0.0, 30.0), (40.1, 50.0)]


def test_bins(spark):
    xs = [0.0, 0.05, 0.050001, 0.1, 0.15, 0.3, 0.95, 1.0, 1.1, None]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    want = [None if x is None or x > 1 else int(y) for x, y in zip(xs, pd.cut(pd.Series(xs, dtype=float), np.linspace(0, 1, 21), labels=False, include_lowest=True).fillna(-1), strict=True)]
    assert [r[0] for r in d.select(bins.phi_bin("x")).collect()] == want
    assert [r[0] for r in d.select(bins.phi_bin("x", closed="left")).collect()][:4] == [0, 1, 1, 2]
    halves = spark.createDataFrame([(x,) for x in (250.0, 750.0, -250.0, 1250.0, None)], "x double")
    assert [r[0] for r in halves.select(bins.to_step("x", 500.0)).collect()] == [0.0, 1000.0, -0.0, 1000.0, None]
    e = [0.0, 10.0, 20.0, 30.0]
    g = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 10.0, 19.9, 20.0, 99.0)], "x double").select(bins.distance_bin("x", e), bins.distance_label("x", e)).collect()
    assert [r[0] for r in g] == [0, 0, 1, 1, 2, 2] and g[2][1] == "10–20 nm"
    f = spark.createDataFrame([(" a320 ",), ("B739",), ("E75L",), ("bcs3",), ("ZZZZ",), (None,)], "t string").select(bins.family("t")).collect()
    assert [r[0] for r in f] == ["A320 family", "B737", "E-Jet", "A220", "Other", "Other"]


def test_atmosphere_and_speeds(spark):
    d = spark.createDataFrame([(0.0,), (5000.0,), (11000.0,), (12500.0,)], "h double")
    r = d.select(aero.isa_temperature("h").alias("t"), aero.isa_pressure("h").alias("p"), aero.cas_to_tas_kt(F.lit(250.0), "h").alias("tas"), aero.tas_to_cas_kt(aero.cas_to_tas_kt(F.lit(250.0), "h"), "h").alias("back"), aero.mach_to_tas_kt(F.lit(1.0), "h").alias("a")).collect()
    assert [round(x.t, 2) for x in r] == [288.15, 255.65, 216.65, 216.65] and abs(r[0].p - 101325) < 1e-6 and abs(r[2].p - 22632) < 2
    assert abs(r[0].tas - 250) < 1e-6 and all(abs(x.back - 250) < 1e-6 for x in r) and abs(r[0].a - 661.5) < 0.3
    assert abs(spark.range(1).select(aero.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0] - 6371 * math.pi / 2) < 1e-6


def test_keys_and_times(spark):
    d = spark.createDataFrame([("ab", " X 1 ", at(0)), ("ab", "  ", at(1)), ("ab", None, at(1))], "icao24 string, callsign string, firstseen timestamp")
    assert [r[0] for r in d.select(keys.flight_id("icao24", "callsign", "firstseen")).collect()] == ["X1_ab_1704067200", "NOCALL_ab_1704067201", "NOCALL_ab_1704067201"]
    t = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01 02:00:00+02:00",), ("2024-01-01T00:00:00",), ("no",)], "t string")
    assert [r[0] for r in t.select(keys.parse_time("t")).collect()] == [T0, T0, T0, None]


def test_clean_and_ensure_columns(spark):
    d = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (3.0, 3)], "x double, k int")
    assert [r[0] for r in tables.clean(d).orderBy("k").collect()] == [None, None, 3.0]
    want = spark.createDataFrame([], "x double, y string").schema
    assert tables.ensure_columns(d, want).columns == ["x", "y"] and tables.ensure_columns(d, want).first().y is None


def test_write_and_read_routes(spark, tmp_path):
    d = flight(spark, {"a": [1.0, 2.0]}, "a double").unionByName(flight(spark, {"a": [3.0]}, "a double", route="S", fid="G")).withColumn("nested", F.array("a"))
    p = str(tmp_path / "t")
    tables.write(d, p)
    tables.write(d, p)
    assert sorted(tables.read(spark, p).columns) == ["a", "flight_id", "route", "time", "timestamp"] and tables.read(spark, p).count() == 3
    assert tables.read_routes(spark, p, ["S"]).count() == 1 and tables.read_flight(spark, p, "R", "F").count() == 2 and tables.read_routes(spark, p, ["R", "S"], d.filter("route = 'R'")).count() == 2
    tables.write_payload(d.select("route", "nested", F.lit("routes").alias("part")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


QC_CASES = {
    "ok": {}, "excessive_timeline_duration": {"span": 9 * 3600}, "time_column_anomaly": {"time": 2.0}, "altitude_teleport_noise": {"jumps": True}, "no_operational_climb": {"phase": "LEVEL"}, "vertical_rate_lost": {"rate": 0.0},
    "missing_h_sel": {"h": None}, "broken_h_sel": {"h": 5000.0}, "h_sel_alt_mismatch": {"h": 15000.0},
}


@pytest.mark.parametrize("reason", QC_CASES)
def test_quality_reasons(spark, reason):
    c = QC_CASES[reason]
    n = 400
    alt = [30000.0 * min(1, i / 100) for i in range(n)]
    if c.get("jumps"):
        alt = [a if i % 40 else 20000.0 for i, a in enumerate(alt)]
    step = c.get("span", n - 1) / (n - 1)
    rows = [("R", "F", at(i * step), i * c.get("time", 1.0), alt[i], c.get("rate", 1000.0 if i < 100 else 0.0), c["h"] if "h" in c else 30000.0 if i % 3 else None, c.get("phase", "CLIMB" if i < 100 else "LEVEL")) for i in range(n)]
    d = spark.createDataFrame(rows, "route string, flight_id string, timestamp timestamp, time double, altitude double, vertical_rate double, h_sel double, phase string")
    r = quality.assess(d).first()
    assert r.qc_reason == reason and r.accepted == (reason == "ok")
    assert (r.h_sel_max_ft is None) == (reason not in ("ok", "broken_h_sel", "h_sel_alt_mismatch"))


def test_replay_of_a_constant_rate_is_a_straight_line(spark):
    n = 50
    d = flight(spark, {"altitude": [1000.0] * n, "vertical_rate": [600.0] * n, "vz_sel": [None if i == 20 else 600.0 for i in range(n)], "h_sel": [None] * n, "mach_sel": [None] * n, "cas_sel": [250.0] * n, "phase": ["GROUND"] * 5 + ["CLIMB"] * (n - 5)}, "altitude double, vertical_rate double, vz_sel double, h_sel double, mach_sel double, cas_sel double, phase string")
    r = replay.replay(d).orderBy("timestamp").collect()
    assert len(r) == n - 5 and r[0].replay_start_idx == 5 and r[0].t_s == 0
    assert all(math.isclose(x.gen_altitude_ft, 1000 + 10 * (k + 1 - (k >= 15))) for k, x in enumerate(r))
    full = replay.replay(d, start_phase=None, initial_ft=0.0).orderBy("timestamp").collect()
    assert len(full) == n and math.isclose(full[0].gen_altitude_ft, 10.0) and all(x.gen_tas_kt > 250 for x in full)
    m = replay.replay_metrics(replay.replay(d.withColumn("altitude", F.lit(1000.0)))).first()
    assert m.n == n - 5 and math.isclose(m.bias_ft, m.mae_ft)


def test_pool_distances(spark):
    a = spark.createDataFrame([("CLIMB", float(i), 1.0, float(i), 0.0) for i in range(60)], "phase string, h_ft double, gamma_deg double, tas_kt double, vz_fpm double")
    assert all(r.w1 == 0 for r in compare.compare_pools(a, a).collect())
    b = a.withColumn("h_ft", F.col("h_ft") + 7)
    w = {r["column"]: r.w1 for r in compare.quantile_distance(a, b).collect()}
    assert math.isclose(w["h_ft"], 7) and w["tas_kt"] == 0
    assert {r.w1 for r in compare.quantile_distance(a.limit(9), b).collect()} == {None} and {r.w1 for r in compare.quantile_distance(a.limit(10), b).collect()} != {None}
    k = compare.ks(a, b, "h_ft").first()
    assert math.isclose(k.statistic, 7 / 60) and 0 < k.p_value <= 1 and compare.ks(a, a, "h_ft").first().statistic == 0 and compare.ks(a.limit(49), b, "h_ft").first().statistic is None


def test_manifest(spark):
    d = spark.createDataFrame([("R", f"a{i}", f"C{i}", at(i), at(i + 10 * (i % 4))) for i in range(12)], "route string, icao24 string, callsign string, firstseen timestamp, lastseen timestamp")
    m = manifest.build(d, 3)
    assert [r.icao24 for r in m.orderBy("flight_id").collect()] == ["a11", "a3", "a7"] and m.first().status == "pending"
    more = manifest.build(d, 12)
    assert manifest.extend(m, more, 6).count() == 6
    with pytest.raises(ValueError):
        manifest.extend(m, more, 2)
    with pytest.raises(ValueError):
        manifest.extend(m, more, 99)


def test_lookups(spark):
    lib = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "h int, u int, v string")
    req = spark.createDataFrame([(1, 1), (1, 9), (9, 1), (9, 9)], "h int, u int")
    got = {(r.h, r.u): (r.level, r.pool) for r in laws.back_off(req, lib, [["h", "u"], ["h"], ["u"], []]).collect()}
    assert got == {(1, 1): (0, 1), (1, 9): (1, 2), (9, 1): (2, 2), (9, 9): (3, 3)}
    near = laws.nearest_key(spark.createDataFrame([("p", x) for x in (1.0, 5.0, 7.5, 99.0)], "g string, x double"), spark.createDataFrame([("p", 0.0), ("p", 10.0), ("p", 5.0)], "g string, k double"), "x", "k", ["g"])
    assert {r.x: r.k for r in near.collect()} == {1.0: 0.0, 5.0: 5.0, 7.5: 5.0, 99.0: 10.0}


def test_descent_closure_and_scaling(spark):
    d = flight(spark, {"vz_sel": [-600.0] * 30}, "vz_sel double")
    c = assembly.close_descent(d, 1000.0, 800.0, 25.0).orderBy("timestamp").collect()
    # The row that reaches 825 ft or less is the first to be level, so the height before it stays.
    assert c[-1].h_closed == 830.0 and sum(r.vz_closed < 0 for r in c) == 17
    rows = spark.createDataFrame([("R", "F", -600.0, 60.0), ("R", "F", -300.0, 120.0)], "route string, flight_id string, value double, duration_s double")
    assert sorted(r.value for r in assembly.scale_plateaus(rows, F.lit(-2400.0)).collect()) == [-1200.0, -600.0]
    assert {r.value for r in assembly.scale_plateaus(rows, F.lit(40.0)).collect()} == {0.0}


def test_resample_leaves_out_corrupt_spans_and_fills_gaps(spark):
    rows = [("R", "F", at(x), float(a)) for x, a in ((0.2, 100), (1.0, 110), (9.0, 190))] + [("R", "G", at(0), 1.0), ("R", "G", at(10 * 3600), 2.0)]
    d = trajectory.resample(spark.createDataFrame(rows, "route string, flight_id string, timestamp timestamp, altitude_ft double"), most_span_s=trajectory.MOST_SPAN_S)
    got = ordered(d, "flight_id", "time", "altitude", "Mach", "CAS")
    assert {x[0] for x in got} == {"F"} and [x[2] for x in got] == [100.0, 110.0, 110.0, 110.0, 190.0, 190.0, 190.0] and {x[3] for x in got} == {0.0} and {x[4] for x in got} == {None}


def test_transitions_cover_all_flights_and_limits_count_accepted_ones(spark):
    n = 130
    f = spark.range(n).select(F.lit("R").alias("route"), F.format_string("F%03d", "id").alias("flight_id"), F.col("id").alias("firstseen"), (F.col("id") >= 5).alias("accepted"))
    when = lambda c: (F.lit(T0.isoformat()).cast("timestamp") + F.make_dt_interval(secs=F.col(c)))
    ids = f.select("route", "flight_id")
    df = ids.crossJoin(spark.range(60)).select("route", "flight_id", when("id").alias("timestamp"), F.lit("DESCENT").alias("phase"), F.lit(9000.0).alias("h_sel"), F.lit(-500.0).alias("vz_sel"))
    events = ids.crossJoin(spark.range(2)).select("route", "flight_id", (F.col("id") * 20).alias("s"), F.lit("cas_sel").alias("command"), F.lit("DESCENT").alias("phase"), F.lit(20.0).alias("duration_s"), (250.0 + F.col("id") * 10).alias("value"))
    events = events.withColumn("start_timestamp", when("s")).drop("s")
    found = lambda d: sorted(r.flight_id for r in d.collect())
    assert found(laws.transition_library(events, df, f.drop("accepted"))) == [f"F{i:03d}" for i in range(n)]
    assert found(laws.transition_library(events, df, f, per_route=3)) == ["F005", "F006", "F007"]


def test_resample_grids_series_of_any_span(spark, tmp_path, tiny):
    rows = [("R", "G", at(x), float(a)) for x, a in ((0.5, 1), (3599, 2), (3600, 3), (10 * 3600, 5))] + [("R", "F", at(0), 1.0)]
    d = spark.createDataFrame(rows, "route string, flight_id string, timestamp timestamp, altitude_ft double")
    got = [x[0] for x in ordered(trajectory.resample(d).filter("flight_id = 'G'"), "timestamp")]
    want = {t for _, f, s, _ in rows if f == "G" for t in (at(x) for x in range(36001)) if abs((t - s).total_seconds()) <= 2}
    assert got == sorted(want)
    assert [(r.flight_id, r.span_s, r.reason) for r in trajectory.left_out(d).collect()] == [("G", 36000.0, "excessive_timeline_duration")]
    # The query keeps a supplier with more rows than eight hours have seconds.
    for table in Path(tiny).iterdir():
        (tmp_path / table.name).symlink_to(table)
    (tmp_path / "lineitem.parquet").unlink()
    spark.read.parquet(f"{tiny}/lineitem.parquet").withColumn("l_suppkey", F.lit(1).cast("long")).crossJoin(spark.range(6)).drop("id").write.parquet(str(tmp_path / "lineitem.parquet"))
    sparse = Tables(spark, str(tmp_path)).sparse
    assert sorted(r.span_s > trajectory.MOST_SPAN_S for r in trajectory.spans(sparse).collect()) == [True]
    lo, hi = (int(trajectory.spans(sparse).select(trajectory.seconds(c)).first()[0]) for c in ("lo", "hi"))
    known = [r[0] for r in sparse.filter("altitude_ft is not null").select(trajectory.seconds("timestamp")).collect()]
    want = {s for t in known for s in range(max(lo, math.ceil(t - 2)), min(hi, math.floor(t + 2)) + 1)}
    assert QUERIES["c3_resample"](spark, str(tmp_path)).count() == len(want) > 10000


def test_registers_and_ambiguity(spark):
    s = "struct<roll:double,TAS:double,track:double>"
    d = spark.createDataFrame([(1, (1.0, 400.0, 5.0), None), (2, None, (250.0, 0.7, 9.0)), (3, (1.0, 400.0, 5.0), (250.0, 0.7, 9.0))], f"k int, bds50 {s}, bds60 struct<IAS:double,Mach:double,heading:double>")
    d = d.withColumn("bds40", F.lit(None).cast("struct<selected_mcp:double,selected_fms:double,barometric_setting:double>")).withColumn("bds45", F.lit(None).cast("struct<static_temperature:double>"))
    got = {r.k: (r.IAS, r.TAS) for r in trajectory.registers(d).collect()}
    assert got == {1: (None, 400.0), 2: (250.0, None), 3: (None, None)}


def test_values_are_ordered_in_ranges_of_one_large_group(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([round(r.gauss(0, 5), 2), 1.0, 7.25]), i) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, v double, i int")
    for ranges in (1, 7, 64):
        got = d.select("g", "v", "i", series.value_range(d, "v", ranges=ranges).alias("_r")).collect()
        by = sorted(got, key=lambda x: x.v)
        assert all(x._r <= y._r for x, y in zip(by, by[1:], strict=False)) and len({x._r for x in got}) <= ranges
    cdf = {(x.g, x.v): x.cdf for x in series.empirical_cdf(d, "v", ["g"]).collect()}
    for g in ("a", "b", None):
        own = [v for k, v, _ in rows if k == g]
        assert all(abs(cdf[g, v] - sum(x <= v for x in own) / len(own)) < 1e-12 for v in set(own))
    keys = spark.createDataFrame([(g, float(k)) for g in ("a", None) for k in range(-12, 13, 5)], "g string, key double")
    near = {x.i: x.key for x in laws.nearest_key(d, keys, "v", "key", ["g"]).collect()}
    assert near == {i: min(range(-12, 13, 5), key=lambda k: (abs(k - v), k)) if g != "b" else None for g, v, i in rows}


def test_quantiles_of_groups_of_all_sizes(spark):
    rows = [(g, float(v) if v % 11 else None) for g, n in (("a", 1), (None, 2), ("b", 300), ("c", 40)) for v in (7 * i * i % 50 + 1 for i in range(n))] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    got = {r["g"]: (r["q"], r["count"]) for r in series.quantiles(df, "v", ["g"], at).collect()}
    want = {r["g"]: (r["q"], r["n"]) for r in df.filter("v is not null").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(x) for x in at])).alias("q"), F.count("v").alias("n")).collect()}
    assert set(got) == set(want) == {"a", None, "b", "c"}
    for g in want:
        assert got[g][1] == want[g][1] and got[g][0] == pytest.approx(want[g][0])
    assert series.quantiles(df.filter("v is null"), "v", [], at).collect()[0]["count"] is None


def test_intervals_of_any_length(spark):
    seconds = [0, 1, 3599, 3600, 3601, 90_000, 200_000, None]
    points = spark.createDataFrame([("k", i, s) for i, s in enumerate(seconds)] + [("other", 99, 5), (None, 100, 5)], "k string, i long, s long").withColumn("at", F.timestamp_seconds("s"))
    spans = [("k", 1, 0, 3600), ("k", 2, 3600, 100_000), ("k", 3, 10, 10), ("k", 4, 500, 2), ("k", 5, None, 9), (None, 6, 0, 10), ("k", 7, -7200, 300_000)]
    intervals = spark.createDataFrame(spans, "k string, j long, a long, b long").select("k", "j", F.timestamp_seconds("a").alias("lo"), F.timestamp_seconds("b").alias("hi"))
    got = sorted((r["i"], r["j"]) for r in asof.in_interval(points, intervals, ["k"], "at", "lo", "hi").collect())
    want = sorted((i, j) for i, s in enumerate(seconds) for k, j, a, b in spans if k and s is not None and a is not None and a <= s < b)
    assert got == want
    left = asof.in_interval(points, intervals, ["k"], "at", "lo", "hi", "left").collect()
    assert {r["i"] for r in left if r["j"] is None} == {7, 99, 100} and len(left) == len(want) + 3


def test_an_interval_of_fifty_years_is_a_few_rows(spark):
    year = 31_557_600
    points = spark.range(0, 60 * year, year // 8).select(F.lit("k").alias("k"), F.timestamp_seconds("id").alias("at"))
    spans = [("k", 1, 1000, 50 * year), ("k", 2, 10 * year, 10 * year + 900), ("k", 3, 20 * year, 20 * year + 40 * 3600)]
    intervals = spark.createDataFrame(spans, "k string, j long, a long, b long").select("k", "j", F.timestamp_seconds("a").alias("lo"), F.timestamp_seconds("b").alias("hi"))
    d = asof.in_interval(points, intervals, ["k"], "at", "lo", "hi")
    assert {r.j: r.n for r in d.groupBy("j").agg(F.count("*").alias("n")).collect()} == {1: 50 * 8 - 1, 2: 1, 3: 1}
    # The largest side of the join's left input: one row for each point and size of interval.
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence") == 1
    long = asof.in_interval(points, intervals.filter("j = 1"), ["k"], "at", "lo", "hi")
    assert long.count() == 50 * 8 - 1


def test_rows_within_blocks(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("a", 9.0, 4), ("b", 2.0, 5), ("c", 5.0, 6)], "k string, s double, i int")
    blocks = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 8.0), ("b", 2.5, 3.0), ("c", 5.0, 5.0)], "k string, block_start double, block_end double")
    got = {r.i: (r.block_start, r.block_end) for r in islands.with_block(df, "s", blocks, ["k"]).collect()}
    assert got == {1: (1.0, 2.0), 2: (1.0, 2.0), 3: (3.0, 8.0), 6: (5.0, 5.0)}


def test_payload_parts(spark):
    stats = spark.createDataFrame([("A_B", 3, 2, 1), ("B_C", 1, 1, 0)], "route string, manifest_rows long, done long, accepted long")
    flights = spark.createDataFrame([("A_B", "F1", "A320", "x", 1.0), ("A_B", "F2", None, "x", 1.0), ("Z_Z", "F3", "A320", "x", 1.0)], "route string, flight_id string, typecode string, family string, gc_nm double")
    airports = spark.createDataFrame([("A", "Alpha", 1.0, 2.0), ("C", "Gamma", 3.0, 4.0)], "icao string, name string, latitude double, longitude double")
    d = reports.payload(stats, flights, airports).collect()
    of = lambda p: [r for r in d if r.part == p]
    assert {r.route: r.flights_n for r in of("routes")} == {"A_B": 2, "B_C": 0} and {r.flight_id for r in of("flights")} == {"F1", "F2"}
    assert {r.icao: r.name for r in of("airports")} == {"A": "Alpha", "B": None, "C": "Gamma"}
    (total,) = of("summary")
    assert (total.total_routes, total.total_airports, total.total_accepted, total.total_done) == (2, 3, 1, 3)


def test_plateaus_of_more_starts_than_a_chunk(spark):
    n = 2 * series.CHUNK + 40
    values = [None if i % 97 == 5 else 100.0 * (i // 2 % 7) for i in range(2 * n)]
    df = spark.createDataFrame([("r", "f", i, v) for i, v in enumerate(values)], "route string, flight_id string, timestamp long, v double")
    got = [(r["plateau_start"], r["plateau_value"]) for r in series.plateaus(df, "v", 50.0).orderBy("timestamp").collect()]
    want, held = [], None
    for i, v in enumerate(values):
        held = None if v is None else held if held and abs(v - held[1]) <= 50 else (i + 1, v)
        want.append(held or (None, None))
    assert got == want


def test_magnitude_rises_with_the_value(spark):
    values = sorted({s * v for s in (-1, 1) for v in (0.0, 5e-324, 1e-300, 1e-9, 0.5, 0.9999999, 1.0, 1.0000001, 2.0, 3.5e4, 3.5001e4, 1.7e9, 1e300, 1.7e308)})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(series.magnitude(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) > 20


@pytest.mark.parametrize("values", [[800.0, 400.0, 50.0, 550.0, 400.0, 475.0, 0.0, 50.0, 50.0], [150.0, 775.0, 800.0, 450.0, 0.0, 925.0, 750.0, 175.0, 625.0]])
def test_a_value_at_the_outlier_limit_stays_however_the_deviation_is_rounded(spark, values):
    # The first row's frame holds all of them; it is exactly 1.5 deviations from their median, which doubles make a little less.
    middle, n = sorted(values)[len(values) // 2], len(values)
    assert 4 * (values[0] - middle) ** 2 * n**2 == 9 * (n * sum(v * v for v in values) - sum(values) ** 2)
    d = spark.createDataFrame([("r", "f", i, v) for i, v in enumerate(values)], "route string, flight_id string, timestamp long, v double")
    kept = {r.timestamp for r in trajectory.without_outliers(d, "v", factor=1.5).collect()}
    assert 0 in kept
