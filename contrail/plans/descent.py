"""Top of descent, positions of events, and progress along the flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions import aero
from contrail.functions.bins import family
from contrail.operators.asof import asof_nearest
from contrail.operators.series import KEYS, before, forward_fill, series

PHASES = ("GROUND", "CLIMB", "LEVEL", "DESCENT")


def top_of_descent(df: DataFrame, least_step_ft: float = 500.0, least_prior_ft: float = 5000.0, prefer_below_ft: float | None = 22000.0, keys=KEYS) -> DataFrame:
    """One row per flight: the first drop of the held h_sel by least_step_ft or more from least_prior_ft or more, to
    prefer_below_ft or less if there is one, else the first of any."""
    w = series(keys)
    d = df.withColumn("h_sel_ft", forward_fill("h_sel", w)).withColumn("h_sel_prev_ft", F.lag("h_sel_ft").over(w))
    d = d.withColumn("step_ft", F.col("h_sel_prev_ft") - F.col("h_sel_ft")).filter((F.col("step_ft") >= least_step_ft) & (F.col("h_sel_prev_ft") >= least_prior_ft))
    low = F.col("h_sel_ft") <= prefer_below_ft if prefer_below_ft is not None else F.lit(False)
    row = F.struct("timestamp", "h_sel_ft", "h_sel_prev_ft", "step_ft", F.when(low, "preferred_below_threshold").otherwise("first_drop").alias("tod_rule"), F.lit(prefer_below_ft).cast("double").alias("tod_threshold_ft"), F.col("altitude").alias("altitude_ft"), F.col("time").alias("time_s"))
    return d.groupBy(*keys).agg(F.min_by(row, F.struct((~low).alias("other"), F.col("timestamp"))).alias("e")).select(*keys, "e.*")


def with_position(events: DataFrame, track: DataFrame, tolerance_s: float = 30.0, ts: str = "timestamp", keys=KEYS, rows: int = 0) -> DataFrame:
    """events with latitude and longitude of the nearest row of the track, null if that is too far in time or has none. rows is
    about how many the track has, if they are many: slices are dealt() by it."""
    row = F.struct("latitude", "longitude")
    out = asof_nearest(events, track, {"_p": (row, tolerance_s)}, keys, ts, rows=rows)
    known = F.col("_p.latitude").isNotNull() & F.col("_p.longitude").isNotNull()
    return out.withColumn("latitude", F.when(known, F.col("_p.latitude"))).withColumn("longitude", F.when(known, F.col("_p.longitude"))).drop("_p")


def along_track(track: DataFrame, keys=KEYS) -> DataFrame:
    """The rows of a track with a position, with km flown so far, km in all and number of positions."""
    w = series(keys)
    d = track.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    leg = aero.haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), "latitude", "longitude")
    d = d.withColumn("_leg", F.coalesce(leg, F.lit(0.0))).withColumn("km", F.sum("_leg").over(before(w)))
    whole = Window.partitionBy(*keys)
    return d.withColumn("km_total", F.max("km").over(whole)).withColumn("points", F.count(F.lit(1)).over(whole)).drop("_leg")


def progress(events: DataFrame, track: DataFrame, ts: str = "timestamp", keys=KEYS, rows: int = 0) -> DataFrame:
    """events with flight_progress, the share of the track flown at the nearest row with a position; null if the track has
    fewer than two positions or no length, or if the event's own latitude is null (where it has one). rows as for with_position."""
    row = F.struct("km", "km_total", "points")
    out = asof_nearest(events, along_track(track, keys), {"_p": (row, None)}, keys, ts, rows=rows)
    share = F.when((F.col("_p.points") >= 2) & (F.col("_p.km_total") > 0), F.col("_p.km") / F.col("_p.km_total"))
    if "latitude" in events.columns:
        share = F.when(F.col("latitude").isNotNull(), share)
    return out.withColumn("flight_progress", share).drop("_p")


def to_destination(events: DataFrame, track: DataFrame, ends: DataFrame, ts: str = "timestamp", keys=KEYS, name: str = "phi_d", rows: int = 0) -> DataFrame:
    """events with phi_d = 1 - distance to the destination now over that at the first position, within 0..1. ends has, by
    route, the latitude and longitude of the destination. Null with fewer than two positions or 1 km or less to go. rows as for
    with_position."""
    e = ends.select("route", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    d = track.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).join(e, "route", "left")
    whole = Window.partitionBy(*keys)
    d = d.withColumn("_d", aero.haversine_km("latitude", "longitude", "_lat", "_lon"))
    d = d.withColumn("_d0", F.first("_d").over(whole.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_n", F.count(F.lit(1)).over(whole))
    out = asof_nearest(events, d, {"_p": (F.struct("_d", "_d0", "_n"), None)}, keys, ts, rows=rows)
    phi = F.when((F.col("_p._n") >= 2) & (F.col("_p._d0") > 1.0), aero.clip(1 - F.col("_p._d") / F.col("_p._d0"), 0.0, 1.0))
    return out.withColumn(name, phi).drop("_p")


def phase_seconds(df: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of each phase, one column each; null for none."""
    out = df.withColumn("_p", F.upper("phase")).groupBy(*keys).pivot("_p", list(PHASES)).count()
    return out.select(*keys, *[F.col(p).cast("double").alias(f"phase_{p.lower()}_s") for p in PHASES])


def enrich(df: DataFrame, track: DataFrame, manifest: DataFrame, aircraft: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flight metadata with phase seconds, top-of-descent events with position, phi_d and flight_progress)."""
    meta = manifest.join(aircraft.select("icao24", "typecode", "registration"), "icao24", "left").join(phase_seconds(df), list(KEYS), "left")
    events = to_destination(with_position(top_of_descent(df), track), track, ends)
    events = progress(events, track).withColumn("flight_progress", F.when(F.col("phi_d").isNull(), F.col("flight_progress")))
    return meta, events.join(meta.select(*KEYS, "typecode"), list(KEYS), "left")


def flight_metadata(manifest: DataFrame, aircraft: DataFrame, lengths: DataFrame) -> DataFrame:
    """(route, flight_id, typecode, gc_nm, family)."""
    d = manifest.select(*KEYS, "icao24").join(aircraft.select("icao24", "typecode"), "icao24", "left").join(lengths.select("route", "gc_nm"), "route", "left")
    return d.select(*KEYS, "typecode", "gc_nm", family("typecode").alias("family"))


def route_lengths(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """(route, gc_km, gc_nm): great-circle length between the airports named by DEP_ARR."""
    a = airports.select("icao", "latitude", "longitude")
    parts = F.split("route", "_", 2)
    d = routes.select("route").distinct().withColumn("_dep", parts[0]).withColumn("_arr", parts[1])
    dep, arr = a.select(F.col("icao").alias("_dep"), F.col("latitude").alias("_a"), F.col("longitude").alias("_b")), a.select(F.col("icao").alias("_arr"), F.col("latitude").alias("_c"), F.col("longitude").alias("_d"))
    d = d.join(dep, "_dep", "left").join(arr, "_arr", "left").withColumn("gc_km", aero.haversine_km("_a", "_b", "_c", "_d"))
    return d.select("route", "gc_km", (F.col("gc_km") / aero.KM_NM).alias("gc_nm"))
