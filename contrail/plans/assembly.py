"""Operators on assembled command timelines: grids of segments, integration, anchors and closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions import aero
from contrail.operators.series import KEYS, before, first_row, forward_fill, series, whole, with_rows

STEP_S, TOLERANCE_FT, HOLD_S, FLAT_FT = 1.0, 25.0, 60.0, 50.0


def expand_segments(segments: DataFrame, order: str, step_s: float = STEP_S, hold_s: float = HOLD_S, keys=KEYS) -> DataFrame:
    """(keys, at, value): segments laid end to end on a grid of step_s, at least one step each; unknown or non-positive
    durations last hold_s. at counts steps from 0."""
    d = segments.withColumn("_d", F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(hold_s))
    d = d.withColumn("_n", F.greatest(F.rint(F.col("_d") / step_s), F.lit(1.0)).cast("long"))
    ahead = F.sum("_n").over(series(keys, [order]).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_from", F.coalesce(ahead, F.lit(0)))
    return d.select(*keys, F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)).alias("at"), F.col("value").cast("double").alias("value"))


def merge_series(parts: dict[str, DataFrame], keys=KEYS) -> DataFrame:
    """Several (keys, timestamp, value) series on the union of their times, one column each."""
    long = None
    for name, p in parts.items():
        one = p.select(*keys, "timestamp", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"))
        long = one if long is None else long.unionByName(one)
    return long.groupBy(*keys, "timestamp").pivot("name", list(parts)).agg(F.first("value", ignorenulls=True))


def fit_length(grid: DataFrame, lengths: DataFrame, first_value: str | None = None, keys=KEYS) -> DataFrame:
    """A painted series (keys, at, value) cut or padded to the n rows that lengths names; values are held over gaps and past
    the end, and the first row takes the column first_value of lengths where that is known."""
    want = lengths.filter("n > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"), *([first_value] if first_value else []))
    d = want.join(grid, [*keys, "at"], "left").withColumn("value", forward_fill("value", series(keys, ["at"])))
    if first_value:
        d = d.withColumn("value", F.when((F.col("at") == 0) & F.col(first_value).isNotNull(), F.col(first_value)).otherwise(F.coalesce("value", first_value))).drop(first_value)
    return d


def altitude_estimate(df: DataFrame, start_ft: Column | float, rate: str = "vz_sel", name: str = "h_est", step_s: float = STEP_S, keys=KEYS) -> DataFrame:
    """df with the altitude summed up from the rate, null rates counting as 0."""
    h0 = start_ft if isinstance(start_ft, Column) else F.lit(float(start_ft))
    return df.withColumn(name, h0 + F.sum(F.coalesce(rate, F.lit(0.0))).over(before(series(keys))) / 60.0 * step_s)


def top_of_climb(df: DataFrame, start_ft: Column | float = 0.0, tolerance_ft: float = TOLERANCE_FT, keys=KEYS) -> DataFrame:
    """(keys, toc_row, h_cruise): the first row (from 1) whose summed altitude reaches the highest h_sel less the tolerance;
    null if there is no h_sel or it is never reached."""
    d = altitude_estimate(with_rows(df, keys), start_ft, keys=keys).withColumn("h_cruise", F.max("h_sel").over(whole(keys)))
    return d.groupBy(*keys).agg(F.min(F.when(F.col("h_est") >= F.col("h_cruise") - tolerance_ft, F.col("rn"))).alias("toc_row"), F.max("h_cruise").alias("h_cruise"))


def with_ground_speed(df: DataFrame, start_ft: Column | float = 0.0, headwind_kt: float = 0.0, level_mach: float | None = None, keys=KEYS) -> DataFrame:
    """df with h_est and gs_kt, the speed by which distance is summed."""
    d = altitude_estimate(df, start_ft, keys=keys)
    return d.withColumn("gs_kt", aero.ground_speed_kt(aero.distance_tas_kt("mach_sel", "cas_sel", "h_est", "phase", level_mach), headwind_kt))


def row_at_share(df: DataFrame, share: Column | float, length_nm: Column, speed: str = "gs_kt", step_s: float = STEP_S, keys=KEYS) -> Column:
    """Row index (from 0) at which the distance flown reaches a share of length_nm; the number of rows if it never does. df
    must have rn."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    flown = F.sum(F.col(speed) * (step_s / 3600.0)).over(before(series(keys, ["rn"]))) / length_nm
    reached = F.when(flown >= F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.col("rn") - 1)
    return reached


def rows_at_share(df: DataFrame, share: Column | float, length_nm: Column, name: str = "at", keys=KEYS) -> DataFrame:
    """(keys, at) for each flight."""
    d = with_rows(df, keys)
    d = d.withColumn("_at", row_at_share(d, share, length_nm, keys=keys))
    return d.groupBy(*keys).agg(F.coalesce(F.min("_at"), F.count(F.lit(1))).alias(name))


def scale_plateaus(rows: DataFrame, target_ft: Column, flat_ft: float = FLAT_FT, keys=KEYS) -> DataFrame:
    """Rates (keys, value, duration_s) scaled so that they sum to target_ft; all 0 for a target within flat_ft, and as they
    are if they sum to less than a foot."""
    total = F.sum(F.col("value") * F.col("duration_s") / 60.0).over(Window.partitionBy(*keys))
    d = rows.withColumn("_sum", total).withColumn("_to", target_ft)
    return d.withColumn("value", F.when(F.abs("_to") <= flat_ft, 0.0).when(F.abs("_sum") < 1.0, F.col("value")).otherwise(F.col("value") * F.col("_to") / F.col("_sum"))).drop("_sum", "_to")


def close_descent(df: DataFrame, start_ft: Column | float, target_ft: float, tolerance_ft: float = TOLERANCE_FT, keys=KEYS) -> DataFrame:
    """df with vz_closed and h_closed: the rate is 0 from the first row at or below the target plus the tolerance."""
    d = altitude_estimate(with_rows(df, keys), start_ft, name="_h", keys=keys)
    hit = first_row(d, F.col("_h") <= target_ft + tolerance_ft, keys=keys)
    d = d.withColumn("_hit", hit).withColumn("vz_closed", F.when(F.col("rn") >= F.col("_hit"), 0.0).otherwise(F.coalesce("vz_sel", F.lit(0.0))))
    return altitude_estimate(d, start_ft, "vz_closed", "h_closed", keys=keys).drop("_h", "_hit", "rn")


def place_mach(df: DataFrame, up: float, down: float, mach: float, length_nm: Column, start_ft: Column | float = 0.0, keys=KEYS) -> DataFrame:
    """df with mach_placed, the Mach number between the rows at which two shares of the distance are reached (end excluded,
    one row at least), and up_ft and down_ft, the altitudes there."""
    d = with_rows(with_ground_speed(df, start_ft, level_mach=mach, keys=keys), keys)
    n = F.count(F.lit(1)).over(whole(keys))
    first = lambda s: F.coalesce(F.min(s).over(whole(keys)), n)
    d = d.withColumn("_u", row_at_share(d, up, length_nm, keys=keys)).withColumn("_d", row_at_share(d, down, length_nm, keys=keys))
    d = d.withColumn("_i", F.least(first("_u"), n - 1)).withColumn("_j", F.least(F.greatest(first("_d"), F.col("_i") + 1), n - 1))
    at = F.col("rn") - 1
    d = d.withColumn("mach_placed", F.when((at >= F.col("_i")) & (at < F.col("_j")), F.lit(float(mach))))
    for name, k in (("up_ft", "_i"), ("down_ft", "_j")):
        d = d.withColumn(name, F.max(F.when(at == F.col(k), F.col("h_est"))).over(whole(keys)))
    return d.drop("_u", "_d", "_i", "_j", "rn")


def climb_end(df: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, h_pre_max, cas_pre_last): the highest h_sel and the last CAS command."""
    return df.groupBy(*keys).agg(F.max("h_sel").alias("h_pre_max"), F.max_by("cas_sel", F.when(F.col("cas_sel").isNotNull(), F.col("timestamp"))).alias("cas_pre_last"))


def cruise_seconds(df: DataFrame, share: float, length_nm: Column, start_ft: Column | float = 0.0, level_mach: float | None = None, headwind_kt: float = 0.0, step_s: float = STEP_S, keys=KEYS) -> DataFrame:
    """(keys, need_s, h_cruise, cas_cruise): seconds of level flight after the given rows until the distance reaches the
    share; 0 if it has. Without a usable speed the fastest so far, or 200 kt, or 450 kt, is taken."""
    d = with_ground_speed(df, start_ft, headwind_kt, level_mach, keys).withColumn("_len", length_nm)
    g = d.groupBy(*keys).agg(
        F.sum(F.col("gs_kt") * (step_s / 3600.0)).alias("_nm"), F.max_by("h_est", "timestamp").alias("h_cruise"), F.max_by("cas_sel", F.when(F.col("cas_sel").isNotNull(), F.col("timestamp"))).alias("cas_cruise"),
        F.max("gs_kt").alias("_fast"), F.max("_len").alias("_len"),
    )
    speed = aero.ground_speed_kt(aero.distance_tas_kt(None, "cas_cruise", "h_cruise", F.lit("LEVEL"), level_mach), headwind_kt)
    speed = F.when(speed > 0, speed).otherwise(F.greatest(F.coalesce("_fast", F.lit(450.0)), F.lit(200.0)))
    need = F.lit(share) * F.col("_len") - F.coalesce("_nm", F.lit(0.0))
    return g.select(*keys, F.when(need <= 0, 0).otherwise(F.ceil(need / speed * 3600.0 / step_s) * int(step_s)).cast("long").alias("need_s"), "h_cruise", "cas_cruise")


def level_segment(df: DataFrame, needs: DataFrame, step_s: int = 1, keys=KEYS) -> DataFrame:
    """Rows of level flight of need_s seconds after the last row of each flight: rate 0, the cruise altitude (else the last
    h_sel) and the last CAS."""
    end = df.groupBy(*keys).agg(F.max("timestamp").alias("_t"), F.max_by("h_sel", F.when(F.col("h_sel").isNotNull(), F.col("timestamp"))).alias("_h"))
    d = needs.filter("need_s > 0").join(end, list(keys)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need_s"))).alias("_k"))
    ts = F.timestamp_micros(F.unix_micros(F.col("_t").cast("timestamp")) + F.col("_k") * (step_s * 1_000_000))
    return d.select(*keys, ts.alias("timestamp"), F.lit("LEVEL").alias("phase"), F.lit(0.0).alias("vz_sel"), F.coalesce("h_cruise", "_h").alias("h_sel"), F.col("cas_cruise").alias("cas_sel"), F.lit(None).cast("double").alias("mach_sel"))
