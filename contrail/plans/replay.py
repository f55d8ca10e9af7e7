"""Replay of commands by integration, and its errors against what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions import aero
from contrail.operators.asof import asof_nearest
from contrail.operators.series import KEYS, backward_fill, backwards, before, dealt, fill_both, first_row, forward_fill, series, whole, with_rows

RATE_LIMIT_FPM, START_PHASE = 4000.0, "CLIMB"
LEAST_SPEED_KT, LEAST_TAS_VALUES = 30.0, 10


def speed_holds(df: DataFrame, keys=KEYS, leak: bool = True) -> DataFrame:
    """df with mach_hold and cas_hold: the last command within the row's phase, then the next command of the whole flight
    (with leak) or of the phase."""
    p, r = series([*keys, "phase"]), backwards(keys if leak else [*keys, "phase"])
    out = {}
    for c, name in (("mach_sel", "mach_hold"), ("cas_sel", "cas_hold")):
        out[f"_{name}"] = forward_fill(c, p)
    d = df.withColumns(out)
    return d.withColumns({n: F.coalesce(f"_{n}", backward_fill(f"_{n}", r)) for n in ("mach_hold", "cas_hold")}).drop("_mach_hold", "_cas_hold")


def prepare(df: DataFrame, keys=KEYS) -> DataFrame:
    """Commands ready for replay: alt_sel_ft, cas_cmd_kt and mach_cmd with their fallbacks, and the filled rate in place of
    vz_sel where there is one."""
    have = set(df.columns)
    if "h_sel" in have:
        alt = fill_both("h_sel", series(keys), backwards(keys))
    elif "selected_mcp" in have:
        mcp = F.rint(F.col("selected_mcp") / 25.0) * 25.0
        alt = F.when(mcp.isNotNull(), mcp).otherwise(F.col("altitude"))
    else:
        alt = F.col("altitude")
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    d = df.filter(F.col("timestamp").isNotNull()).withColumn("alt_sel_ft", alt)
    d = d.withColumn("cas_cmd_kt", F.coalesce(col("cas_sel"), col("CAS"))).withColumn("mach_cmd", F.coalesce(col("mach_sel"), col("Mach"))).withColumn("phase", F.upper("phase"))
    return d.withColumn("vz_sel", F.col("vz_sel_replay")) if "vz_sel_replay" in have else d


def crossovers(df: DataFrame, keys=KEYS, default: float = aero.CROSSOVER_FT) -> DataFrame:
    """(keys, up_ft, down_ft): altitude at the first Mach command, and at the first CAS command after the last Mach command,
    or at that last one."""
    d = with_rows(df, keys)
    m, c = F.col("mach_sel").isNotNull(), F.col("cas_sel").isNotNull()
    d = d.withColumn("_last", F.max(F.when(m, F.col("rn"))).over(whole(keys)))
    alt = lambda cond, how: how(F.when(cond, F.struct("altitude")), F.when(cond, F.col("rn")))["altitude"]
    g = d.groupBy(*keys).agg(alt(m, F.min_by).alias("_u"), alt(m, F.max_by).alias("_m"), alt(c & (F.col("rn") > F.col("_last")), F.min_by).alias("_c"), F.max(m.cast("int")).alias("_any"))
    up = F.when(F.col("_any") == 1, F.coalesce("_u", F.lit(default))).otherwise(default)
    return g.select(*keys, up.alias("up_ft"), F.when(F.col("_any") == 1, F.coalesce("_c", "_m", up)).otherwise(default).alias("down_ft"))


def replay(df: DataFrame, start_phase: str | None = START_PHASE, limit_fpm: float = RATE_LIMIT_FPM, step_s: float = 1.0, initial_ft: float | None = None, crossover: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """Altitude and airspeed from the commands alone, from the first row of start_phase (the first row if there is none).
    The rate is clipped and summed; the airspeed follows the command of the regime at the replayed altitude, and keeps its
    last value where there is no command. One step is taken per row."""
    d = speed_holds(with_rows(prepare(df, keys), keys), keys)
    i0 = F.coalesce(first_row(d, F.col("phase") == start_phase, keys=keys), F.lit(1)) if start_phase else F.lit(1)
    d = d.withColumn("_i0", i0).filter(F.col("rn") >= F.col("_i0"))
    w = series(keys)
    rate = F.coalesce("vz_sel", F.lit(0.0))
    d = d.withColumn("cmd_vz_sel_fpm", rate).withColumn("cmd_vz_target_fpm", aero.clip(rate, -limit_fpm, limit_fpm))
    h0 = F.lit(float(initial_ft)) if initial_ft is not None else F.first("altitude").over(before(w))
    d = d.withColumn("gen_altitude_ft", h0 + F.sum("cmd_vz_target_fpm").over(before(w)) / 60.0 * step_s).withColumn("_h0", h0)
    if crossover is not None:
        d = d.join(crossover.select(*keys, F.col("up_ft").alias("crossover_alt_ft_up"), F.col("down_ft").alias("crossover_alt_ft_down")), list(keys), "left")
    else:
        d = d.withColumn("crossover_alt_ft_up", F.lit(aero.CROSSOVER_FT)).withColumn("crossover_alt_ft_down", F.lit(aero.CROSSOVER_FT))
    high = lambda alt: aero.high_regime(alt, "phase", "crossover_alt_ft_up", "crossover_alt_ft_down")
    d = d.withColumn("regime_high_alt", high("gen_altitude_ft"))
    d = d.withColumn("_tas", aero.tas_by_regime_kt("mach_hold", "cas_hold", "gen_altitude_ft", F.col("regime_high_alt")))
    d = d.withColumn("_tas0", F.first(aero.tas_by_regime_kt("mach_hold", "cas_hold", "_h0", high("_h0"))).over(before(w)))
    d = d.withColumn("gen_tas_kt", F.coalesce(forward_fill("_tas", w), "_tas0", F.lit(aero.FIRST_TAS_KT)))
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    return d.select(
        *keys, "timestamp", ((us - F.min(us).over(whole(keys))) / F.lit(1e6)).alias("t_s"), F.col("altitude").alias("obs_altitude_ft"), F.col("vertical_rate").alias("obs_vertical_rate_fpm"), "gen_altitude_ft",
        F.col("cmd_vz_target_fpm").alias("gen_rocd_fpm"), "gen_tas_kt", aero.flight_path_angle_deg("cmd_vz_target_fpm", "gen_tas_kt").alias("gen_gamma_deg"), "cmd_vz_sel_fpm", "cmd_vz_target_fpm",
        F.col("gen_tas_kt").alias("cmd_tas_target_kt"), F.coalesce("alt_sel_ft", "gen_altitude_ft").alias("cmd_alt_ft"), F.col("cas_cmd_kt").alias("cmd_cas_kt"), F.col("mach_cmd").alias("cmd_mach"), "phase",
        (F.col("_i0") - 1).alias("replay_start_idx"), "crossover_alt_ft_up", "crossover_alt_ft_down", "regime_high_alt",
    )


def with_observed(played: DataFrame, adsb: DataFrame, modes: DataFrame | None = None, keys=KEYS, tolerance_s: float = 2.0, rows: int = 0) -> DataFrame:
    """Replay rows with the nearest observed ground speed and true airspeed. rows as for asof_nearest."""
    have = lambda df, c: F.col(c) if df is not None and c in df.columns else F.lit(None).cast("double")
    out = asof_nearest(played, adsb, {"_a": (F.struct(have(adsb, "groundspeed_kt").alias("gs")), tolerance_s)}, keys, rows=rows)
    if modes is not None:
        out = asof_nearest(out, modes, {"_m": (F.struct(have(modes, "TAS").alias("tas")), tolerance_s)}, keys, rows=rows).withColumn("TAS", F.col("_m.tas")).drop("_m")
    else:
        out = out.withColumn("TAS", F.lit(None).cast("double"))
    return out.withColumn("groundspeed_kt", F.col("_a.gs")).drop("_a")


def _errors(name: str, unit: str, err: Column, bias: bool = False) -> list[Column]:
    out = [F.sqrt(F.avg(err * err)).alias(f"rmse_{unit}"), F.avg(F.abs(err)).alias(f"mae_{unit}"), F.count(err).alias(name)]
    return [*out, F.avg(err).alias(f"bias_{unit}")] if bias else out


def replay_metrics(played: DataFrame, adsb: DataFrame | None = None, modes: DataFrame | None = None, keys=KEYS, rows: int = 0) -> DataFrame:
    """Errors of altitude, flight path angle and airspeed by flight. The observed airspeed is the ground speed for flights
    with fewer than ten airspeeds; angles and airspeeds count where both speeds exceed 30 kt."""
    d = with_observed(played, adsb, modes, keys, rows=rows) if adsb is not None else played.withColumn("TAS", F.lit(None).cast("double")).withColumn("groundspeed_kt", F.lit(None).cast("double"))
    d = dealt(d, rows, keys)
    few = F.count("TAS").over(Window.partitionBy(*keys)) < LEAST_TAS_VALUES
    d = d.withColumn("_tas", F.when(few, F.col("groundspeed_kt")).otherwise(F.col("TAS")))
    fast = (F.col("_tas") > LEAST_SPEED_KT) & (F.col("gen_tas_kt") > LEAST_SPEED_KT)
    angle = aero.flight_path_angle_deg("gen_rocd_fpm", "gen_tas_kt") - aero.flight_path_angle_deg("obs_vertical_rate_fpm", "_tas")
    return d.groupBy(*keys).agg(*_errors("n", "ft", F.col("gen_altitude_ft") - F.col("obs_altitude_ft"), True), *_errors("n_gamma", "gamma_deg", F.when(fast, angle)), *_errors("n_tas", "tas_kt", F.when(fast, F.col("gen_tas_kt") - F.col("_tas"))))


def profile(played: DataFrame, source: str = "replay") -> DataFrame:
    """State profile (keys, timestamp, phase, h_ft, gamma_deg, tas_kt, vz_fpm) of a replay, generated or observed."""
    if source == "replay":
        h, g, t, v = F.col("gen_altitude_ft"), F.col("gen_gamma_deg"), F.col("gen_tas_kt"), F.col("gen_rocd_fpm")
    else:
        t = F.coalesce("TAS", "gen_tas_kt") if "TAS" in played.columns else F.col("gen_tas_kt")
        h, v = F.col("obs_altitude_ft"), F.col("obs_vertical_rate_fpm")
        g = aero.flight_path_angle_deg(v, t)
    return played.select(*KEYS, "timestamp", F.upper("phase").alias("phase"), h.alias("h_ft"), g.alias("gamma_deg"), t.alias("tas_kt"), v.alias("vz_fpm"))


def operational_pool(df: DataFrame, flights: DataFrame, n_per_route: int | None = None, source: str = "replay") -> DataFrame:
    """Profiles of the replays of the given flights (route, flight_id, typecode, firstseen), the first n_per_route of each
    route, each with its own crossover altitudes."""
    f = flights
    if n_per_route is not None:
        f = f.withColumn("_k", F.row_number().over(Window.partitionBy("route").orderBy("firstseen", "flight_id"))).filter(F.col("_k") <= n_per_route).drop("_k")
    d = df.join(f.select(*KEYS), list(KEYS), "left_semi")
    out = profile(replay(d, crossover=crossovers(d)), source)
    return out.join(f.select(*KEYS, "typecode"), list(KEYS)).withColumn("pool", F.lit("operational"))


