"""Input tables for a trajectory predictor: targets, context, and both aligned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions import aero
from contrail.functions.keys import first_known
from contrail.operators.series import KEYS, whole, with_rows

STATE, CONTROL = ("raw_alt_m", "fdm_gamma_rad", "era_tas_ms", "fdm_heading_rad"), ("fdm_alt_target_m", "fdm_gamma_target_rad", "fdm_tas_target_ms", "fdm_heading_target_rad")
ENVIRONMENT = ("fdm_long_wind_ms", "era_temp_K", "era_u_wind_ms", "era_v_wind_ms")


def targets(df: DataFrame, keys=KEYS) -> DataFrame:
    """Command targets in SI units, each with a flag whether it is known."""
    c = df.columns
    alt, tas = first_known("h_sel", "fdm_alt_target_ft", present=c), first_known("tas_intent_kt", "fdm_tas_target_kt", present=c)
    gamma, heading = first_known("gamma_intent_rad", "fdm_gamma_target_rad", present=c), first_known("heading_target_rad", "fdm_heading_target_rad", present=c)
    flag = lambda x: x.isNotNull().cast("double")
    return df.select(
        *keys, "timestamp", (alt * aero.FT_M).alias("fdm_alt_target_m"), (tas * aero.KT_MS).alias("fdm_tas_target_ms"), gamma.alias("fdm_gamma_target_rad"), flag(gamma).alias("fdm_gamma_target_known"),
        flag(tas).alias("fdm_tas_target_known"), heading.alias("fdm_heading_target_rad"), flag(heading).alias("fdm_heading_target_known"), F.lit(0.0).alias("fdm_heading_known"),
    )


def gamma_or_ratio(df: DataFrame, keys=KEYS) -> Column:
    """The known flight path angle if the flight has any, else that of rate and airspeed."""
    c = df.columns
    known = first_known("observed_gamma_rad", "fdm_gamma_rad", "gamma_intent_rad", present=c)
    any_known = F.max(known.isNotNull().cast("int")).over(whole(keys)) == 1
    rate, tas = first_known("vertical_rate", "vertical_rate_fpm", "fdm_vz_sel_ftmin", present=c), first_known("observed_tas_kt", "tas_intent_kt", "fdm_tas_target_kt", present=c)
    return F.when(any_known, known).otherwise(aero.gamma_rad(rate, tas))


def context(df: DataFrame, keys=KEYS) -> DataFrame:
    """State and environment in SI units; winds default to 0, the temperature to the standard atmosphere."""
    c = df.columns
    alt, tas = first_known("altitude", "altitude_ft", "h_sel", present=c), first_known("observed_tas_kt", "TAS", "fdm_tas_target_kt", "tas_intent_kt", present=c)
    temp = aero.temperature_k(first_known("era_temp_K", "static_temperature", present=c), first_known("altitude", "altitude_ft", present=c))
    zero = lambda *n: F.coalesce(first_known(*n, present=c), F.lit(0.0))
    return df.select(
        *keys, "timestamp", (alt * aero.FT_M).alias("raw_alt_m"), (tas * aero.KT_MS).alias("era_tas_ms"), gamma_or_ratio(df, keys).alias("fdm_gamma_rad"), aero.heading_rad(first_known("heading", "track_deg", "track", present=c)).alias("fdm_heading_rad"),
        zero("fdm_long_wind_ms", "long_wind_ms").alias("fdm_long_wind_ms"), temp.alias("era_temp_K"), zero("era_u_wind_ms", "u_wind_ms").alias("era_u_wind_ms"), zero("era_v_wind_ms", "v_wind_ms").alias("era_v_wind_ms"),
    )


def aligned(commands: DataFrame, ctx: DataFrame, keys=KEYS) -> DataFrame:
    """Controls and environment row by row, by position, up to the shorter of both less the last row; the first row also has
    the initial state (x_*, unknown values 0). Flights of fewer than two common rows are left out."""
    a, b = with_rows(commands, keys), with_rows(ctx, keys).drop("timestamp")
    d = a.join(b, [*keys, "rn"])
    n = F.max("rn").over(whole(keys))
    d = d.withColumn("_n", n).filter((F.col("_n") >= 2) & (F.col("rn") < F.col("_n")))
    d = d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("fdm_heading_target_rad", *ENVIRONMENT)})
    d = d.withColumns({f"x_{c}": F.when(F.col("rn") == 1, F.coalesce(c, F.lit(0.0))) for c in STATE})
    return d.select(*keys, "rn", "timestamp", *[c for c in commands.columns if c not in (*keys, "timestamp")], *ENVIRONMENT, *[f"x_{c}" for c in STATE])


def incomplete(inputs: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, missing): flights with unknown controls, and how many rows; a strict caller rejects them."""
    bad = F.col(CONTROL[0]).isNull()
    for c in CONTROL[1:]:
        bad = bad | F.col(c).isNull()
    return inputs.groupBy(*keys).agg(F.count_if(bad).alias("missing")).filter("missing > 0")
