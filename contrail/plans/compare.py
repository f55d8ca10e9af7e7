"""Comparison of two pools of trajectories: quantile and rank distances, bands and envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions.bins import phi_bin
from contrail.operators.series import KEYS, before, quantiles, value_range, with_totals_before

COLUMNS = ("h_ft", "gamma_deg", "tas_kt", "vz_fpm")
QUANTILES = [round(0.05 * i, 2) for i in range(1, 20)]
BAND = (0.1, 0.5, 0.9)
LEAST_VALUES, LEAST_KS = 10, 50


def _long(df: DataFrame, columns: Sequence[str], phase: Column) -> DataFrame:
    return df.select(phase.alias("phase"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("phase", "x.*").filter("v is not null")


def _w1(reference: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    # Both pools are ranked together, each group of each pool by itself.
    both = reference.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)))
    q, of = quantiles(both, "v", [*by, "_side"], QUANTILES), lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    d = q.groupBy(*by).agg(of(0, "q").alias("a"), of(0, "count").alias("n_a"), of(1, "q").alias("b"), of(1, "count").alias("n_b"))
    gaps = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / len(QUANTILES)
    enough = (F.col("n_a") >= LEAST_VALUES) & (F.col("n_b") >= LEAST_VALUES)
    return d.select(*by, F.when(enough, mean).alias("w1"))


def quantile_distance(reference: DataFrame, other: DataFrame, columns: Sequence[str] = COLUMNS, phase: str | None = None) -> DataFrame:
    """(column, w1): mean distance of 19 quantiles; null if either side has fewer than ten values."""
    pick = (lambda d: d.filter(F.upper("phase") == phase)) if phase else (lambda d: d)
    return _w1(_long(pick(reference), columns, F.lit("x")), _long(pick(other), columns, F.lit("x")), ["column"])


def compare_pools(reference: DataFrame, other: DataFrame, columns: Sequence[str] = COLUMNS, phases: Sequence[str] = ("CLIMB", "DESCENT", "LEVEL")) -> DataFrame:
    """(phase, column, w1) for each of the phases and for ALL rows. Rows of other phases count in ALL only."""
    both = lambda d: _long(d, columns, F.explode(F.array(F.lit("ALL"), F.upper("phase")))).filter(F.col("phase").isin("ALL", *phases))
    return _w1(both(reference), both(other), ["phase", "column"])


def ks(reference: DataFrame, other: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, m, statistic, p_value): the two-sample Kolmogorov-Smirnov test with the asymptotic p-value; null below 50
    values on either side. Values are counted first, so only distinct values are ordered."""
    side = lambda d, k: d.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.lit(1 - k).alias("a"), F.lit(k).alias("b"))
    c = side(reference, 0).unionByName(side(other, 1)).groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    c = with_totals_before(c.withColumn("_r", value_range(reference, value, "v")), list(by), {"n": "a", "m": "b"})
    run = before(Window.partitionBy(*by, "_r").orderBy("v"))
    below = lambda total, x: (F.col(total) + F.sum(x).over(run)) / F.col(f"{total}_all")
    c = c.select(*by, F.abs(below("n", "a") - below("m", "b")).alias("d"), F.col("n_all").alias("n"), F.col("m_all").alias("m"))
    g = c.groupBy(*by).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("d").alias("d")) if by else c.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("d").alias("d"))
    lam = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("d")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("_l") * F.col("_l")))
    p = F.when(F.col("_l") < 0.2, 1.0).otherwise(F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0)))
    ok = (F.col("n") >= LEAST_KS) & (F.col("m") >= LEAST_KS)
    return g.withColumn("_l", lam).select(*by, "n", "m", F.when(ok, F.col("d")).alias("statistic"), F.when(ok, p).alias("p_value"))


def phi_bands(df: DataFrame, value: str, by: Sequence[str], bins: int = 25) -> DataFrame:
    """(by, phi, p10, p50, p90) over bins of phi, at their centres."""
    d = df.withColumn("_b", phi_bin("phi", bins)).filter(F.col("_b").isNotNull() & F.col(value).isNotNull())
    g = quantiles(d, value, [*by, "_b"], BAND)
    return g.select(*by, ((F.col("_b") + 0.5) / bins).alias("phi"), F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def altitude_envelope(df: DataFrame, value: str = "h_ft", points: int = 41, least_s: float = 60.0, keys=KEYS, by: Sequence[str] = ()) -> DataFrame:
    """(by, tau, p10, p50, p90) of the value at equal steps of each flight's normalised time, interpolated linearly. Flights
    under least_s seconds or two points are left out. Flight and grid rows are sorted together; nothing is multiplied."""
    d = df.filter(F.col(value).isNotNull()).withColumn("_t", F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(1e6))
    span = d.groupBy(*keys, *by).agg(F.min("_t").alias("t0"), F.max("_t").alias("t1"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) & (F.col("t1") - F.col("t0") >= least_s))
    grid = span.select(*keys, *by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), "t0", "t1")
    grid = grid.select(*keys, *by, "k", (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("k") / (points - 1)).alias("_t"))
    rows = d.join(span.select(*keys), list(keys), "left_semi").select(*keys, *by, "_t", F.struct(F.col("_t").alias("t"), F.col(value).alias("v")).alias("p"))
    both = rows.unionByName(grid, allowMissingColumns=True)
    w, r = Window.partitionBy(*keys).orderBy("_t", F.col("p").isNull()), Window.partitionBy(*keys).orderBy(F.desc("_t"), F.col("p").isNotNull())
    b = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    f = F.last("p", ignorenulls=True).over(r.rowsBetween(Window.unboundedPreceding, 0))
    at = F.coalesce(b["v"] + (f["v"] - b["v"]) * (F.col("_t") - b["t"]) / F.when(f["t"] > b["t"], f["t"] - b["t"]), b["v"], f["v"])
    g = quantiles(both.withColumn("_at", at).filter("k is not null"), "_at", [*by, "k"], BAND)
    return g.select(*by, (F.col("k") / (points - 1)).alias("tau"), F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def median_of_medians(df: DataFrame, value: str, by: Sequence[str], bins: int = 20, keys=KEYS) -> DataFrame:
    """(by, bin, median): the median over flights of each flight's median, by bin of phi."""
    d = df.withColumn("bin", phi_bin("phi", bins)).filter("bin is not null")
    one = d.groupBy(*by, *keys, "bin").agg(F.percentile(value, F.lit(0.5)).alias("m"))
    return one.groupBy(*by, "bin").agg(F.percentile("m", F.lit(0.5)).alias("median"), F.count("m").alias("flights"))


def tails(df: DataFrame, value: str, by: Sequence[str], above: float = 45000.0, below: float = 0.0) -> DataFrame:
    """Shares of values above and below."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg((F.col(value) > above).cast("double")).alias("above"), F.avg((F.col(value) < below).cast("double")).alias("below"))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, known, share_known, share_null), in one pass."""
    g = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("known")) for c in columns]))
    return g.select("n", rows.alias("x")).select("x.column", "x.known", (F.col("x.known") / F.col("n")).alias("share_known"), (1 - F.col("x.known") / F.col("n")).alias("share_null"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of each column."""
    d = _long(df, columns, F.lit("x"))
    g = d.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    g = g.join(quantiles(d, "v", ["column"], (0.25, 0.5, 0.75)), "column")
    return g.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")
