"""Conditional distribution tables of commands, lookups with back-off, and seeded draws from them.

Every table covers all flights at once, keyed by route, flight, phase or bin; nothing is built group by group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions import aero
from contrail.functions.bins import CAS_STEP_KT, HEIGHT_STEP_FT, LEAST_SEGMENT_S, MACH_STEP, PHI_STEP, RATE_STEP_FPM, distance_bin, phi_bin, plateau_bin, to_step
from contrail.operators.asof import asof_forward, asof_nearest, plateau_of
from contrail.operators.series import KEYS, forward_fill, quantiles, series, value_range, with_totals_before
from contrail.plans.descent import to_destination
from contrail.sources.tables import settle

LEAST_PHASE_S, MOST_DWELL_S, FIRST_DWELL_S, LEAST_SLAB_ROWS = 30.0, 900.0, 90.0, 50
NEAR_END_PHI, NEAR_END_FT = 0.85, 3000.0
LEAST_POOL = 5
# Multipliers of the draws.
DRAW_A, DRAW_B, DRAW_C = 7919, 104729, 1299709


def _s(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def placed(df: DataFrame, edges: list[float] | None) -> DataFrame:
    """df with gc_bin by the edges; without them it has its bins already."""
    return df if edges is None else df.withColumn("gc_bin", distance_bin("gc_nm", edges))


def phase_windows(df: DataFrame, least_s: float = LEAST_PHASE_S, keys=KEYS) -> DataFrame:
    """(keys, phase, t0, t1, span_s) of each phase with two rows or more and over least_s seconds."""
    g = df.groupBy(*keys, F.upper("phase").alias("phase")).agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.count(F.lit(1)).alias("_n"))
    return g.withColumn("span_s", _s("t1") - _s("t0")).filter((F.col("_n") >= 2) & (F.col("span_s") > least_s)).drop("_n")


def with_phase(events: DataFrame, df: DataFrame, tolerance_s: float = 2.0, keys=KEYS) -> DataFrame:
    """events with the phase of the grid row nearest to their start."""
    return asof_nearest(events, df, {"phase": (F.upper("phase"), tolerance_s)}, keys, "start_timestamp")


def with_phi(events: DataFrame, windows: DataFrame, keys=KEYS, closed: str = "right") -> DataFrame:
    """events with phi_mid (position of their start in their phase, 0..1), dphi (their share of it) and phi_bin."""
    d = events.withColumn("phase", F.upper("phase")).join(windows, [*keys, "phase"])
    phi = aero.clip((_s("start_timestamp") - _s("t0")) / F.col("span_s"), 0.0, 1.0)
    d = d.withColumn("phi_mid", phi).withColumn("dphi", F.col("duration_s") / F.col("span_s"))
    return d.withColumn("phi_bin", phi_bin("phi_mid", closed=closed)).drop("t0", "t1", "span_s")


def binned(events: DataFrame, command: str, name: str, step: float) -> DataFrame:
    """Events of one command whose value has a bin."""
    return events.filter(F.col("command") == command).withColumn(name, to_step("value", step)).filter(F.col(name).isNotNull())


def rate_height_joint(events: DataFrame, windows: DataFrame, tolerance_s: float = 60.0, keys=KEYS) -> DataFrame:
    """Rate events with phi and the height bin of the nearest altitude plateau of the same flight and phase."""
    h = binned(events, "h_sel", "h_bin", HEIGHT_STEP_FT).withColumn("phase", F.upper("phase"))
    v = with_phi(binned(events, "vz_sel", "vz_bin", RATE_STEP_FPM), windows, keys)
    out = asof_nearest(v, h, {"h_bin": (F.col("h_bin"), tolerance_s)}, [*keys, "phase"], "start_timestamp", "start_timestamp")
    return out.filter(F.col("h_bin").isNotNull() & (F.col("dphi") > 0))


def height_phi(events: DataFrame, windows: DataFrame, keys=KEYS) -> DataFrame:
    """Altitude plateaus with bin and phi."""
    return with_phi(binned(events, "h_sel", "h_bin", HEIGHT_STEP_FT), windows, keys).filter("dphi > 0")


def event_library(events: DataFrame, command: str = "vz_sel", name: str = "vz_bin", step: float = RATE_STEP_FPM, phase: str = "DESCENT", keys=KEYS) -> DataFrame:
    """(keys, phase, h_bin, u_bin, u, bin, duration_s) of each event of a command within an altitude plateau."""
    e = events.filter(F.upper("phase") == phase)
    h = e.filter("command = 'h_sel'").select(*keys, "start_timestamp", "duration_s", "value")
    c = e.filter((F.col("command") == command) & F.col("value").isNotNull() & (F.col("duration_s") >= LEAST_SEGMENT_S)).select(*keys, "start_timestamp", "duration_s", "value")
    d = plateau_of(c, h, keys=keys)
    return d.select(*keys, F.lit(phase).alias("phase"), to_step("plateau_value", HEIGHT_STEP_FT).alias("h_bin"), plateau_bin("u").alias("u_bin"), "u", to_step("value", step).alias(name), "duration_s")


def transition_library(events: DataFrame, df: DataFrame, flights: DataFrame, phase: str = "DESCENT", per_route: int | None = None, keys=KEYS) -> DataFrame:
    """CAS transitions (cas_prev_bin, cas_new_bin, dwell) with height, rate, phi and how near the end of the phase they are,
    of all the flights given with at least LEAST_SLAB_ROWS rows in the phase, or of the first per_route (by firstseen) of
    each route; a column `accepted` of flights, as of quality.assess, says which of them count."""
    f = flights.filter("accepted") if "accepted" in flights.columns else flights
    if per_route is not None:
        f = f.withColumn("_k", F.row_number().over(Window.partitionBy("route").orderBy("firstseen", "flight_id"))).filter(F.col("_k") <= per_route)
    w = series(keys)
    slab = df.filter(F.upper("phase") == phase).join(f.select(*keys), list(keys), "left_semi")
    slab = slab.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("_n") >= LEAST_SLAB_ROWS).withColumn("_h", forward_fill("h_sel", w))
    # Both sides are read several times, and written first. Besides, events are found by a union of dealt rows: where Spark merges the
    # ends to it without a shuffle (spark.sql.unionOutputPartitioning) and joins by time above that, it takes the number of its partitions for another.
    slab = settle(slab.select(*keys, "timestamp", "_h", "vz_sel"))
    rows = slab.count()
    ends = slab.groupBy(*keys).agg(F.min("timestamp").alias("_t0"), F.max("timestamp").alias("_t1"), F.max_by("_h", "timestamp").alias("_h_end"))
    e = settle(events.filter((F.col("command") == "cas_sel") & (F.upper("phase") == phase) & F.col("value").isNotNull()).select(*keys, "start_timestamp", "duration_s", "value"))
    d = asof_forward(settle(e.join(ends, list(keys))), slab, {"_h_now": F.col("_h"), "_vz": F.col("vz_sel")}, keys, "start_timestamp", rows=rows)
    ew = Window.partitionBy(*keys).orderBy("start_timestamp")
    span = F.greatest(_s("_t1") - _s("_t0"), F.lit(1.0))
    d = d.withColumn("_prev", F.lag("value").over(ew)).withColumn("_dwell", _s("start_timestamp") - F.lag(_s("start_timestamp")).over(ew))
    d = d.withColumn("phi", (_s("start_timestamp") - _s("_t0")) / span).filter(F.col("_prev").isNotNull() & (F.col("_dwell") >= LEAST_SEGMENT_S))
    near = F.coalesce((F.col("phi") > NEAR_END_PHI) | (F.col("_h_now") < NEAR_END_FT), F.lit(False))
    return d.select(
        *keys, F.lit(phase).alias("phase"), to_step("_prev", CAS_STEP_KT).alias("cas_prev_bin"), to_step("value", CAS_STEP_KT).alias("cas_new_bin"), to_step("_h_now", HEIGHT_STEP_FT).alias("h_bin"),
        to_step("_vz", RATE_STEP_FPM).alias("vz_bin"), "phi", to_step("_h_end", HEIGHT_STEP_FT).alias("h_end_bin"), F.least("_dwell", F.lit(MOST_DWELL_S)).alias("dwell_s"), near.cast("long").alias("near_end"),
    )


def mach_anchors(events: DataFrame, track: DataFrame, ends: DataFrame, tod: DataFrame, lengths: DataFrame, edges: list[float] | None, keys=KEYS) -> DataFrame:
    """One row per flight with Mach events: how many, the last, phi at the first (phi_up) and at the first CAS event after
    the last (phi_dn), what was selected before the first, and phi of the top of descent, with bins."""
    m = events.filter("command = 'mach_sel'").groupBy(*keys).agg(F.min("start_timestamp").alias("_up"), F.max("start_timestamp").alias("_lm"), F.count(F.lit(1)).alias("n_mach"), F.max_by("value", "start_timestamp").alias("mach_last"))
    e = events.join(m, list(keys))
    pre = F.col("start_timestamp") < F.col("_up")
    cas = F.col("command") == "cas_sel"
    s = e.groupBy(*keys).agg(
        F.min(F.when(cas & (F.col("start_timestamp") > F.col("_lm")), F.col("start_timestamp"))).alias("_dn"), F.max(F.when(pre & (F.col("command") == "h_sel"), F.col("value"))).alias("h_pre_max"),
        F.max_by(F.when(pre & cas, F.col("value")), F.when(pre & cas, F.col("start_timestamp"))).alias("cas_pre_last"),
    )
    up = to_destination(m.select(*keys, F.col("_up").alias("timestamp")), track, ends, name="phi_up").drop("timestamp")
    dn = to_destination(s.filter("_dn is not null").select(*keys, F.col("_dn").alias("timestamp")), track, ends, name="phi_dn").drop("timestamp")
    d = m.join(s, list(keys)).join(up, list(keys), "left").join(dn, list(keys), "left").join(tod.select(*keys, F.col("phi_d").alias("phi_tod")), list(keys), "left").join(placed(lengths, edges).select("route", "gc_nm", "gc_bin"), "route", "left")
    return d.select(
        *keys, "gc_nm", "gc_bin", "n_mach", "mach_last", "phi_up", "phi_dn", "phi_tod", "h_pre_max", "cas_pre_last", to_step("h_pre_max", HEIGHT_STEP_FT).alias("h_pre_bin"),
        to_step("cas_pre_last", CAS_STEP_KT).alias("cas_pre_bin"), to_step("phi_tod", PHI_STEP).alias("phi_tod_bin"), to_step("mach_last", MACH_STEP).alias("mach_bin"),
    )


def level_mach(events: DataFrame, lengths: DataFrame, edges: list[float] | None) -> DataFrame:
    """(gc_bin, mach_bin, duration_s) of Mach events in level flight."""
    d = events.filter((F.col("command") == "mach_sel") & (F.upper("phase") == "LEVEL")).join(placed(lengths, edges).select("route", "gc_bin"), "route")
    return d.select(*KEYS, "gc_bin", to_step("value", MACH_STEP).alias("mach_bin"), "duration_s")


def descent_phi(tod: DataFrame, lengths: DataFrame, edges: list[float] | None) -> DataFrame:
    """(gc_bin, phi_d) of tops of descent; the share flown stands in where phi_d is unknown."""
    known = [F.col(c) for c in ("phi_d", "flight_progress") if c in tod.columns]
    d = tod.withColumn("phi", F.coalesce(*known)).filter("phi is not null").join(placed(lengths, edges).select("route", "gc_bin"), "route")
    return d.select(*KEYS, "gc_bin", F.col("phi").alias("phi_d"))


def starts_and_counts(events: DataFrame, meta: DataFrame, edges: list[float] | None, command: str, step: float, keys=KEYS) -> DataFrame:
    """(gc_bin, family, phase, keys, start_bin, segments): first bin and number of events of a command, by flight and phase.
    Flights of all routes of a bin are pooled."""
    d = binned(events.filter(F.upper("phase").isin("CLIMB", "DESCENT")), command, "_bin", step).join(placed(meta, edges).select(*keys, "gc_bin", "family"), list(keys))
    return d.groupBy("gc_bin", "family", F.upper("phase").alias("phase"), *keys).agg(F.min_by("_bin", "start_timestamp").alias("start_bin"), F.count(F.lit(1)).alias("segments"))


def distance_edge_table(lengths: DataFrame) -> DataFrame:
    """One row, with `edges`: the least length less one but not below 0, the tertiles of the lengths, the greatest plus one; nulls if there are none."""
    q = F.col("q")
    return quantiles(lengths, "gc_nm", [], (0.0, 1 / 3, 2 / 3, 1.0)).select(F.array(F.greatest(q[0] - 1.0, F.lit(0.0)), q[1], q[2], q[3] + 1.0).alias("edges"))


def distance_edges(lengths: DataFrame) -> list[float]:
    """Edges of three distance bins: those of distance_edge_table."""
    edges = distance_edge_table(lengths).first()["edges"]
    return list(edges) if edges[0] is not None else [0.0, 1.0]


def condition(routes: DataFrame, typecodes: Sequence[str] | None = None, gc_nm: float | None = None, within_nm: float | None = None) -> DataFrame:
    """Flights (of a metadata table) of some type codes on routes of a length, all ANDed; the band is inclusive."""
    d = routes
    if typecodes:
        d = d.filter(F.upper(F.trim("typecode")).isin([t.strip().upper() for t in typecodes]))
    if gc_nm is not None:
        d = d.filter(F.abs(F.col("gc_nm") - gc_nm) <= within_nm)
    return d


def phase_laws(events: DataFrame, df: DataFrame, meta: DataFrame, edges: list[float] | None, windows: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """All tables keyed by (gc_bin, family, phase): vz_phi, h_phi, cas_phi, vz_h_joint, vz_starts, cas_starts. windows are those
    of df's phases, made here if not given."""
    windows = phase_windows(df) if windows is None else windows
    place = placed(meta, edges).select(*KEYS, "gc_bin", "family")
    e = events.filter(F.upper("phase").isin("CLIMB", "DESCENT"))
    keyed = lambda d: d.join(place, list(KEYS))
    return {
        "vz_phi": keyed(with_phi(binned(e, "vz_sel", "vz_bin", RATE_STEP_FPM), windows)), "h_phi": keyed(height_phi(e, windows)), "cas_phi": keyed(with_phi(binned(e, "cas_sel", "cas_bin", CAS_STEP_KT), windows)),
        "vz_h_joint": keyed(rate_height_joint(e, windows)), "vz_starts": starts_and_counts(e, meta, edges, "vz_sel", RATE_STEP_FPM), "cas_starts": starts_and_counts(e, meta, edges, "cas_sel", CAS_STEP_KT),
    }


def back_off(requests: DataFrame, library: DataFrame, levels: Sequence[Sequence[str]], least: int = 1) -> DataFrame:
    """requests with `level` (index of the first of levels under whose keys the library has at least `least` rows; null if
    none has) and `pool` (how many rows). Each level is counted once and joined."""
    d = requests
    for i, keys in enumerate(levels):
        counts = library.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{i}")) if keys else library.agg(F.count(F.lit(1)).alias(f"_n{i}"))
        d = d.join(counts, list(keys), "left") if keys else d.join(F.broadcast(counts))
    level, pool = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i in reversed(range(len(levels))):
        ok = F.coalesce(F.col(f"_n{i}"), F.lit(0)) >= least
        level, pool = F.when(ok, F.lit(i)).otherwise(level), F.when(ok, F.col(f"_n{i}")).otherwise(pool)
    return d.withColumn("level", level).withColumn("pool", pool).drop(*[f"_n{i}" for i in range(len(levels))])


def nearest_key(requests: DataFrame, library: DataFrame, want: str, key: str, by: Sequence[str]) -> DataFrame:
    """requests with `key`, the library's key of the same `by` columns nearest to `want`, the smaller on a tie. The distinct
    keys of a group lie on a line, so the nearest is the last at or below, or the first above. The line is ordered in
    ranges, each of which is told the last key before it and the first after it."""
    keys = library.filter(F.col(key).isNotNull()).select(*by, F.col(key).alias("_at")).distinct()
    both = requests.select(*by, F.col(want).alias("_at"), F.struct(*requests.columns).alias("_q")).unionByName(keys.withColumn("_k", F.col("_at")), allowMissingColumns=True)
    both = both.withColumn("_r", value_range(requests, want, "_at"))
    ends = both.filter("_k is not null").groupBy(*by, "_r").agg(F.max("_k").alias("_last"), F.min("_k").alias("_first"))
    # Null keys are a group like any other, as they are in windows.
    same = lambda x, y: reduce(Column.__and__, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in (*by, "_r")])
    spans = both.select(*by, "_r").distinct().alias("s").join(ends.alias("e"), same("s", "e"), "left").select("s.*", "_last", "_first")
    up, down = Window.partitionBy(*by).orderBy("_r"), Window.partitionBy(*by).orderBy(F.desc("_r"))
    spans = spans.select(
        *by, "_r", F.last("_last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.last("_first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_above")
    )
    both = both.alias("b").join(spans.alias("s"), same("b", "s"), "left").select("b.*", "_below", "_above")
    w, r = Window.partitionBy(*by, "_r").orderBy("_at", F.col("_k").isNull()), Window.partitionBy(*by, "_r").orderBy(F.desc("_at"), F.col("_k").isNotNull())
    lo = F.coalesce(F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_below")
    hi = F.coalesce(F.last("_k", ignorenulls=True).over(r.rowsBetween(Window.unboundedPreceding, 0)), "_above")
    near = F.when(lo.isNull() | (hi - F.col("_at") < F.col("_at") - lo), hi).otherwise(lo)
    return both.withColumn(key, near).filter("_q is not null").select("_q.*", key)


def narrow(library: DataFrame, request: Mapping[str, object], order: Sequence[str], least: int = LEAST_POOL) -> DataFrame:
    """The rows of library that match the request's columns, taken in order; a column that would leave fewer than `least`
    rows, or whose value is None, is passed over. All counts come from one pass."""
    asked = [c for c in order if request.get(c) is not None]
    if not asked:
        return library
    # Rows by which of the columns match, of which there are few kinds; the choice is made on these counts.
    match = {c: F.coalesce(F.col(c) == F.lit(request[c]), F.lit(False)) for c in asked}
    kinds = [(set(c for c, ok in zip(asked, r, strict=False) if ok), r[-1]) for r in library.groupBy(*[match[c].alias(f"_{i}") for i, c in enumerate(asked)]).count().collect()]
    kept: set[str] = set()
    for c in asked:
        if sum(n for have, n in kinds if kept | {c} <= have) >= least:
            kept.add(c)
    keep = F.lit(True)
    for c in kept:
        keep = keep & match[c]
    return library.filter(keep)


def draw(requests: DataFrame, pool: DataFrame, value: str, by: Sequence[str], order: Sequence[str], law: int, name: str, default: Column | None = None, seed: str = "seed", number: str = "draw_id") -> DataFrame:
    """requests with `name`, a value drawn from the pool rows of the same `by` columns. The draw is a fixed function of seed,
    draw number and law, so it can be repeated anywhere: row (seed * A + draw * B + law * C) mod n, in the given order."""
    p = pool.filter(F.col(value).isNotNull())
    # Each range of values is ranked by itself, from the number of rows of the ranges before it.
    ranged = with_totals_before(p.withColumn("_r", value_range(p, value)).withColumn("_one", F.lit(1)), list(by), {"_n": "_one"})
    ranked = ranged.select(*by, F.col(value).alias(name), (F.col("_n") + F.row_number().over(Window.partitionBy(*by, "_r").orderBy(value, *order)) - 1).cast("long").alias("_at"))
    sizes = p.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    at = F.pmod(F.col(seed) * DRAW_A + F.col(number) * DRAW_B + law * DRAW_C, F.col("_n"))
    d = requests.join(sizes, list(by), "left").withColumn("_at", at).join(ranked, [*by, "_at"], "left").drop("_at", "_n")
    return d.withColumn(name, F.coalesce(F.col(name), default)) if default is not None else d


def family_fallback(requests: DataFrame, table: DataFrame, keys: Sequence[str] = ("gc_bin", "phase")) -> DataFrame:
    """requests with `family_used`: their own family if the table has it under the same keys, else Other if that is there,
    else the first family by name; null if there is none."""
    have = table.select(*keys, "family").distinct()
    own = have.withColumn("_own", F.lit(True))
    other = have.groupBy(*keys).agg(F.max(F.when(F.col("family") == "Other", F.col("family"))).alias("_o"), F.min("family").alias("_f"))
    d = requests.join(own, [*keys, "family"], "left").join(other, list(keys), "left")
    return d.withColumn("family_used", F.when(F.col("_own"), F.col("family")).otherwise(F.coalesce("_o", "_f"))).drop("_own", "_o", "_f")
