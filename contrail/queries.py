"""The registered queries, one or more for each operator, and their SQL twins.

Every query reads whole tables: the general tables given, or the views that contrail.plans.views derives from them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions import aero, bins, keys
from contrail.operators import asof, islands, scan, series
from contrail.plans import assembly, commands, compare, descent, draws, fit, inputs, laws, manifest, processing, quality, replay, reports, trajectory
from contrail.plans.views import CHECKED, Tables, flat, with_views
from contrail.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = list(series.KEYS)
ID = "route, flight_id"
W = "over (partition by route, flight_id order by timestamp)"
EDGES = [0.0, 890.0, 910.0, 20000.0]



def query(name: str, sql: str | None = None, digits: int = 6):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: flat(f(Tables(spark, sf_dir)), digits)
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return register


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n.split('.')[-1]}" for n in names)


#: Columns of the commands, and what else their laws are made of.
COMMAND_COLUMNS = tuple(islands.EVENT_STEPS)
PLACE_COLUMNS = ("time", "phase", "altitude", "latitude", "longitude")


def events_of(t: Tables, track: DataFrame | None = None) -> DataFrame:
    """Command events with the phase at their start."""
    track = t.written(*COMMAND_COLUMNS, "phase") if track is None else track
    return laws.with_phase(islands.command_events(track), track)


def lengths_of(t: Tables) -> DataFrame:
    return descent.route_lengths(t.flights, t.airports)


def meta_of(t: Tables) -> DataFrame:
    return descent.flight_metadata(t.flights, t.aircraft, lengths_of(t))


def ends_of(t: Tables) -> DataFrame:
    """Destination of each route."""
    r = t.flights.select("route", "arrival").distinct()
    return r.join(t.airports.select(F.col("icao").alias("arrival"), "latitude", "longitude"), "arrival").select("route", "latitude", "longitude")


def tod_of(t: Tables, track: DataFrame | None = None) -> DataFrame:
    track = t.track if track is None else track
    # Each step is written, a row for each flight, so that the track is not on disk for all of them at a time.
    placed = tables.settle(descent.with_position(tables.settle(descent.top_of_descent(track)), track, rows=t.rows))
    return descent.to_destination(placed, track, ends_of(t), rows=t.rows)


# --- The minimum slice -------------------------------------------------------------------------------------------


@query("entry_command_events", f"select command, count(*) as events, {rounded('mean_s')} from (select command, 1 as one, avg(duration_s) over (partition by command) as mean_s from cmd) x group by command, mean_s")
def _(t):
    e = islands.command_events(t.track)
    return e.groupBy("command").agg(F.count(F.lit(1)).alias("events"), F.avg("duration_s").alias("mean_s"))


# --- Sources ------------------------------------------------------------------------------------------------------


@query("s1_flight_list", "select flight_id, callsign, epoch_us(firstseen) as firstseen from flights where departure = 'N3' and arrival = 'N11' and firstseen >= timestamp '2024-01-01 00:00:00' and firstseen < timestamp '2024-01-01 00:00:37'")
def _(t):
    return tables.flight_list(t.flights, "N3", "N11", "2024-01-01 00:00:00", "2024-01-01 00:00:37").select("flight_id", "callsign", "firstseen")


@query("s2_j4_samples_of_flights", "select f.route, f.flight_id, count(*) as samples, min(r.seq) as first_seq, max(r.seq) as last_seq from (select s.*, f.icao24 from sparse s join flights f using (route, flight_id)) r join flights f on f.icao24 = r.icao24 and r.timestamp >= date_trunc('minute', f.firstseen) and r.timestamp < date_trunc('minute', f.lastseen) group by 1, 2")
def _(t):
    raw = t.sparse.join(t.flights.select(*K, "icao24"), K).drop(*K)
    return tables.samples_of_flights(raw, t.flights).groupBy(*K).agg(F.count(F.lit(1)).alias("samples"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("s3_s4_scan_columns", "select l_returnflag, count(*) as rows, round(sum(l_quantity), 2) as quantity from lineitem group by 1", 2)
def _(t):
    d = tables.read(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("s5_routes_scan", f"select {ID}, command, epoch_us(t0) as start_timestamp, {rounded('value')} from cmd where route in ('N1_N9', 'N4_N12') and flight_id in (select flight_id from flights where status = 'done')")
def _(t):
    e = islands.command_events(t.track).filter(F.col("route").isin("N1_N9", "N4_N12"))
    return e.join(tables.accepted_flights(t.flights), K, "left_semi").select(*K, "command", "start_timestamp", "value")


@query("s6_written_and_read", f"select {ID}, i, round(altitude, 6) as altitude from track")
def _(t):
    path = f"{tables.shared_folder(t.spark)}/s6-{uuid.uuid4().hex}"
    tables.write(t.track.select(*K, "i", "altitude", F.array("i").alias("nested")), path)
    return tables.read(t.spark, path, [*K, "i", "altitude"])


@query("s7_without_nested", "select o_orderkey, o_orderstatus from orders")
def _(t):
    d = t.base("orders").select("o_orderkey", "o_orderstatus", F.array("o_totalprice").alias("a"), F.struct("o_orderkey").alias("s"), F.create_map("o_orderstatus", "o_orderkey").alias("m"))
    return tables.without_nested(d)


@query("s8_routes", "select distinct route from flights")
def _(t):
    return tables.routes(t.flights)


@query("s9_u3_accepted_flights", f"select distinct {ID} from flights where status = 'done' and (route, flight_id) in (select {ID} from track)")
def _(t):
    return tables.accepted_flights(t.flights, present=t.track.select(*K).distinct())


@query("s10_dimension_lookups", "select f.flight_id, a.typecode, a.registration, p.latitude as arr_latitude, p.longitude as arr_longitude, p.altitude as arr_altitude from flights f left join aircraft a using (icao24) left join airports p on p.icao = f.arrival")
def _(t):
    return tables.with_airport(tables.with_aircraft(t.flights, t.aircraft), t.airports, "arrival", "arr", must=True).select("flight_id", "typecode", "registration", "arr_latitude", "arr_longitude", "arr_altitude")


PAYLOAD = """
with s as (select route, count(*) as manifest_rows, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'done' and right(flight_id, 1) <> '3') as accepted from flights group by route),
ends as (select split_part(route, '_', 1) as icao from s union select split_part(route, '_', 2) from s)
select 'routes' as part, s.route, s.manifest_rows, s.done, s.accepted, l.gc_nm, m.n as flights_n, '' as name, '' as typecode, 0 as total from s left join lengths l using (route) left join (select route, count(*) as n from meta group by route) m using (route)
union all select 'flights', route, 0, 0, 0, gc_nm, 0, flight_id, coalesce(typecode, ''), 0 from meta
union all select 'airports', '', 0, 0, 0, a.latitude, 0, icao, coalesce(a.name, ''), 0 from ends left join airports a using (icao)
union all select 'summary', '', 0, (select sum(done) from s), (select sum(accepted) from s), 0, 0, '', '', (select count(*) from s) * 1000 + (select count(*) from ends)
"""


@query("s11_payload", f"select part, route, manifest_rows, done, accepted, round(gc_nm, 4) as gc_nm, flights_n, name, typecode, total from ({PAYLOAD}) x", 4)
def _(t):
    qc = t.flights.filter("status = 'done'").select(*K, (F.right("flight_id", F.lit(1)) != "3").alias("accepted"))
    d = reports.payload(reports.route_stats(t.flights, qc, lengths_of(t), EDGES), meta_of(t), t.airports)
    path = f"{tables.shared_folder(t.spark)}/s11-{uuid.uuid4().hex}"
    tables.write_payload(d, path)
    fields = "part string, route string, manifest_rows long, done long, accepted long, gc_nm double, flights_n long, flight_id string, typecode string, icao string, name string, latitude double, total_routes long, total_airports long, total_accepted long, total_done long"
    r = t.spark.read.schema(fields).json(path)
    number = lambda *c: F.coalesce(*c, F.lit(0)).cast("long")
    return r.select(
        "part", F.coalesce(F.when(F.col("route") != "__HIVE_DEFAULT_PARTITION__", F.col("route")), F.lit("")).alias("route"), number("manifest_rows").alias("manifest_rows"), number("done", "total_done").alias("done"),
        number("accepted", "total_accepted").alias("accepted"), F.round(F.coalesce("gc_nm", "latitude", F.when(F.col("part") == "summary", 0.0)), 4).alias("gc_nm"), number("flights_n").alias("flights_n"),
        F.coalesce("flight_id", "icao", F.lit("")).alias("name"), F.coalesce("typecode", "name", F.lit("")).alias("typecode"), (number("total_routes") * 1000 + number("total_airports")).alias("total"),
    )


@query("s12_one_flight", f"select {ID}, i, altitude from track where route = 'N3_N11' and flight_id = 'F3'")
def _(t):
    return t.track.filter((F.col("route") == "N3_N11") & (F.col("flight_id") == "F3")).select(*K, "i", "altitude")


# --- Projections, filters, predicates --------------------------------------------------------------------------


@query("p1_unit_conversion", "select event_id, epoch_us(timestamp) as timestamp, round(value, 6) as groundspeed_mps, round(value * 1.94384, 6) as groundspeed_kt, round(value * 196.850394, 4) as rate from irregular", 6)
def _(t):
    d = t.irregular.select("event_id", keys.seconds("timestamp").alias("mintime"), F.col("value").alias("velocity"), F.lit(0.0).alias("heading"), F.col("value").alias("vertrate"))
    return trajectory.velocities(d).select("event_id", "timestamp", "groundspeed_mps", "groundspeed_kt", F.round("vertical_rate_fpm", 4).alias("rate"))


@query("p2_done_flights", f"select {ID} from flights where status = 'done'")
def _(t):
    return t.flights.filter("status = 'done'").select(*K)


@query("p3_registers", "select event_id, case when event_type = 'view' then value end as ias, case when event_type = 'click' then value end as tas, case when event_type = 'purchase' then value end as mcp from irregular")
def _(t):
    v = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    s = lambda kind, *cols: F.when(F.col("event_type") == kind, F.struct(*[(v(kind) if c in ("IAS", "TAS", "selected_mcp") else F.lit(None).cast("double")).alias(c) for c in cols]))
    d = t.irregular.select("event_id", s("view", "IAS", "Mach", "heading").alias("bds60"), s("click", "roll", "TAS", "track").alias("bds50"), s("purchase", "selected_mcp", "selected_fms", "barometric_setting").alias("bds40"), s("none", "static_temperature").alias("bds45"))
    return trajectory.registers(d).select("event_id", F.col("IAS").alias("ias"), F.col("TAS").alias("tas"), F.col("selected_mcp").alias("mcp"))


@query("p4_unambiguous", "select event_id from irregular where not (event_type in ('view', 'click') and value > 50 and event_id % 2 = 0)")
def _(t):
    both = F.col("event_type").isin("view", "click") & (F.col("value") > 50)
    d = t.irregular.select("event_id", "timestamp", F.when(both, F.col("value")).alias("IAS"), F.when(F.col("event_id") % 2 == 0, 1.0).alias("roll"), F.lit("x").alias("rawmsg"))
    return trajectory.unambiguous(d).select("event_id")


P5 = "select route, flight_id, count(*) as rows from (select *, count(*) over (partition by route, flight_id) as m from track where altitude is not null and latitude is not null) x where m >= 560 group by 1, 2"


@query("p5_enough_points", f"select f.route, f.flight_id, case when f.status = 'done' and p.rows is null then 'filtered' else f.status end as status, coalesce(p.rows, 0) as rows from flights f left join ({P5}) p using (route, flight_id)")
def _(t):
    kept = trajectory.enough_points(t.track.withColumnRenamed("altitude", "altitude_ft"), 560)
    n = kept.groupBy(*K).agg(F.count(F.lit(1)).alias("rows"))
    return trajectory.filtered_status(t.flights, kept).join(n, K, "left").select(*K, "status", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("p6_without_outliers", f"select {ID}, i from (select *, quantile_cont(altitude, 0.5) over w as m, stddev_pop(altitude) over w as d from track window w as (partition by route, flight_id order by timestamp rows between 8 preceding and 8 following)) x where not coalesce(abs(altitude - m) > 1.5 * (1 + 1e-9) * greatest(d, 50.0), false)")
def _(t):
    return trajectory.without_outliers(t.track, "altitude", factor=1.5).select(*K, "i")


@query("p7_first_known", f"select {ID}, i, {rounded('x')} from (select *, coalesce(TAS, CAS, Mach) as x from track) y")
def _(t):
    d = t.track
    return d.select(*K, "i", keys.first_known("nothing", "TAS", "CAS", "Mach", present=d.columns).alias("x"))


@query("p8_condition", "select route, flight_id, typecode from meta where upper(trim(typecode)) in ('A320', 'A20N') and abs(gc_nm - 900) <= 10")
def _(t):
    return laws.condition(meta_of(t), ["A320", "a20n "], 900.0, 10.0).select(*K, "typecode")


@query("p9_choose_flights", "select route, flight_id from meta where family in ('A320 family', 'B737') and typecode in ('A320', 'B738') and gc_nm between 880 and 915 and upper(route) like '%_N1%'")
def _(t):
    return reports.choose(meta_of(t), ["A320 family", "B737"], ["A320", "B738"], (880.0, 915.0), "_n1").select(*K)





@query("p10_targets", f"select {ID}, epoch_us(timestamp) as timestamp, round(h_sel * 0.3048, 6) as fdm_alt_target_m, round(TAS * 0.514444, 6) as fdm_tas_target_ms, case when TAS is null then 0.0e0 else 1.0e0 end as fdm_tas_target_known, 0.0e0 as fdm_gamma_target_known, 0.0e0 as fdm_heading_known from track")
def _(t):
    d = inputs.targets(t.track.withColumnRenamed("TAS", "tas_intent_kt"))
    return d.select(*K, "timestamp", "fdm_alt_target_m", "fdm_tas_target_ms", "fdm_tas_target_known", "fdm_gamma_target_known", "fdm_heading_known")


P11 = """select route, flight_id, timestamp, i, altitude * 0.3048 as raw_alt_m, TAS * 0.514444 as era_tas_ms, (coalesce(heading, track_deg) * pi() / 180) % (2 * pi()) as fdm_heading_rad, 0.0e0 as fdm_long_wind_ms,
  coalesce(case when static_temperature < 150 then static_temperature + 273.15 else static_temperature end, case when coalesce(altitude, 0) * 0.3048 > 11000 then 216.65 else 288.15 - 0.0065 * coalesce(altitude, 0) * 0.3048 end) as era_temp_K from track"""


@query("p11_f22_f23_context", f"select {ID}, epoch_us(timestamp) as timestamp, {rounded('raw_alt_m', 'era_tas_ms', 'fdm_heading_rad', 'fdm_long_wind_ms', 'era_temp_K')} from ({P11}) x")
def _(t):
    return inputs.context(t.track.drop("h_sel")).select(*K, "timestamp", "raw_alt_m", "era_tas_ms", "fdm_heading_rad", "fdm_long_wind_ms", "era_temp_K")


@query("p12_aligned_inputs", f"select {ID}, i + 1 as rn, round(h_sel * 0.3048, 6) as fdm_alt_target_m, round(era_temp_K, 6) as temp, round(case when i = 0 then coalesce(raw_alt_m, 0) end, 6) as x_alt from ({P11}) x join (select {ID}, i, h_sel, n from track) y using (route, flight_id, i) where i + 1 < n")
def _(t):
    d = inputs.aligned(inputs.targets(t.track), inputs.context(t.track.drop("h_sel")))
    return d.select(*K, "rn", "fdm_alt_target_m", F.col("era_temp_K").alias("temp"), F.col("x_raw_alt_m").alias("x_alt"))


@query("p13_profile", f"select {ID}, epoch_us(timestamp) as timestamp, phase, round(altitude, 6) as h_ft, round(vertical_rate, 6) as vz_fpm, round(coalesce(TAS, CAS), 6) as tas_kt from track")
def _(t):
    d = t.track.select(*K, "timestamp", "phase", "TAS", F.col("altitude").alias("obs_altitude_ft"), F.col("vertical_rate").alias("obs_vertical_rate_fpm"), F.col("CAS").alias("gen_tas_kt"))
    return replay.profile(d, "observed").select(*K, "timestamp", "phase", "h_ft", "vz_fpm", "tas_kt")


@query("p14_prepared_commands", f"select {ID}, i, round(coalesce(last_value(h_sel ignore nulls) {W[:-1]}), first_value(h_sel ignore nulls) over (partition by route, flight_id order by timestamp rows between current row and unbounded following)), 6) as alt_sel_ft, round(coalesce(cas_sel, CAS), 6) as cas_cmd_kt, round(coalesce(mach_sel, Mach), 6) as mach_cmd from track")
def _(t):
    return replay.prepare(t.track).select(*K, "i", "alt_sel_ft", "cas_cmd_kt", "mach_cmd")


# --- Joins ----------------------------------------------------------------------------------------------------


def nearest_sql(left: str, right: str, value: str, tol: float | None, tie: str = "", lts: str = "timestamp", rts: str = "timestamp") -> str:
    """left rows (alias l) with the nearest right value, by two as-of joins."""
    r = f"(select * from {right} where {value} is not null)"
    choose = "b.t is not null and (f.t is null or epoch_us(l.ts) - epoch_us(b.t) <= epoch_us(f.t) - epoch_us(l.ts))"
    near = f"case when {choose} then b.v else f.v end" if tol is None else f"case when {choose} then case when epoch_us(l.ts) - epoch_us(b.t) <= {int(tol * 1e6)} then b.v end when epoch_us(f.t) - epoch_us(l.ts) <= {int(tol * 1e6)} then f.v end"
    return (
        f"select l.* exclude (ts), {near} as near from (select *, {lts} as ts from {left}) l asof left join (select route as r, flight_id as fl, {rts} as t, {value} as v from {r} x) b on l.route = b.r and l.flight_id = b.fl and l.ts >= b.t"
        f" asof left join (select route as r, flight_id as fl, {rts} as t, {value} as v from {r} x) f on l.route = f.r and l.flight_id = f.fl and l.ts <= f.t"
    )


@query("j1_asof_nearest", f"select {ID}, i, {rounded('near')} from ({nearest_sql('track', 'sparse', 'altitude_ft', 2)}) x")
def _(t):
    return asof.asof_nearest(t.track.select(*K, "timestamp", "i"), t.sparse.filter("altitude_ft is not null"), {"near": (F.struct("altitude_ft"), 2.0)}, rows=2 * t.rows).select(*K, "i", F.col("near.altitude_ft").alias("near"))


@query("j2_asof_grid", f"select a.route, a.flight_id, a.i, round(a.near, 6) as alt, round(b.near, 6) as tas from ({nearest_sql('track', 'sparse', 'altitude_ft', 2)}) a join ({nearest_sql('track', 'sparse', 'TAS', 5)}) b using (route, flight_id, i)")
def _(t):
    return asof.asof_nearest(t.track.select(*K, "timestamp", "i"), t.sparse, {"alt": (F.col("altitude_ft"), 2.0), "tas": (F.col("TAS"), 5.0)}, rows=2 * t.rows).select(*K, "i", "alt", "tas")


@query("j3_phase_at_event", f"select {ID}, command, epoch_us(t0) as start_timestamp, near as phase from ({nearest_sql('cmd', 'track', 'phase', 2, lts='t0')}) x")
def _(t):
    return events_of(t).select(*K, "command", "start_timestamp", "phase")


@query("j5_event_in_plateau", f"select c.route, c.flight_id, c.command, epoch_us(c.t0) as start_timestamp, round(h.value, 6) as plateau_value, round(least(greatest((epoch(c.t0) - epoch(h.t0)) / greatest(epoch(h.stop) - epoch(h.t0), 1.0), 0.0), 1.0), 6) as u from cmd c join (select *, coalesce(lead(t0) over (partition by route, flight_id order by t0), t0 + greatest(duration_s, 60.0) * interval '1' second) as stop from cmd where command = 'h_sel') h on h.route = c.route and h.flight_id = c.flight_id and c.t0 >= h.t0 and c.t0 < h.stop where c.command in ('vz_sel', 'cas_sel')")
def _(t):
    e = islands.command_events(t.track)
    d = asof.plateau_of(e.filter(F.col("command").isin("vz_sel", "cas_sel")), e.filter("command = 'h_sel'").select(*K, "start_timestamp", "duration_s", "value"))
    return d.select(*K, "command", "start_timestamp", "plateau_value", "u")


@query("j6_asof_forward", "select l.route, l.flight_id, l.seq, coalesce(f.i, z.last_i) as i from sparse l asof left join (select route, flight_id, timestamp, i from track) f on l.route = f.route and l.flight_id = f.flight_id and l.timestamp <= f.timestamp left join (select route, flight_id, max(i) as last_i from track group by 1, 2) z on z.route = l.route and z.flight_id = l.flight_id")
def _(t):
    return asof.asof_forward(t.sparse.select(*K, "timestamp", "seq"), t.track, {"i": F.col("i")}, rows=2 * t.rows).select(*K, "seq", "i")


@query("j7_event_position", f"select {ID}, epoch_us(timestamp) as timestamp, round(case when near.longitude is not null then near.latitude end, 6) as latitude, round(case when near.latitude is not null then near.longitude end, 6) as longitude from ({nearest_sql('tod', '(select *, case when true then {latitude: latitude, longitude: longitude} end as p from sparse)', 'p', 30)}) x", 6)
def _(t):
    d = descent.with_position(descent.top_of_descent(t.track), t.sparse).select(*K, "timestamp", "latitude", "longitude")
    return d


@query("j8_nearest_known", f"select {ID}, epoch_us(timestamp) as timestamp, near as seq from ({nearest_sql('tod', '(select * from sparse where latitude is not null)', 'seq', None)}) x")
def _(t):
    return asof.asof_nearest(descent.top_of_descent(t.track), t.sparse.filter("latitude is not null"), {"seq": (F.col("seq"), None)}).select(*K, "timestamp", "seq")


@query("j9_j14_left_joins", "select f.route, f.flight_id, a.typecode, round(d.hh, 6) as h_sel_ft from flights f left join aircraft a using (icao24) left join tod d on d.route = f.route and d.flight_id = f.flight_id")
def _(t):
    tod = descent.top_of_descent(t.track).select(*K, "h_sel_ft")
    return tables.with_aircraft(t.flights, t.aircraft).join(tod, K, "left").select(*K, "typecode", "h_sel_ft")


@query("j10_conditioned_events", "select c.route, c.flight_id, c.command, count(*) as events from cmd c join meta m on m.route = c.route and m.flight_id = c.flight_id where m.family = 'B737' group by 1, 2, 3")
def _(t):
    return islands.command_events(t.track).join(meta_of(t).filter("family = 'B737'").select(*K), K).groupBy(*K, "command").agg(F.count(F.lit(1)).alias("events"))


@query("j11_semi", "select route, flight_id, i from track where (route, flight_id) in (select route, flight_id from flights where status = 'done')")
def _(t):
    return t.track.join(tables.accepted_flights(t.flights), K, "left_semi").select(*K, "i")


@query("j12_u2_anti", "select flight_id from flights where status <> 'done'")
def _(t):
    return manifest.not_done(t.flights).select("flight_id")


@query("j13_union_grid", f"select coalesce(a.route, b.route) as route, coalesce(a.flight_id, b.flight_id) as flight_id, epoch_us(coalesce(a.timestamp, b.timestamp)) as timestamp, round(a.v, 6) as cas, round(b.v, 6) as alt from (select {ID}, timestamp, CAS as v from track) a full join (select {ID}, timestamp, altitude_ft as v from sparse) b on a.route = b.route and a.flight_id = b.flight_id and a.timestamp = b.timestamp")
def _(t):
    return assembly.merge_series({"cas": t.track.select(*K, "timestamp", F.col("CAS").alias("value")), "alt": t.sparse.select(*K, "timestamp", F.col("altitude_ft").alias("value"))})


# --- Aggregations --------------------------------------------------------------------------------------------------


@query("a1_w13_segments", f"select {ID}, command, epoch_us(t0) as start_timestamp, epoch_us(t1) as end_timestamp, {rounded('duration_s', 'value')} from cmd where command = 'vz_sel'")
def _(t):
    d = islands.value_islands(t.track, "vz_sel", 50.0)
    return islands.segments(d, "vz_sel", K).select(*K, F.lit("vz_sel").alias("command"), "start_timestamp", "end_timestamp", "duration_s", "value")


@query("a2_phase_seconds", f"select {ID}, " + ", ".join(f"cast(nullif(count(*) filter (where phase = '{p}'), 0) as double) as phase_{p.lower()}_s" for p in descent.PHASES) + f" from track group by {ID}")
def _(t):
    return descent.phase_seconds(t.track)


@query("a3_first_value", f"select {ID}, round(arg_min(altitude, timestamp), 6) as altitude from track where altitude is not null group by {ID}")
def _(t):
    return reports.first_values(t.track, "altitude", "timestamp")


@query("a4_segment_counts", f"select {ID}, command, count(*) as segments from cmd group by {ID}, command")
def _(t):
    return islands.command_events(t.track).groupBy(*K, "command").agg(F.count(F.lit(1)).alias("segments"))


@query("a5_error_metrics", f"select {ID}, round(sqrt(avg(e * e)), 6) as rmse_ft, round(avg(abs(e)), 6) as mae_ft, round(avg(e), 6) as bias_ft, count(e) as n from (select {ID}, h_sel - altitude as e from track) x group by {ID}")
def _(t):
    d = t.track.select(*K, "timestamp", F.col("h_sel").alias("gen_altitude_ft"), F.col("altitude").alias("obs_altitude_ft"), F.col("CAS").alias("gen_tas_kt"), F.col("vz_sel").alias("gen_rocd_fpm"), F.col("vertical_rate").alias("obs_vertical_rate_fpm"))
    return replay.replay_metrics(d).select(*K, "rmse_ft", "mae_ft", "bias_ft", "n")


@query("a6_median", "select l_returnflag, round(median(l_extendedprice), 6) as median_price from lineitem group by 1")
def _(t):
    return series.quantiles(t.base("lineitem"), "l_extendedprice", ["l_returnflag"], [0.5]).select("l_returnflag", F.col("q")[0].alias("median_price"))


@query("a7_quantiles", "select phase, k, round(q[k], 6) as q from (select phase, quantile_cont(altitude, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) as q from track group by phase) x, (select unnest(range(1, 20)) as k) y")
def _(t):
    q = series.quantiles(t.track, "altitude", ["phase"], compare.QUANTILES)
    return q.select("phase", F.posexplode("q").alias("k", "q")).select("phase", (F.col("k") + 1).alias("k"), "q")


@query("a8_acceptance", "select route, count(*) filter (where status = 'done') as accepted, count(*) filter (where status <> 'done') as rejected, count(*) as with_data from flights group by rollup (route)")
def _(t):
    return quality.acceptance(t.flights.select("route", (F.col("status") == "done").alias("accepted")))


def stats_of(t: Tables) -> DataFrame:
    return reports.route_stats(t.flights, t.flights.select("route", (F.col("balance") > 0).alias("accepted")), lengths_of(t), [0.0, 890.0, 910.0, 20000.0])


@query("a9_route_stats", "select f.route, count(*) as manifest_rows, count(*) filter (where status = 'done') as done, count(*) filter (where balance > 0) as accepted, count(*) filter (where not balance > 0) as rejected, round(any_value(l.gc_nm), 6) as gc_nm, case when any_value(l.gc_nm) < 890 then '0–890 nm' when any_value(l.gc_nm) < 910 then '890–910 nm' else '910–20000 nm' end as band from flights f join lengths l using (route) group by f.route")
def _(t):
    return stats_of(t)


@query("a10_totals", "select count(distinct route) as routes, (select count(*) from (select departure from flights union select arrival from flights)) as airports, count(*) filter (where balance > 0) as accepted, count(*) filter (where status = 'done') as done from flights")
def _(t):
    return reports.totals(stats_of(t)).select("routes", "airports", "accepted", "done")


@query("a11_key_figures", "select count(*) as flights, count(distinct route) as routes, count(distinct typecode) as typecodes, (select count(*) from (select departure from flights union select arrival from flights)) as airports from meta")
def _(t):
    return reports.key_figures(meta_of(t)).select("flights", "routes", "typecodes", "airports")


@query("a12_t4_counts", "select family, count(*) as flights from meta group by family order by 2 desc, 1 limit 3")
def _(t):
    return reports.counts(meta_of(t), "family", 3)


@query("a13_distinct", "select distinct family from meta")
def _(t):
    return meta_of(t).select("family").distinct().orderBy("family")


@query("a14_phase_and_all", "select coalesce(phase, 'ALL') as phase, round(avg(vertical_rate), 6) as mean_rate, count(*) as rows from track group by grouping sets ((phase), ())")
def _(t):
    d = t.track.groupingSets([[F.col("phase")], []], F.col("phase")).agg(F.avg("vertical_rate").alias("mean_rate"), F.count(F.lit(1)).alias("rows"))
    return d.select(F.coalesce("phase", F.lit("ALL")).alias("phase"), "mean_rate", "rows")


@query("a16_upsert", "select flight_id, seq, status, price from (select *, row_number() over (partition by flight_id order by seq desc) as k from log) x where k = 1")
def _(t):
    return manifest.upsert(t.log, "seq")


# --- Windows and fills -----------------------------------------------------------------------------------------------


def frame(rows: str) -> str:
    return f"over (partition by route, flight_id order by timestamp rows between {rows})"


def sliced(d: DataFrame, **running) -> DataFrame:
    """A scan in slices of some minutes, as the series of the given tables are short."""
    return scan.scanned(d, running, scan.slice_of(F.unix_micros("timestamp"), 200.0))


@query("w1_forward_fill", f"select {ID}, i, round(last_value(static_temperature ignore nulls) {frame('6 preceding and current row')}, 6) as t6, round(last_value(static_temperature ignore nulls) {frame('unbounded preceding and current row')}, 6) as t from track")
def _(t):
    d = sliced(t.track.select(*K, "timestamp", "i", "static_temperature"), row=("row", None), last=("last", F.col("static_temperature")))
    return d.select(*K, "i", scan.within(F.col("last"), F.col("row"), 6).alias("t6"), F.col("last.v").alias("t"))


@query("w2_fill_both", f"select {ID}, i, round(coalesce(last_value(x ignore nulls) {frame('unbounded preceding and current row')}, first_value(x ignore nulls) {frame('current row and unbounded following')}), 6) as x from (select *, case when i > 20 and ln = 3 then altitude end as x from track) y")
def _(t):
    d = t.track.withColumn("x", F.when((F.col("i") > 20) & (F.col("ln") == 3), F.col("altitude")))
    d = sliced(d.select(*K, "timestamp", "i", "x"), last=("last", F.col("x")), following=("next", F.col("x")))
    return d.select(*K, "i", F.coalesce("last.v", "following.v").alias("x"))


@query("w3_interpolate", f"select {ID}, i, round(coalesce(altitude, bv + (fv - bv) * (i - bi) / (fi - bi), bv, fv), 6) as altitude from (select *, last_value(altitude ignore nulls) {frame('unbounded preceding and current row')} as bv, first_value(altitude ignore nulls) {frame('current row and unbounded following')} as fv, last_value(case when altitude is not null then i end ignore nulls) {frame('unbounded preceding and current row')} as bi, first_value(case when altitude is not null then i end ignore nulls) {frame('current row and unbounded following')} as fi from track) x")
def _(t):
    d = sliced(t.track.select(*K, "timestamp", "i", "altitude"), row=("row", None), last=("last", F.col("altitude")), following=("next", F.col("altitude")))
    return d.select(*K, "i", scan.between(F.col("altitude"), F.col("row"), F.col("last"), F.col("following")).alias("altitude"))


@query("w4_rolling_median", f"select {ID}, i, round(quantile_cont(vertical_rate, 0.5) {frame('7 preceding and 7 following')}, 6) as m from track")
def _(t):
    return t.track.select(*K, "i", series.rolling("vertical_rate", series.series(), 15, "median").alias("m"))


@query("w5_rolling_spread", f"select {ID}, i, round(max(CAS) {frame('60 preceding and 59 following')} - min(CAS) {frame('60 preceding and 59 following')}, 6) as spread from track")
def _(t):
    d = series.rolling_extremes(t.track.select(*K, "timestamp", "i", "CAS"), "CAS", 120, "low", "high")
    return d.select(*K, "i", (F.col("high") - F.col("low")).alias("spread"))


@query("w6_rolling_mean", f"select {ID}, i, round(avg(vertical_rate) {frame('25 preceding and 25 following')}, 6) as m from track")
def _(t):
    return series.smooth(t.track, "vertical_rate", "m", 51, "rolling").select(*K, "i", "m")


@query("w7_binned_mean", f"select {ID}, i, round(avg(Mach) over (partition by {ID}, i // 201), 6) as m from track")
def _(t):
    return series.smooth(t.track, "Mach", "m", 201, "binned").select(*K, "i", "m")


#: The least-squares parabola around row c, of the 2 m + 1 rows from c - m to c + m, read off at rn.
W8 = """
with r as (select route, flight_id, i, cast(vertical_rate as double) as y, row_number() over (partition by route, flight_id order by timestamp) as rn,
    count(*) over (partition by route, flight_id) as n from track),
m as (select *, (least(51, n - case when n % 2 = 0 then 1 else 0 end) - 1) // 2 as m from r),
c as (select *, least(greatest(rn, m + 1), n - m) as c from m),
s as (select c.route, c.flight_id, c.i, any_value(c.rn - c.c) as t, any_value(cast(c.m as double)) as m, sum(o.y) as s0, sum(o.y * (o.rn - c.c)) as s1, sum(o.y * (o.rn - c.c) * (o.rn - c.c)) as s2
    from c join r o on o.route = c.route and o.flight_id = c.flight_id and o.rn between c.c - c.m and c.c + c.m group by 1, 2, 3),
k as (select *, 2 * m + 1 as m0, m * (m + 1) * (2 * m + 1) / 3 as m2, m * (m + 1) * (2 * m + 1) * (3 * m * m + 3 * m - 1) / 15 as m4 from s)
select route, flight_id, i, (m4 * s0 - m2 * s2) / (m0 * m4 - m2 * m2) + s1 / m2 * t + (m0 * s2 - m2 * s0) / (m0 * m4 - m2 * m2) * t * t as m from k
"""


@query("w8_parabola", f"select route, flight_id, i, round(m, 4) + 0.0 as m from ({W8}) x", 4)
def _(t):
    return series.smooth(t.track, "vertical_rate", "m", 51, "parabola").select(*K, "i", "m")


@query("w9_differences", f"select {ID}, i, round(altitude - lag(altitude) {W}, 6) as back, round(lead(CAS) {W} - CAS, 6) as ahead from track")
def _(t):
    w = series.series()
    return t.track.select(*K, "i", (F.col("altitude") - F.lag("altitude").over(w)).alias("back"), (F.lead("CAS").over(w) - F.col("CAS")).alias("ahead"))


@query("w10_running_extremes", f"select {ID}, i, round(max(altitude) {frame('unbounded preceding and current row')}, 6) as hi, round(min(CAS) {frame('unbounded preceding and current row')}, 6) as lo from track")
def _(t):
    return sliced(t.track.select(*K, "timestamp", "i", "altitude", "CAS"), hi=("max", F.col("altitude")), lo=("min", F.col("CAS"))).select(*K, "i", "hi", "lo")


@query("w11_integration", f"select {ID}, i, round(100.0 + sum(coalesce(vz_sel, 0)) {frame('unbounded preceding and current row')} / 60.0, 4) as h_est from track", 4)
def _(t):
    return assembly.altitude_estimate(t.track, 100.0).select(*K, "i", "h_est")


@query("w12_first_row", f"select {ID}, min(i + 1) filter (where phase = 'CLIMB') as climb, min(i + 1) filter (where altitude > 20000) as high from track group by {ID}")
def _(t):
    d = series.with_rows(t.track)
    d = d.withColumn("climb", series.first_row(d, F.col("phase") == "CLIMB")).withColumn("high", series.first_row(d, F.col("altitude") > 20000))
    return d.select(*K, "climb", "high").distinct()


def stable_sql(value: str, tol: float, least: int, width: int, alt: float | None, smooth: str | None = None) -> str:
    high = f"and altitude > {alt}" if alt is not None else ""
    smooth = smooth or f"select *, avg({value}) over (partition by {ID}, i // {width}) as s from track"
    spread = f"select *, max(s) {frame(f'{least // 2} preceding and {least - 1 - least // 2} following')} - min(s) {frame(f'{least // 2} preceding and {least - 1 - least // 2} following')} as spread from ({smooth}) a"
    flag = f"select *, coalesce(i > 0 and spread < {tol} and {value} is not null {high}, false) as good from ({spread}) b"
    run = f"select *, i - row_number() over (partition by {ID}, good order by timestamp) as island from ({flag}) c"
    return f"select {ID}, min(i) + 1 as start_row, max(i) + 1 as end_row, min(time) as start_time, max(time) as end_time, avg({value}) as var_mean, avg(altitude) as alt_mean from ({run}) d where good group by {ID}, island having count(*) >= {least}"


#: Mach plateaus need rows without gaps in the altitude.
LEVELLED = "(select * replace (coalesce(altitude, 25000.0) as altitude) from track) levelled"
MACH_SQL = f"select * from ({stable_sql('Mach', 0.01, 60, 51, 20000).replace('from track', 'from ' + LEVELLED, 1)}) m where var_mean >= 0.5"


def levelled(t: Tables, track: DataFrame | None = None) -> DataFrame:
    return (t.track if track is None else track).withColumn("altitude", F.coalesce("altitude", F.lit(25000.0)))




@query("w14_stable_segments", f"select {ID}, start_row, end_row, {rounded('start_time', 'end_time', 'var_mean')} from ({stable_sql('CAS', 2.5, 30, 21, None)}) x")
def _(t):
    return islands.stable_segments(t.track, "CAS", 2.5, 30, width=21).select(*K, "start_row", "end_row", "start_time", "end_time", "var_mean")


def small_extraction() -> commands.Extraction:
    return commands.Extraction(mach_len=60, mach_width=50, cas_len=30, cas_width=20, block_alt_ft=20000.0, block_bridge_s=40.0)


@query("c4_mach_segments", f"select {ID}, start_row, end_row, {rounded('start_time', 'end_time', 'var_mean', 'alt_mean')} from ({MACH_SQL}) x")
def _(t):
    return commands.mach_segments(levelled(t), small_extraction())


BLOCKS = f"select {ID}, min(start_time) as block_start, max(end_time) as block_end from (select *, sum(new) over (partition by {ID} order by start_time rows unbounded preceding) as b from (select *, case when start_time - max(end_time) over (partition by {ID} order by start_time rows between unbounded preceding and 1 preceding) <= 40 then 0 else 1 end as new from ({MACH_SQL}) s where alt_mean >= 20000) u) v group by {ID}, b"


@query("w16_merge_blocks", f"select {ID}, {rounded('block_start', 'block_end')} from ({BLOCKS}) x")
def _(t):
    c = small_extraction()
    return commands.mach_blocks(commands.mach_segments(levelled(t), c), c)


@query("w16_bridged_sessions", "select flight_id, epoch_us(min(timestamp)) as first, epoch_us(max(timestamp)) as last, count(*) as events from (select *, sum(new) over (partition by flight_id order by timestamp, event_id) as b from (select *, case when epoch(timestamp) - epoch(lag(timestamp) over (partition by flight_id order by timestamp, event_id)) <= 21600 then 0 else 1 end as new from irregular) x) y group by flight_id, b")
def _(t):
    d = t.irregular.select("flight_id", "event_id", keys.seconds("timestamp").alias("s"))
    b = islands.merge_blocks(d.withColumn("start_time", F.col("s")).withColumn("end_time", F.col("s")), 21600.0, keys=["flight_id"])
    return islands.with_block(d, "s", b, ["flight_id"]).groupBy("flight_id", "block_start").agg(F.rint(F.min("s") * 1e6).cast("long").alias("first"), F.rint(F.max("s") * 1e6).cast("long").alias("last"), F.count(F.lit(1)).alias("events")).drop("block_start")


@query("c7_paint", f"select t.route, t.flight_id, t.i, round(s.var_mean, 6) as mach_sel from track t left join ({MACH_SQL}) s on s.route = t.route and s.flight_id = t.flight_id and t.i + 1 between s.start_row and s.end_row")
def _(t):
    d = series.with_rows(t.track.drop("mach_sel"))
    return islands.paint(d, commands.mach_segments(levelled(t), small_extraction()), "mach_sel", rows=t.rows).select(*K, "i", "mach_sel")


CAS_SQL = stable_sql("CAS", 2.5, 30, 21, None).replace("from track", f"from (select t.* replace (case when b.block_start is not null then null else t.CAS end as CAS) from track t left join ({BLOCKS}) b on b.route = t.route and b.flight_id = t.flight_id and t.time between b.block_start and b.block_end) masked", 1)


FREE_CAS = f"select * from ({CAS_SQL}) c where exists (select 1 from track t where t.route = c.route and t.flight_id = c.flight_id and t.i + 1 between c.start_row and c.end_row and not exists (select 1 from ({MACH_SQL}) s where s.route = t.route and s.flight_id = t.flight_id and t.i + 1 between s.start_row and s.end_row))"


@query("c5_cas_segments", f"select {ID}, start_row, end_row, {rounded('var_mean')} from ({FREE_CAS}) x")
def _(t):
    c, track = small_extraction(), t.written("time", "altitude", "Mach", "CAS")
    mach = tables.settle(commands.mach_segments(levelled(t, track), c))
    return commands.cas_segments(track, mach, c, rows=t.rows).select(*K, "start_row", "end_row", "var_mean")


def plateau_sql(rows: str) -> str:
    """Row by row: a row within 50 of the first value of its plateau stays in it; a null ends it. rows has (keys, i, timestamp, v)."""
    return f"""
with recursive r as materialized (select route, flight_id, i, v, row_number() over (partition by route, flight_id order by timestamp) as rn from ({rows}) x),
p as (select route, flight_id, i, rn, v, case when v is not null then rn end as s, v as a from r where rn = 1
  union all
  select r.route, r.flight_id, r.i, r.rn, r.v, case when r.v is null then null when p.a is null or abs(r.v - p.a) > 50 then r.rn else p.s end,
    case when r.v is null then null when p.a is null or abs(r.v - p.a) > 50 then r.v else p.a end
  from p join r on r.route = p.route and r.flight_id = p.flight_id and r.rn = p.rn + 1)
select route, flight_id, i, rn, v, s as plateau_start, a as plateau_value from p
"""


def bridged_sql(rows: str) -> str:
    """(keys, i, filled, held): gaps bridged between plateaus, then closed at both ends; gaps of up to three rows held only."""
    back, ahead = "over (partition by route, flight_id order by rn)", "over (partition by route, flight_id order by rn rows between current row and unbounded following)"
    return f"""
select route, flight_id, i, coalesce(o, last_value(o ignore nulls) {back}, first_value(o ignore nulls) {ahead}) as filled,
  coalesce(v, case when coalesce(fn, n + 1) - bn - 1 <= 3 then last_value(v ignore nulls) {back} end) as held
from (select *, coalesce(v, bv + cast(rn - bn as double) / (fn - bn) * (fv - bv)) as o
  from (select *, count(*) over (partition by route, flight_id) as n,
      last_value(plateau_start - plateau_start + rn ignore nulls) {back} as bn, last_value(plateau_value ignore nulls) {back} as bv,
      first_value(plateau_start - plateau_start + rn ignore nulls) {ahead} as fn, first_value(plateau_value ignore nulls) {ahead} as fv
    from ({plateau_sql(rows)}) a) b) c
"""


RATES = "select route, flight_id, i, timestamp, vz_sel as v from track"


@query("w15_plateaus", f"select route, flight_id, i, plateau_start, round(plateau_value, 6) as plateau_value from ({plateau_sql(RATES)}) x")
def _(t):
    return series.plateaus(t.written("i", "vz_sel"), "vz_sel", 50.0, rows=t.rows).select(*K, "i", "plateau_start", "plateau_value")


@query("w17_speed_holds", f"select {ID}, i, {rounded('mach_hold', 'cas_hold')} from (select *, " + ", ".join(f"coalesce({n}, first_value({n} ignore nulls) {frame('current row and unbounded following')}) as {n[1:]}" for n in ("_mach_hold", "_cas_hold")) + f" from (select *, last_value(mach_sel ignore nulls) over (partition by {ID}, phase order by timestamp) as _mach_hold, last_value(cas_sel ignore nulls) over (partition by {ID}, phase order by timestamp) as _cas_hold from track) x) y")
def _(t):
    return replay.speed_holds(t.track).select(*K, "i", "mach_hold", "cas_hold")


PHI = f"select t.*, case when s.span > 30 then (epoch(t.timestamp) - epoch(s.s0)) / s.span end as phi from track t join slab s on s.route = t.route and s.flight_id = t.flight_id and s.phase = t.phase"


@query("w18_share_in_phase", f"select {ID}, i, {rounded('phi')} from ({PHI}) x")
def _(t):
    return series.share_in_phase(t.track).select(*K, "i", "phi")


@query("w19_elapsed", "select flight_id, event_id, round((epoch_us(timestamp) - min(epoch_us(timestamp)) over (partition by flight_id)) / 1e6, 6) as s from irregular")
def _(t):
    return t.irregular.select("flight_id", "event_id", series.elapsed_s("timestamp", ["flight_id"]).alias("s"))


@query("w20_empirical_cdf", "select phase, value, max(cdf) as cdf from (select phase, round(CAS, 6) as value, round(cume_dist() over (partition by phase order by CAS), 6) as cdf from track where CAS is not null) x group by phase, value")
def _(t):
    return series.empirical_cdf(t.track.withColumnRenamed("CAS", "value"), "value", ["phase"])


@query("w21_fill_rate", f"select {ID}, i, {rounded('filled', 'held')} from ({bridged_sql(RATES)}) x")
def _(t):
    d = series.fill_rate(t.written("i", "vz_sel"), "vz_sel", "filled", rows=t.rows)
    return series.fill_rate(d, "vz_sel", "held", bridge=False, hold_rows=3, fill=False).select(*K, "i", "filled", "held")


# --- Sort, limit, sets ---------------------------------------------------------------------------------------------------


@query("t1_longest", "select flight_id from flights order by epoch_us(lastseen) - epoch_us(firstseen) desc, flight_id limit 20")
def _(t):
    return manifest.longest(t.flights, 20).select("flight_id")


@query("t2_first_of_group", f"select {ID} from (select *, row_number() over (partition by route order by firstseen, flight_id) as k from flights) x where k <= 5")
def _(t):
    from pyspark.sql import Window

    d = t.flights.withColumn("k", F.row_number().over(Window.partitionBy("route").orderBy("firstseen", "flight_id")))
    return d.filter("k <= 5").select(*K)


@query("t3_by_first_seen", "select flight_id, epoch_us(firstseen) as firstseen from flights order by firstseen, flight_id")
def _(t):
    return t.flights.orderBy("firstseen", "flight_id").select("flight_id", "firstseen")


@query("t5_extend_manifest", "select flight_id from flights where status = 'done' union all (select flight_id from flights where status <> 'done' order by firstseen, flight_id limit 2)")
def _(t):
    done = t.flights.filter("status = 'done'")
    return manifest.extend(done, t.flights, done.count() + 2).select("flight_id")


@query("u1_union_by_name", f"select {ID}, epoch_us(timestamp) as timestamp, round(altitude, 6) as altitude_ft, cast(null as double) as IAS from track union all select {ID}, epoch_us(timestamp), null, round(IAS, 6) from sparse")
def _(t):
    a = t.track.select(*K, "timestamp", F.col("altitude").alias("altitude_ft"))
    return a.unionByName(t.sparse.select(*K, "timestamp", "IAS"), allowMissingColumns=True)


@query("u2_except", "select flight_id from flights except all select flight_id from flights where status = 'done'")
def _(t):
    return t.flights.select("flight_id").exceptAll(t.flights.filter("status = 'done'").select("flight_id"))


@query("u4_airports_used", "select departure as icao from flights union select arrival from flights")
def _(t):
    return reports.airports_used(t.flights.select("route"))


# --- Scalar functions --------------------------------------------------------------------------------------------------


@query("f1_flight_id", "select flight_id, concat_ws('_', case when callsign is null or replace(callsign, ' ', '') = '' then 'NOCALL' else replace(callsign, ' ', '') end, icao24, cast(cast(epoch(firstseen) as bigint) as varchar)) as id from flights")
def _(t):
    return t.flights.select("flight_id", keys.flight_id("icao24", "callsign", "firstseen").alias("id"))


@query("f2_f3_times", "select event_id, epoch_us(date_trunc('minute', timestamp)) as minute, epoch_us(timestamp) as parsed from irregular")
def _(t):
    d = t.irregular.withColumn("text", F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return d.select("event_id", keys.minute("timestamp").alias("minute"), keys.parse_time("text").alias("parsed"))


@query("f4_haversine", f"select {ID}, i, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(40 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40)) * pow(sin(radians(5 - longitude) / 2), 2))), 4) as km from track", 4)
def _(t):
    return t.track.select(*K, "i", aero.haversine_km("latitude", "longitude", F.lit(40.0), F.lit(5.0)).alias("km"))


@query("f5_route_length", f"select route, {rounded('gc_km', 'gc_nm', digits=4)} from lengths", 4)
def _(t):
    return lengths_of(t)


HAV = "2 * 6371.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"
TO_END = "select t.*, " + HAV.format(a="t.latitude", b="t.longitude", c="p.latitude", d="p.longitude") + " as km from track t join airports p on p.icao = split_part(t.route, '_', 2) where t.latitude is not null"


@query("f6_to_destination", f"with e as ({TO_END}) select x.route, x.flight_id, round(least(greatest(1 - x.near / z.km, 0), 1), 6) as phi_d from ({nearest_sql('tod', 'e', 'km', None)}) x join (select {ID}, arg_min(km, timestamp) as km from e group by {ID}) z using (route, flight_id)".replace("with e as", "select * from (with e as", 1) + ")")
def _(t):
    return descent.to_destination(descent.top_of_descent(t.track), t.track, ends_of(t)).select(*K, "phi_d")


LEGS = "select *, sum(leg) over (partition by route, flight_id order by timestamp) as km, sum(leg) over (partition by route, flight_id) as total from (select *, coalesce(" + HAV.format(a="pa", b="po", c="latitude", d="longitude") + f", 0) as leg from (select *, lag(latitude) {W} as pa, lag(longitude) {W} as po from track where latitude is not null) x) y"


@query("f7_progress", f"select {ID}, round(near, 6) as flight_progress from ({nearest_sql('tod', f'(select *, km / total as share from ({LEGS}) q)', 'share', None)}) z")
def _(t):
    e = descent.top_of_descent(t.track)
    return descent.progress(e, t.track).select(*K, "flight_progress")


PHASED = f"select *, case when altitude <= 100 then 'GROUND' when altitude > 100 and m >= 200 then 'CLIMB' when altitude > 100 and m <= -200 then 'DESCENT' else 'LEVEL' end as ph from (select *, quantile_cont(vertical_rate, 0.5) {frame('7 preceding and 7 following')} as m from track) x"


@query("f8_c10_phases", f"select {ID}, i, ph as phase from ({PHASED}) y")
def _(t):
    return commands.with_phases(t.track).select(*K, "i", "phase")


@query("f9_path_angle", f"select {ID}, i, round(degrees(asin(least(greatest(vertical_rate * 0.00508 / greatest(CAS * 0.514444, 1.0), -1.0), 1.0))), 6) as gamma_deg from track where CAS is not null")
def _(t):
    return t.track.filter("CAS is not null").select(*K, "i", aero.flight_path_angle_deg("vertical_rate", "CAS").alias("gamma_deg"))


def isa(h: str) -> dict[str, str]:
    """SQL of the standard atmosphere at a height in m."""
    temp = f"(case when {h} > 11000 then 216.65 else 288.15 - 0.0065 * {h} end)"
    expo, at = "(9.80665 / (287.05287 * 0.0065))", "(101325.0 * pow(216.65 / 288.15, 9.80665 / (287.05287 * 0.0065)))"
    pressure = f"(case when {h} > 11000 then {at} * exp(-9.80665 / (287.05287 * 216.65) * ({h} - 11000)) else 101325.0 * pow(1 - 0.0065 * {h} / 288.15, {expo}) end)"
    sound = f"sqrt(1.4 * 287.05287 * {temp})"
    return {"sound": sound, "pressure": pressure}


def mach_tas(m: str, h: str) -> str:
    return f"({m} * {isa(h)['sound']} / 0.514444)"


def cas_tas(c: str, h: str) -> str:
    q = f"(101325.0 * (pow(1 + 0.2 * pow({c} * 0.514444 / sqrt(1.4 * 287.05287 * 288.15), 2), 3.5) - 1))"
    return f"(sqrt(5 * (pow({q} / {isa(h)['pressure']} + 1, 2.0 / 7) - 1)) * {isa(h)['sound']} / 0.514444)"


def tas_cas(v: str, h: str) -> str:
    m = f"({v} * 0.514444 / {isa(h)['sound']})"
    return f"(sqrt(1.4 * 287.05287 * 288.15) * sqrt(5 * (pow({isa(h)['pressure']} * (pow(1 + 0.2 * {m} * {m}, 3.5) - 1) / 101325.0 + 1, 2.0 / 7) - 1)) / 0.514444)"


H = "(altitude * 0.3048)"


@query("f10_isa_speeds", f"select {ID}, i, round({mach_tas('Mach', H)}, 4) as mach_tas, round({cas_tas('CAS', H)}, 4) as cas_tas, round({tas_cas('TAS', H)}, 4) as tas_cas from track where altitude is not null", 4)
def _(t):
    h = F.col("altitude") * aero.FT_M
    return t.track.filter("altitude is not null").select(*K, "i", aero.mach_to_tas_kt("Mach", h).alias("mach_tas"), aero.cas_to_tas_kt("CAS", h).alias("cas_tas"), aero.tas_to_cas_kt("TAS", h).alias("tas_cas"))


@query("f11_f12_f13_targets", f"select {ID}, i, round(target, 4) as target, round(intent, 4) as intent, round(case when intent > 0 and vz_sel is not null then asin(least(greatest(vz_sel * 0.00508 / (intent * 0.514444), -1.0), 1.0)) end, 6) as gamma from (select *, coalesce({mach_tas('Mach', H)}, {cas_tas('CAS', H)}) as target, least({mach_tas('Mach', H)}, {cas_tas('CAS', H)}) as intent from track where altitude is not null) x")
def _(t):
    d = t.track.filter("altitude is not null").select(*K, "i", "vz_sel", aero.tas_target_kt("Mach", "CAS", "altitude").alias("target"), aero.tas_intent_kt("Mach", "CAS", "altitude").alias("intent"))
    return d.select(*K, "i", F.round("target", 4).alias("target"), F.round("intent", 4).alias("intent"), aero.gamma_rad("vz_sel", "intent").alias("gamma"))


HIGH = "case when altitude is null then false when altitude >= 22000 then true when altitude <= 15000 then false else phase in ('LEVEL', 'DESCENT') end"


@query("f14_f15_regime", f"select {ID}, i, high, round(case when high then coalesce({mach_tas('Mach', H)}, {cas_tas('CAS', H)}) else coalesce({cas_tas('CAS', H)}, {mach_tas('Mach', H)}) end, 4) as tas from (select *, {HIGH} as high from track) x", 4)
def _(t):
    d = t.track.withColumn("high", aero.high_regime("altitude", "phase", 22000.0, 15000.0))
    return d.select(*K, "i", "high", aero.tas_by_regime_kt("Mach", "CAS", "altitude", F.col("high")).alias("tas"))


@query("f16_crossovers", f"select {ID}, round(coalesce(any_value(a1), 28000), 6) as up_ft, round(coalesce(any_value(a3), any_value(a2), any_value(a1), 28000), 6) as down_ft from (select {ID}, first_value(altitude) over (partition by {ID} order by mach_sel is null, i) as a1, first_value(altitude) over (partition by {ID} order by mach_sel is null, i desc) as a2, first_value(case when cas_sel is not null and i > lm then altitude end) over (partition by {ID} order by not (cas_sel is not null and i > lm), i) as a3 from (select *, max(case when mach_sel is not null then i end) over (partition by {ID}) as lm from track) x) y group by {ID}")
def _(t):
    return replay.crossovers(t.track)


@query("f17_f18_f19_bins", f"select {ID}, i, round(round_even(altitude / 500, 0) * 500, 6) as h_bin, round(round_even(Mach / 0.01, 0) * 0.01, 6) as mach_bin, (select count(*) from (select unnest(range(1, 20)) as e) b where x.u > b.e * 0.05) as phi_bin, cast(floor(least(greatest(u, 0), 0.999) * 10) as bigint) as u_bin from (select *, i / n as u from track) x")
def _(t):
    u = (F.col("i") / F.col("n")).alias("u")
    return t.track.select("*", u).select(*K, "i", bins.to_step("altitude", 500.0).alias("h_bin"), bins.to_step("Mach", 0.01).alias("mach_bin"), bins.phi_bin("u").alias("phi_bin"), bins.plateau_bin("u").alias("u_bin"))


@query("f20_f21_bands", "select route, flight_id, family, case when gc_nm < 890 then 0 when gc_nm < 910 then 1 else 2 end as gc_bin, case when gc_nm < 890 then '0–890 nm' when gc_nm < 910 then '890–910 nm' else '910–20000 nm' end as label from meta")
def _(t):
    e = [0.0, 890.0, 910.0, 20000.0]
    return meta_of(t).select(*K, "family", bins.distance_bin("gc_nm", e).alias("gc_bin"), bins.distance_label("gc_nm", e).alias("label"))


@query("f24_gamma_fallback", f"select {ID}, i, round(case when bool_or(g is not null) over (partition by {ID}) then g else case when CAS > 0 then asin(least(greatest(vertical_rate * 0.00508 / (CAS * 0.514444), -1.0), 1.0)) end end, 6) as gamma from (select *, case when right(flight_id, 1) = '1' and ln = 2 then 0.25 end as g from track) x")
def _(t):
    d = t.track.withColumn("observed_gamma_rad", F.when(F.col("flight_id").endswith("1") & (F.col("ln") == 2), 0.25)).withColumn("observed_tas_kt", F.col("CAS"))
    return d.select(*K, "i", inputs.gamma_or_ratio(d).alias("gamma"))


@query("f25_f26_small_functions", f"select {ID}, i, round(TAS - 12.5, 6) as gs, round(least(greatest(CAS + (lead - CAS) * 20, 130), 340), 6) as cas from (select *, lead(CAS) {W} as lead from track) x where CAS is not null and lead is not null")
def _(t):
    d = t.track.withColumn("next", F.lead("CAS").over(series.series())).filter("CAS is not null and next is not null")
    return d.select(*K, "i", aero.ground_speed_kt("TAS", 12.5).alias("gs"), aero.cas_after_transition("CAS", F.col("CAS") * 20, F.col("next") * 20).alias("cas"))


# --- Composite operators -----------------------------------------------------------------------------------------


@query("c1_trajectory", f"select {ID}, seq, round(near.gs, 4) as gs, round(near.gs * 1.94384, 4) as kt from ({nearest_sql('(select * from sparse where altitude_ft is not null)', '(select *, {gs: groundspeed_kt} as p from sparse)', 'p', 2)}) x", 4)
def _(t):
    pos = t.sparse.filter("altitude_ft is not null").select(*K, "timestamp", "seq", "latitude", "longitude", "altitude_ft")
    raw = t.sparse.select(*K, keys.seconds("timestamp").alias("mintime"), F.col("groundspeed_kt").alias("velocity"), F.lit(0.0).alias("heading"), F.lit(0.0).alias("vertrate"))
    d = trajectory.trajectory(pos, trajectory.velocities(raw), K)
    return d.filter("seq is not null").select(*K, "seq", F.col("groundspeed_mps").alias("gs"), F.col("groundspeed_kt").alias("kt"))


@query("c2_merge_sources", f"select {ID}, epoch_us(timestamp) as timestamp, round(altitude, 6) as altitude_ft, cast(null as double) as IAS, cast(null as double) as TAS from track union all select {ID}, epoch_us(timestamp), null, round(IAS, 6), round(TAS, 6) from sparse")
def _(t):
    d = trajectory.merge_sources(t.track.select(*K, "timestamp", F.col("altitude").alias("altitude_ft")), t.sparse.select(*K, "timestamp", "IAS", "TAS"))
    return d.select(*K, "timestamp", "altitude_ft", "IAS", "TAS")


GRID = f"(select {ID}, unnest(generate_series(date_trunc('second', min(timestamp)), date_trunc('second', max(timestamp)) + interval '1' second, interval '1' second)) as timestamp from sparse group by {ID})"
R0 = f"select a.*, b.near as ias, c.near as tas from ({nearest_sql(GRID, 'sparse', 'altitude_ft', 2)}) a join ({nearest_sql(GRID, 'sparse', 'IAS', 5)}) b using (route, flight_id, timestamp) join ({nearest_sql(GRID, 'sparse', 'TAS', 5)}) c using (route, flight_id, timestamp)"
R1 = f"select *, near as altitude, last_value(ias ignore nulls) {frame('60 preceding and current row')} as CAS from ({R0}) r0"
R2 = f"select *, last_value(coalesce(tas, {cas_tas('CAS', H)}) ignore nulls) {frame('60 preceding and current row')} as t from ({R1}) r1"
R3 = f"select *, row_number() {W} as rn from ({R2}) r2 where altitude is not null"


def filled_sql(v: str) -> str:
    p, f = frame("unbounded preceding and current row"), frame("current row and unbounded following")
    return f"coalesce({v}, last_value({v} ignore nulls) {p} + (first_value({v} ignore nulls) {f} - last_value({v} ignore nulls) {p}) * (rn - last_value(case when {v} is not null then rn end ignore nulls) {p}) / (first_value(case when {v} is not null then rn end ignore nulls) {f} - last_value(case when {v} is not null then rn end ignore nulls) {p}), last_value({v} ignore nulls) {p}, first_value({v} ignore nulls) {f})"


@query("c3_resample", f"select {ID}, epoch_us(timestamp) as timestamp, round(epoch(timestamp) - min(epoch(timestamp)) over (partition by {ID}), 4) as time, round(altitude, 4) as altitude, round({filled_sql('CAS')}, 4) as CAS, round({filled_sql('t')}, 4) as observed_tas_kt, 0.0e0 as Mach from ({R3}) r3", 4)
def _(t):
    sparse = t.sparse
    return trajectory.resample(sparse, rows=2 * t.rows).select(*K, "timestamp", "time", "altitude", "CAS", "observed_tas_kt", "Mach")


def level_sql(track: str) -> str:
    """(route, flight_id, a, b, var_mean): the stretches of level flight, by i."""
    good = f"select *, coalesce(i > 0 and abs(m) <= 250 and altitude is not null, false) as good from (select *, avg(vertical_rate) {frame('7 preceding and 7 following')} as m from {track}) a"
    run = f"select *, i - row_number() over (partition by {ID}, good order by timestamp) as island from ({good}) b"
    return f"select {ID}, min(i) as a, max(i) as b, avg(altitude) as var_mean from ({run}) c where good group by {ID}, island having count(*) >= 5"


def same(a: str, b: str) -> str:
    return f"{a}.route = {b}.route and {a}.flight_id = {b}.flight_id"


@query("c6_selected_altitude", f"""
select t.route, t.flight_id, t.i, round(last_value(round_even(s.var_mean / 100, 0) * 100 ignore nulls) over (partition by t.route, t.flight_id order by t.timestamp), 6) as h_sel
from track t left join ({level_sql('track')}) s on {same('s', 't')} and t.i between s.a and s.b
""")  # fmt: skip
def _(t):
    return commands.with_selected_altitude(t.track.drop("h_sel"), commands.Extraction(level_len=5), rows=t.rows).select(*K, "i", "h_sel")


RATE_SQL = stable_sql("vertical_rate", 400.0, 15, 51, None, f"select t.*, w.m as s from track t join ({W8}) w on {same('w', 't')} and w.i = t.i")


@query("c6_rate_segments", f"select {ID}, start_row, end_row, {rounded('var_mean')} from ({RATE_SQL}) x")
def _(t):
    return commands.rate_segments(t.track, commands.Extraction(rate_tol=400.0)).select(*K, "start_row", "end_row", "var_mean")


def painted_sql() -> str:
    on = lambda x: f"{same(x, 't')} and t.i + 1 between {x}.start_row and {x}.end_row"
    return f"""
select t.route, t.flight_id, t.i, t.timestamp, t.altitude, m.var_mean as mach, c.var_mean as cas, v.var_mean as vz, round_even(h.var_mean / 100, 0) * 100 as here,
  median(t.vertical_rate) over (partition by t.route, t.flight_id order by t.timestamp rows between 7 preceding and 7 following) as rate
from {LEVELLED.replace('levelled', 't')} left join ({MACH_SQL}) m on {on('m')} left join ({FREE_CAS}) c on {on('c')} left join ({RATE_SQL}) v on {on('v')}
  left join ({level_sql(LEVELLED)}) h on {same('h', 't')} and t.i between h.a and h.b
"""


def c8_sql(digits: int = 4) -> str:
    return f"""
with painted as materialized ({painted_sql()}),
whole as (select *, least({mach_tas('mach', H)}, {cas_tas('cas', H)}) as tas from painted)
select a.route, a.flight_id, a.i, {rounded('a.mach', 'a.cas', 'a.vz', 'a.tas', 'f.filled', digits=digits)},
  round(last_value(here ignore nulls) over (partition by a.route, a.flight_id order by a.timestamp), {digits}) as h,
  round(case when tas > 0 and vz is not null then asin(least(greatest(vz * 0.00508 / (tas * 0.514444), -1.0), 1.0)) end, 4) as gamma,
  case when altitude <= 100 then 'GROUND' when rate >= 200 then 'CLIMB' when rate <= -200 then 'DESCENT' else 'LEVEL' end as phase
from whole a join ({bridged_sql('select route, flight_id, i, timestamp, vz as v from painted')}) f on {same('f', 'a')} and f.i = a.i
"""


@query("c8_extract_commands", f"select * from ({c8_sql()}) x", 4)
def _(t):
    grid = levelled(t, t.undealt().select(*K, "timestamp", "i", "time", "altitude", "vertical_rate", "Mach", "CAS"))
    d = commands.extract_commands(grid, replace(small_extraction(), rate_tol=400.0, level_len=5))
    return d.select(
        *K, "i", F.col("mach_sel").alias("mach"), F.col("cas_sel").alias("cas"), F.col("vz_sel").alias("vz"), F.col("tas_intent_kt").alias("tas"), F.col("vz_sel_replay").alias("filled"),
        F.col("h_sel").alias("h"), F.col("gamma_intent_rad").alias("gamma"), "phase",
    )


@query("c9_command_events", f"select {ID}, command, epoch_us(t0) as start_timestamp, epoch_us(t1) as end_timestamp, {rounded('duration_s', 'value')} from cmd")
def _(t):
    return islands.command_events(t.track)


@query("c11_top_of_descent", f"select {ID}, epoch_us(timestamp) as timestamp, round(hh, 6) as h_sel_ft, round(hp, 6) as h_sel_prev_ft, round(hp - hh, 6) as step_ft, case when hh <= 22000 then 'preferred_below_threshold' else 'first_drop' end as tod_rule, 22000.0e0 as tod_threshold_ft, round(altitude, 6) as altitude_ft, time as time_s from tod")
def _(t):
    return descent.top_of_descent(t.track)


@query("c12_enrich", f"select f.route, f.flight_id, a.typecode, cast(nullif(sum(case when t.phase = 'LEVEL' then 1 else 0 end), 0) as double) as phase_level_s, any_value(round(d.hh, 6)) as h_sel_ft from flights f left join aircraft a using (icao24) left join track t on t.route = f.route and t.flight_id = f.flight_id left join tod d on d.route = f.route and d.flight_id = f.flight_id group by f.route, f.flight_id, a.typecode")
def _(t):
    meta, events = descent.enrich(t.track, t.track, t.flights, t.aircraft, ends_of(t))
    return meta.join(events.select(*K, "h_sel_ft"), K, "left").select(*K, "typecode", "phase_level_s", "h_sel_ft")


QC = f"""select {ID}, (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) / 3.6e9 as span, max(time) as t_max, count(*) as rows, avg(case when air then cast(coalesce(jump > 3000, false) as int) end) as j3, avg(case when air then cast(coalesce(jump > 5000, false) as int) end) as j5,
  coalesce(max(case when air then jump end), max(jump)) as jmax, max(altitude) as alt_max, cast(count(*) filter (where phase = 'CLIMB') as double) as climb, avg(case when altitude > 3000 then cast(abs(vertical_rate) > 200 as int) end) as active, max(h) as h_max, median(h) as h_med, max(h) / max(altitude) as ratio
  from (select *, abs(altitude - prev) as jump, coalesce(altitude > 3000 or prev > 3000, false) and altitude is not null and prev is not null as air from (select *, lag(altitude) {W} as prev, coalesce(last_value(h_sel ignore nulls) {frame('unbounded preceding and current row')}, first_value(h_sel ignore nulls) {frame('current row and unbounded following')}) as h from track) a) b group by {ID}"""
#: Two kinds of flights are spoilt, so that several reasons occur.
SPOILT = "select * replace (case when right(flight_id, 1) = '2' then h_sel * 0.05 when right(flight_id, 1) = '6' then h_sel * 0.4 else h_sel end as h_sel, case when right(flight_id, 1) = '4' then 0 else vertical_rate end as vertical_rate, case when right(flight_id, 1) = '8' and i % 50 = 7 then altitude / 2 else altitude end as altitude, case when right(flight_id, 1) = '9' then time * 2 else time end as time, case when right(flight_id, 1) = '5' then 'LEVEL' else phase end as phase) from track"
QCS = QC.replace("from track)", f"from ({SPOILT}) t)")
REASON = {
    "q1": "case when span > 8 then 'excessive_timeline_duration' when t_max > 28800 or (span > 0 and t_max > span * 3600 * 1.25) then 'time_column_anomaly' end",
    "q2": "case when j3 >= 0.005 or j5 >= 0.003 then 'altitude_teleport_noise' end",
    "q3": "case when alt_max >= 15000 and climb < 60 then 'no_operational_climb' when alt_max >= 15000 and active < 0.03 then 'vertical_rate_lost' end",
    "q4": "case when (h_max is null or h_max < 3000) and alt_max >= 15000 then 'missing_h_sel' when alt_max >= 25000 and (h_max is null or h_max < 8000) then 'broken_h_sel' when alt_max >= 25000 and ratio < 0.7 and h_max < 22000 then 'h_sel_alt_mismatch' end",
}


def spoilt(t: Tables) -> DataFrame:
    last = F.right("flight_id", F.lit(1))
    return t.track.withColumns({
        "h_sel": F.when(last == "2", F.col("h_sel") * 0.05).when(last == "6", F.col("h_sel") * 0.4).otherwise(F.col("h_sel")), "vertical_rate": F.when(last == "4", 0.0).otherwise(F.col("vertical_rate")),
        "altitude": F.when((last == "8") & (F.col("i") % 50 == 7), F.col("altitude") / 2).otherwise(F.col("altitude")), "time": F.when(last == "9", F.col("time") * 2).otherwise(F.col("time")), "phase": F.when(last == "5", "LEVEL").otherwise(F.col("phase")),
    })


@query("q1_timeline", f"select {ID}, round(span, 6) as timestamp_span_h, t_max as time_column_max_s, {REASON['q1']} as reason from ({QCS}) q")
def _(t):
    return quality.metrics(spoilt(t)).select(*K, "timestamp_span_h", "time_column_max_s", quality.timeline_reason().alias("reason"))


@query("q2_altitude_jumps", f"select {ID}, {rounded('j3', 'j5', 'jmax')}, {REASON['q2']} as reason from ({QCS}) q")
def _(t):
    return quality.metrics(spoilt(t)).select(*K, F.col("airborne_jump3000_frac").alias("j3"), F.col("airborne_jump5000_frac").alias("j5"), F.col("airborne_alt_jump_max_ft").alias("jmax"), quality.jump_reason().alias("reason"))


@query("q3_vertical_rate", f"select {ID}, {rounded('alt_max', 'climb', 'active')}, {REASON['q3']} as reason from ({QCS}) q")
def _(t):
    return quality.metrics(spoilt(t)).select(*K, F.col("alt_max_ft").alias("alt_max"), F.col("phase_climb_s").alias("climb"), F.col("airborne_vz_active_fraction").alias("active"), quality.rate_reason().alias("reason"))


@query("q4_selected_altitude", f"select {ID}, {rounded('h_max', 'h_med', 'ratio')}, {REASON['q4']} as reason from ({QCS}) q")
def _(t):
    return quality.metrics(spoilt(t)).select(*K, F.col("h_sel_max_ft").alias("h_max"), F.col("h_sel_median_ft").alias("h_med"), F.col("h_sel_alt_ratio").alias("ratio"), quality.selected_reason().alias("reason"))


Q5 = f"select {ID}, coalesce({REASON['q1']}, {REASON['q2']}, {REASON['q3']}, {REASON['q4']}, 'ok') as qc_reason, round(case when coalesce({REASON['q1']}, {REASON['q2']}, {REASON['q3']}) is null then h_max end, 6) as h_sel_max_ft, round(case when {REASON['q1']} is null then j3 end, 6) as airborne_jump3000_frac from ({QCS}) q"


@query("q5_a15_quality", f"select *, qc_reason = 'ok' as accepted from ({Q5}) x")
def _(t):
    return quality.assess(spoilt(t)).select(*K, "accepted", "qc_reason", "h_sel_max_ft", "airborne_jump3000_frac")


#: Raw samples of both sources: some flights have none of the second, and some are spoilt.
RAW = f"""adsb as materialized (select {ID}, timestamp + interval '500 milliseconds' as timestamp, case when right(flight_id, 1) = '8' and i % 50 < 3 then altitude / 2 else altitude end as altitude_ft,
    case when right(flight_id, 1) = '4' then 0.0 else vertical_rate end as vertical_rate_fpm from track where rf <> 'N'),
  modes as materialized (select {ID}, timestamp + interval '250 milliseconds' as timestamp, CAS as IAS, Mach, selected_mcp from track where rf = 'N' and right(flight_id, 1) <> '7')"""


def on_grid(sql: str) -> str:
    """A twin over the track, over the grid instead."""
    return re.sub(r"\btrack\b", "gridded", sql)


def processed_sql() -> str:
    hold = lambda v, n: f"last_value({v} ignore nulls) {frame(f'{n} preceding and current row')}"
    mach = mach_tas("Mach", H)
    near = " ".join(f"join ({nearest_sql('points', side, value, tol)}) {name} using (route, flight_id, timestamp)" for name, side, value, tol in (("v", "adsb", "vertical_rate_fpm", 2), ("c", "modes", "IAS", 5), ("m", "modes", "Mach", 5), ("s", "modes", "selected_mcp", 10)))
    return f"""
with {RAW},
picked as materialized (select f.* from flights f where status = 'done' and (route, flight_id) in (select {ID} from adsb) and (route, flight_id) in (select {ID} from modes)),
times as (select {ID}, timestamp from adsb union all select {ID}, timestamp from modes),
points as materialized (select {ID}, unnest(generate_series(date_trunc('second', min(timestamp)), date_trunc('second', max(timestamp)) + interval '1' second, interval '1' second)) as timestamp from times join picked using (route, flight_id) group by {ID}),
g0 as materialized (select a.route, a.flight_id, a.timestamp, a.near as altitude, v.near as rate, c.near as ias, m.near as near_mach, round_even(s.near / 25.0, 0) * 25.0 as near_mcp from ({nearest_sql('points', 'adsb', 'altitude_ft', 2)}) a {near}),
g1 as (select *, {hold('near_mach', 60)} as Mach, {hold('near_mcp', 600)} as selected_mcp from g0),
g2 as (select *, {hold(f"coalesce(ias, {tas_cas(mach, H)})", 60)} as CAS from g1),
g3 as (select *, row_number() {W} as rn from g2 where altitude is not null),
gridded as materialized (select {ID}, timestamp, rn - 1 as i, epoch(timestamp) - min(epoch(timestamp)) over (partition by {ID}) as time, altitude, coalesce({filled_sql('rate')}, 0.0) as vertical_rate, coalesce({filled_sql('Mach')}, 0.0) as Mach, {filled_sql('CAS')} as CAS, selected_mcp from g3),
chain as materialized (select x.*, g.timestamp, g.time, g.altitude, g.vertical_rate, g.selected_mcp from ({on_grid(c8_sql(9))}) x join gridded g using (route, flight_id, i)),
named as materialized (select *, mach as mach_sel, cas as cas_sel, vz as vz_sel, h as h_sel from chain),
checks as ({QC.replace("from track)", "from named)")}),
judged as (select {ID}, coalesce({REASON['q1']}, {REASON['q2']}, {REASON['q3']}, {REASON['q4']}, 'ok') as qc_reason from checks),
found as materialized (select {ID}, coalesce(qc_reason, 'no_altitude') as qc_reason from picked left join judged using (route, flight_id)),
happened as ({re.sub(r"\btrack\b", "named", CHECKED["cmd"])})
select q.route, q.flight_id, q.qc_reason, e.command, coalesce(epoch_us(e.t0), 0) as start_timestamp, round(e.duration_s, 4) as duration_s, round(e.value, 3) as value from found q left join happened e on {same('e', 'q')} and q.qc_reason = 'ok'
"""


@query("c13_process_routes", f"select * from ({processed_sql()}) x", 3)
def _(t):
    last, track = F.right("flight_id", F.lit(1)), t.written("i", "rf", "altitude", "vertical_rate", "CAS", "Mach", "selected_mcp")
    later = lambda ms: (F.col("timestamp") + F.make_dt_interval(secs=F.lit(ms / 1000))).alias("timestamp")
    adsb = track.filter("rf <> 'N'").select(
        *K, later(500), F.when((last == "8") & (F.col("i") % 50 < 3), F.col("altitude") / 2).otherwise(F.col("altitude")).alias("altitude_ft"), F.when(last == "4", 0.0).otherwise(F.col("vertical_rate")).alias("vertical_rate_fpm")
    )
    modes = track.filter((F.col("rf") == "N") & (last != "7")).select(*K, later(250), F.col("CAS").alias("IAS"), "Mach", "selected_mcp")
    p = processing.process_routes(adsb, modes, t.flights, replace(small_extraction(), rate_tol=400.0, level_len=5))
    return p.quality.select(*K, "qc_reason").join(p.events, K, "left").select(*K, "qc_reason", "command", F.coalesce(F.unix_micros("start_timestamp"), F.lit(0)).alias("start_timestamp"), F.round("duration_s", 4).alias("duration_s"), "value")


HOLDS = f"select *, " + ", ".join(f"coalesce({n}, first_value({n} ignore nulls) {frame('current row and unbounded following')}) as {n[1:]}" for n in ("_mh", "_ch")) + f" from (select *, last_value(mach_sel ignore nulls) over (partition by {ID}, phase order by timestamp) as _mh, last_value(cas_sel ignore nulls) over (partition by {ID}, phase order by timestamp) as _ch from track) x"  # noqa: F541
P0 = f"select *, first_value(altitude) {frame('unbounded preceding and current row')} + sum(least(greatest(coalesce(vz_sel, 0), -4000), 4000)) {frame('unbounded preceding and current row')} / 60.0 as h from (select *, min(case when phase = 'CLIMB' then i end) over (partition by {ID}) as i0 from ({HOLDS}) y) z where i >= coalesce(i0, 0)"
P1 = f"select *, case when h >= 28000 then true else false end as high from ({P0}) p0"
HM = "(h * 0.3048)"
P2 = f"select *, case when high then coalesce({mach_tas('mh', HM)}, {cas_tas('ch', HM)}) else coalesce({cas_tas('ch', HM)}, {mach_tas('mh', HM)}) end as tgt from ({P1}) p1"
PLAYED = f"select *, coalesce(last_value(tgt ignore nulls) {frame('unbounded preceding and current row')}, 250) as gen_tas, least(greatest(coalesce(vz_sel, 0), -4000), 4000) as rocd from ({P2}) p2"


@query("c14_replay", f"select {ID}, i, round(h, 4) as gen_altitude_ft, rocd as gen_rocd_fpm, round(gen_tas, 4) as gen_tas_kt, high as regime_high_alt, i0 as replay_start_idx from ({PLAYED}) x", 4)
def _(t):
    d = replay.replay(t.track)
    i = (keys.seconds("timestamp") - 1704067200).cast("long").alias("i")
    return d.select(*K, i, "gen_altitude_ft", "gen_rocd_fpm", "gen_tas_kt", "regime_high_alt", "replay_start_idx")


@query("c15_replay_metrics", f"select {ID}, round(sqrt(avg(e * e)), 3) as rmse_ft, round(avg(abs(e)), 3) as mae_ft, round(avg(e), 3) as bias_ft, count(e) as n, round(avg(abs(case when near.v > 30 and gen_tas > 30 then gen_tas - near.v end)), 3) as mae_tas_kt, count(case when near.v > 30 and gen_tas > 30 then 1 end) as n_tas from (select *, h - altitude as e from ({nearest_sql(f'({PLAYED})', '(select *, {v: TAS} as p from sparse)', 'p', 2)}) z) w group by {ID}", 3)
def _(t):
    d = replay.replay_metrics(replay.replay(t.track), t.sparse, t.sparse, rows=2 * t.rows)
    return d.select(*K, "rmse_ft", "mae_ft", "bias_ft", "n", "mae_tas_kt", "n_tas")


SEG = "select route, flight_id, t0, value, greatest(round_even(case when duration_s > 0 then duration_s else 60 end, 0), 1) as k from cmd where command = 'h_sel'"
EXPANDED = f"select {ID}, unnest(range(cast(a as bigint), cast(a + k as bigint))) as \"at\", value from (select *, coalesce(sum(k) over (partition by {ID} order by t0 rows between unbounded preceding and 1 preceding), 0) as a from ({SEG}) s) u"


@query("c16_expand_segments", f"select {ID}, x.at, round(value, 6) as value from ({EXPANDED}) x")
def _(t):
    return assembly.expand_segments(islands.command_events(t.track).filter("command = 'h_sel'"), "start_timestamp")


@query("c17_fit_length", f"select w.route, w.flight_id, w.at, round(case when w.at = 0 then 111.0e0 else last_value(x.value ignore nulls) over (partition by w.route, w.flight_id order by w.at) end, 6) as value from (select {ID}, unnest(range(0, n + 40)) as at from (select distinct {ID}, n from track) d) w left join ({EXPANDED}) x on x.route = w.route and x.flight_id = w.flight_id and x.at = w.at")
def _(t):
    grid = assembly.expand_segments(islands.command_events(t.track).filter("command = 'h_sel'"), "start_timestamp")
    n = t.track.select(*K, (F.col("n") + 40).alias("n"), F.lit(111.0).alias("first")).distinct()
    return assembly.fit_length(grid, n, "first").select(*K, "at", "value")


EST = f"select *, 0.0 + sum(coalesce(vz_sel, 0)) {frame('unbounded preceding and current row')} / 60.0 as h_est, max(h_sel) over (partition by {ID}) as top from track"


@query("c18_top_of_climb", f"select {ID}, min(case when h_est >= top / 2 - 25 then i + 1 end) as toc_row, any_value(top / 2) as h_cruise from ({EST}) x group by {ID}", 6)
def _(t):
    return assembly.top_of_climb(t.track.withColumn("h_sel", F.col("h_sel") / 2))


GS = f"select *, {cas_tas('cas_sel', '(h_est * 0.3048)')} as c, {mach_tas('mach_sel', '(h_est * 0.3048)')} as m from ({EST}) e0"
GS = f"select *, coalesce(case when phase = 'CLIMB' then c when phase = 'LEVEL' then coalesce(m, c) else coalesce(c, m) end, m, c) - 10.0 as gs from ({GS}) e1"


@query("c20_ground_speed", f"select {ID}, i, round(h_est, 4) as h_est, round(gs, 4) as gs_kt from ({GS}) x", 4)
def _(t):
    return assembly.with_ground_speed(t.track, 0.0, 10.0).select(*K, "i", "h_est", "gs_kt")


FLOWN = f"select *, sum(gs / 3600.0) over (partition by {ID} order by timestamp) / 60.0 as flown from ({GS}) e2"


@query("c19_row_at_share", f"select {ID}, coalesce(min(case when flown >= 0.5 then i end), count(*)) as at from ({FLOWN}) x group by {ID}")
def _(t):
    return assembly.rows_at_share(assembly.with_ground_speed(t.track, 0.0, 10.0), 0.5, F.lit(60.0))


@query("c21_scale_plateaus", f"select {ID}, epoch_us(t0) as start_timestamp, round(case when abs(s) < 1 then value else value * -9000.0 / s end, 4) as value from (select *, sum(value * duration_s / 60.0) over (partition by {ID}) as s from cmd where command = 'vz_sel') x", 4)
def _(t):
    return assembly.scale_plateaus(islands.command_events(t.track).filter("command = 'vz_sel'"), F.lit(-9000.0)).select(*K, "start_timestamp", "value")


@query("c22_close_descent", f"select {ID}, i, round(30000 + sum(case when i >= hit then 0 else coalesce(vz_sel, 0) end) {frame('unbounded preceding and current row')} / 60.0, 4) as h_closed from (select *, coalesce(min(case when h <= 29000 + 25 then i end) over (partition by {ID}), 1e9) as hit from (select *, 30000 + sum(coalesce(vz_sel, 0)) {frame('unbounded preceding and current row')} / 60.0 as h from (select * replace (-abs(vz_sel) as vz_sel) from track) a) b) c", 4)
def _(t):
    return assembly.close_descent(t.track.withColumn("vz_sel", -F.abs("vz_sel")), 30000.0, 29000.0).select(*K, "i", "h_closed")


PLACE = GS.replace(" - 10.0 as gs", " as gs").replace("when phase = 'LEVEL' then coalesce(m, c)", f"when phase = 'LEVEL' then {mach_tas('0.76', '(h_est * 0.3048)')}").replace("else coalesce(c, m) end", f"else coalesce(c, m, {mach_tas('0.76', '(h_est * 0.3048)')}) end")
PLACED = f"select *, least(coalesce(min(case when flown >= 0.3 then i end) over (partition by {ID}), n), n - 1) as a, coalesce(min(case when flown >= 0.6 then i end) over (partition by {ID}), n) as b0 from (select *, sum(gs / 3600.0) over (partition by {ID} order by timestamp) / 60.0 as flown from ({PLACE}) e3) e4"


@query("c23_place_mach", f"select {ID}, count(case when i >= a and i < b then 1 end) as rows, round(max(case when i = a then h_est end), 4) as up_ft, round(max(case when i = b then h_est end), 4) as down_ft from (select *, least(greatest(b0, a + 1), n - 1) as b from ({PLACED}) e5) e6 group by {ID}", 4)
def _(t):
    d = assembly.place_mach(t.track, 0.3, 0.6, 0.76, F.lit(60.0))
    return d.groupBy(*K).agg(F.count("mach_placed").alias("rows"), F.max("up_ft").alias("up_ft"), F.max("down_ft").alias("down_ft"))


@query("c24_climb_end", f"select {ID}, round(max(h_sel), 6) as h_pre_max, round(arg_max(cas_sel, timestamp) filter (where cas_sel is not null), 6) as cas_pre_last from track where phase = 'CLIMB' group by {ID}")
def _(t):
    return assembly.climb_end(t.track.filter("phase = 'CLIMB'"))


CRUISE = f"select {ID}, sum(gs / 3600.0) as nm, arg_max(h_est, timestamp) as h_cruise, arg_max(cas_sel, timestamp) filter (where cas_sel is not null) as cas_cruise from ({GS.replace(' - 10.0 as gs', ' as gs').replace('from track', 'from (select * from track where phase = ' + chr(39) + 'CLIMB' + chr(39) + ') tc', 1)}) x group by {ID}"


@query("c25_cruise_seconds", f"select {ID}, cast(case when 0.7 * 60 - nm <= 0 then 0 else ceil((0.7 * 60 - nm) / {cas_tas('cas_cruise', '(h_cruise * 0.3048)')} * 3600) end as bigint) as need_s, round(h_cruise, 4) as h_cruise from ({CRUISE}) c", 4)
def _(t):
    return assembly.cruise_seconds(t.track.filter("phase = 'CLIMB'"), 0.7, F.lit(60.0)).select(*K, "need_s", "h_cruise")


@query("c25_level_segment", f"select s.route, s.flight_id, count(*) as rows, epoch_us(min(ts)) as first, epoch_us(max(ts)) as last from (select {ID}, max(timestamp) as t from track group by {ID}) s, lateral (select unnest(generate_series(s.t + interval '1' second, s.t + interval '30' second, interval '1' second)) as ts) g group by 1, 2")
def _(t):
    needs = t.track.select(*K, F.lit(30).cast("long").alias("need_s"), F.lit(30000.0).alias("h_cruise"), F.lit(250.0).alias("cas_cruise")).distinct()
    d = assembly.level_segment(t.track, needs)
    return d.groupBy(*K).agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


# --- Conditional distributions -------------------------------------------------------------------------------------------

VZ, HS, CA = "round_even(value / 100, 0) * 100", "round_even(value / 500, 0) * 500", "round_even(value / 5, 0) * 5"


def phi_sql(where: str, bin_: str) -> str:
    return f"select e.*, {bin_} as bin, least(greatest((epoch(e.t0) - epoch(s.s0)) / s.span, 0), 1) as phi_mid, e.duration_s / s.span as dphi from ev e join slab s on s.route = e.route and s.flight_id = e.flight_id and s.phase = e.phase where s.rows >= 2 and s.span > 30 and {where}"


PHI_BIN_SQL = "(select count(*) from (select unnest(range(1, 20)) as k) b where x.phi_mid > b.k * 0.05)"


@query("l1_events_with_phi", f"select {ID}, phase, epoch_us(t0) as start_timestamp, round(bin, 6) as vz_bin, {rounded('phi_mid', 'dphi')}, {PHI_BIN_SQL} as phi_bin from ({phi_sql(chr(101) + '.command = ' + chr(39) + 'vz_sel' + chr(39), VZ)}) x")
def _(t):
    d = laws.with_phi(laws.binned(events_of(t), "vz_sel", "vz_bin", 100.0), laws.phase_windows(t.track))
    return d.select(*K, "phase", "start_timestamp", "vz_bin", "phi_mid", "dphi", "phi_bin")


L2_LEFT = "(select * replace (flight_id || phase as flight_id) from (" + phi_sql("e.command = 'vz_sel'", VZ) + ") v0)"
L2_RIGHT = f"(select * replace (flight_id || phase as flight_id), {HS} as hb from ev where command = 'h_sel')"


@query("l2_rate_height_joint", f"select route, flight_id, epoch_us(t0) as start_timestamp, round(bin, 6) as vz_bin, round(near, 6) as h_bin, round(dphi, 6) as dphi from ({nearest_sql(L2_LEFT, L2_RIGHT, 'hb', 60, lts='t0', rts='t0')}) x where near is not null and dphi > 0")
def _(t):
    track = t.written(*COMMAND_COLUMNS, "phase")
    # The events are read for the rates and for the heights.
    d = laws.rate_height_joint(tables.settle(events_of(t, track)), laws.phase_windows(track))
    return d.select("route", F.concat("flight_id", "phase").alias("flight_id"), "start_timestamp", "vz_bin", "h_bin", "dphi")


@query("l3_height_phi", f"select {ID}, phase, epoch_us(t0) as start_timestamp, round(bin, 6) as h_bin, {rounded('phi_mid', 'dphi')} from ({phi_sql(chr(101) + '.command = ' + chr(39) + 'h_sel' + chr(39), HS)}) x where dphi > 0")
def _(t):
    return laws.height_phi(events_of(t), laws.phase_windows(t.track)).select(*K, "phase", "start_timestamp", "h_bin", "phi_mid", "dphi")


@query("l4_event_library", f"select c.route, c.flight_id, round(round_even(h.value / 500, 0) * 500, 6) as h_bin, cast(floor(least(u, 0.999) * 10) as bigint) as u_bin, round(u, 6) as u, round(round_even(c.value / 100, 0) * 100, 6) as vz_bin, round(c.duration_s, 6) as duration_s from ev c join (select *, coalesce(lead(t0) over (partition by {ID} order by t0), t0 + greatest(duration_s, 60.0) * interval '1' second) as stop from ev where command = 'h_sel' and phase = 'DESCENT') h on h.route = c.route and h.flight_id = c.flight_id and c.t0 >= h.t0 and c.t0 < h.stop, lateral (select least(greatest((epoch(c.t0) - epoch(h.t0)) / greatest(epoch(h.stop) - epoch(h.t0), 1.0), 0.0), 1.0) as u) z where c.command = 'vz_sel' and c.phase = 'DESCENT' and c.duration_s >= 3")
def _(t):
    return laws.event_library(events_of(t)).select(*K, "h_bin", "u_bin", "u", "vz_bin", "duration_s")


L5_SLAB = f"select *, last_value(h_sel ignore nulls) {W} as hh, count(*) over (partition by {ID}) as m, min(timestamp) over (partition by {ID}) as s0, max(timestamp) over (partition by {ID}) as s1, row_number() over (partition by {ID} order by timestamp desc) as back from track where phase = 'DESCENT'"


@query("l5_transitions", f"select {ID}, round(round_even(prev / 5, 0) * 5, 6) as cas_prev_bin, round(round_even(value / 5, 0) * 5, 6) as cas_new_bin, round(round_even(hh / 500, 0) * 500, 6) as h_bin, round((epoch(t0) - epoch(s0)) / greatest(epoch(s1) - epoch(s0), 1.0), 6) as phi, round(least(dwell, 900), 6) as dwell_s, cast(coalesce((epoch(t0) - epoch(s0)) / greatest(epoch(s1) - epoch(s0), 1.0) > 0.85 or hh < 3000, false) as bigint) as near_end from (select e.*, s.hh, s.s0, s.s1, lag(e.value) over w as prev, epoch(e.t0) - epoch(lag(e.t0) over w) as dwell from ev e join ({L5_SLAB}) s on s.route = e.route and s.flight_id = e.flight_id and s.timestamp = e.t0 where e.command = 'cas_sel' and e.phase = 'DESCENT' and s.m >= 50 window w as (partition by e.route, e.flight_id order by e.t0)) x where prev is not null and dwell >= 3")
def _(t):
    track = t.written(*COMMAND_COLUMNS, "phase")
    d = laws.transition_library(events_of(t, track), track, t.flights.select(*K, "firstseen"))
    return d.select(*K, "cas_prev_bin", "cas_new_bin", "h_bin", "phi", "dwell_s", "near_end")


@query("l6_mach_anchors", f"select m.route, m.flight_id, m.n_mach, round(m.mach_last, 6) as mach_last, round(p.h_pre_max, 6) as h_pre_max, round(p.cas_pre_last, 6) as cas_pre_last, round(least(greatest(1 - u.near / z.km, 0), 1), 6) as phi_up from (select {ID}, min(t0) as up, count(*) as n_mach, arg_max(value, t0) as mach_last from cmd where command = 'mach_sel' group by {ID}) m left join (select c.route, c.flight_id, max(value) filter (where command = 'h_sel') as h_pre_max, arg_max(value, t0) filter (where command = 'cas_sel') as cas_pre_last from cmd c join (select {ID}, min(t0) as up from cmd where command = 'mach_sel' group by {ID}) m on m.route = c.route and m.flight_id = c.flight_id where c.t0 < m.up group by 1, 2) p on p.route = m.route and p.flight_id = m.flight_id join ({nearest_sql(f'(select {ID}, min(t0) as timestamp from cmd where command = ' + chr(39) + 'mach_sel' + chr(39) + f' group by {ID})', f'({TO_END})', 'km', None)}) u on u.route = m.route and u.flight_id = m.flight_id join (select {ID}, arg_min(km, timestamp) as km from ({TO_END}) e group by {ID}) z on z.route = m.route and z.flight_id = m.flight_id")
def _(t):
    track = t.written(*COMMAND_COLUMNS, *PLACE_COLUMNS)
    events, tod = tables.settle(islands.command_events(track)), tables.settle(tod_of(t, track))
    d = laws.mach_anchors(events, track, ends_of(t), tod, lengths_of(t), EDGES)
    return d.select(*K, "n_mach", "mach_last", "h_pre_max", "cas_pre_last", "phi_up")


BIN = "case when gc_nm < 890 then 0 when gc_nm < 910 then 1 else 2 end"


@query("l7_level_mach", f"select e.route, e.flight_id, {BIN} as gc_bin, round(round_even(e.value / 0.01, 0) * 0.01, 6) as mach_bin, round(e.duration_s, 6) as duration_s from ev e join lengths l using (route) where command = 'mach_sel' and phase = 'LEVEL'")
def _(t):
    return laws.level_mach(events_of(t), lengths_of(t), EDGES)


@query("l8_descent_phi", f"select {ID}, {BIN} as gc_bin, round(phi, 6) as phi_d from (select x.route, x.flight_id, l.gc_nm, least(greatest(1 - x.near / z.km, 0), 1) as phi from ({nearest_sql('tod', f'({TO_END})', 'km', None)}) x join (select {ID}, arg_min(km, timestamp) as km from ({TO_END}) e group by {ID}) z on z.route = x.route and z.flight_id = x.flight_id join lengths l on l.route = x.route) y")
def _(t):
    track = t.written("h_sel", *PLACE_COLUMNS)
    return laws.descent_phi(descent.progress(tables.settle(tod_of(t, track)), track, rows=t.rows), lengths_of(t), EDGES)


@query("l9_z1_starts_and_counts", f"select {BIN} as gc_bin, m.family, e.phase, e.route, e.flight_id, round(arg_min({VZ}, e.t0), 6) as start_bin, count(*) as segments from ev e join meta m on m.route = e.route and m.flight_id = e.flight_id where e.command = 'vz_sel' and e.phase in ('CLIMB', 'DESCENT') group by all")
def _(t):
    return laws.starts_and_counts(events_of(t), meta_of(t), EDGES, "vz_sel", 100.0)


@query("l9_phase_laws", f"select family, phase, count(*) as rows, round(avg(dphi), 6) as dphi from ({phi_sql(chr(101) + '.command = ' + chr(39) + 'cas_sel' + chr(39), CA)}) x join meta m on m.route = x.route and m.flight_id = x.flight_id where phase in ('CLIMB', 'DESCENT') group by family, phase")
def _(t):
    d = laws.phase_laws(events_of(t), t.track, meta_of(t), EDGES)["cas_phi"]
    return d.groupBy("family", "phase").agg(F.count(F.lit(1)).alias("rows"), F.avg("dphi").alias("dphi"))


@query("l10_distance_edges", "select unnest([0, 1, 2, 3]) as k, round(unnest([greatest(min(gc_nm) - 1, 0), quantile_cont(gc_nm, 1.0 / 3), quantile_cont(gc_nm, 2.0 / 3), max(gc_nm) + 1]), 4) as edge from lengths", 4)
def _(t):
    return laws.distance_edge_table(lengths_of(t)).select(F.posexplode("edges").alias("k", "edge"))


def fit_sql() -> str:
    """The six tables of flights of two type codes, counted and averaged by distance bin, family and phase."""
    command = lambda c: f"e.command = '{c}'"
    by = "gc_bin, family, phase"
    phases = "phase in ('CLIMB', 'DESCENT')"
    law = lambda name, rows, where="true": f"select '{name}' as name, {by}, count(*) as rows, round(avg(x.bin), 4) as value, round(avg(dphi), 6) as dphi from ({rows}) x join place p on p.route = x.route and p.flight_id = x.flight_id where {phases} and {where} group by {by}"
    starts = lambda name, c, b: f"select '{name}' as name, {by}, count(*) as rows, round(avg(start_bin), 4) as value, round(avg(segments), 6) as dphi from (select {by}, e.route, e.flight_id, arg_min({b}, e.t0) as start_bin, count(*) as segments from ev e join place p on p.route = e.route and p.flight_id = e.flight_id where {command(c)} and {phases} group by {by}, e.route, e.flight_id) x group by {by}"
    joint = f"select route, regexp_extract(flight_id, '^F[0-9]+') as flight_id, regexp_replace(flight_id, '^F[0-9]+', '') as phase, bin, dphi from ({nearest_sql(L2_LEFT, L2_RIGHT, 'hb', 60, lts='t0', rts='t0')}) y where near is not null and dphi > 0"
    return f"""
with edges as (select quantile_cont(gc_nm, 1.0 / 3) as a, quantile_cont(gc_nm, 2.0 / 3) as b from lengths),
place as (select route, flight_id, family, case when gc_nm < a then 0 when gc_nm < b then 1 else 2 end as gc_bin from meta, edges where upper(trim(typecode)) in ('A320', 'A20N', 'B738'))
{law('vz_phi', phi_sql(command('vz_sel'), VZ))} union all {law('h_phi', phi_sql(command('h_sel'), HS), 'dphi > 0')} union all {law('cas_phi', phi_sql(command('cas_sel'), CA))}
union all {law('vz_h_joint', joint)} union all {starts('vz_starts', 'vz_sel', VZ)} union all {starts('cas_starts', 'cas_sel', CA)}
"""


@query("l9_l10_fitted_tables", f"select * from ({fit_sql()}) z")
def _(t):
    made = fitted(t, ["A320", "A20N", "B738"]).tables
    value = {"vz_phi": "vz_bin", "h_phi": "h_bin", "cas_phi": "cas_bin", "vz_h_joint": "vz_bin", "vz_starts": "start_bin", "cas_starts": "start_bin"}
    by = ["gc_bin", "family", F.upper("phase").alias("phase")]
    all_of = [d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(value[n]), 4).alias("value"), F.avg("segments" if n.endswith("starts") else "dphi").alias("dphi")).withColumn("name", F.lit(n)) for n, d in made.items()]
    return reduce(DataFrame.unionByName, all_of)


@query("l11_flight_metadata", f"select {ID}, typecode, family, round(gc_nm, 4) as gc_nm from meta", 4)
def _(t):
    return meta_of(t).select(*K, "typecode", "family", "gc_nm")


L12 = """
with a as (select o_orderstatus, o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2, 3 having count(*) >= 3),
b as (select o_orderstatus, o_custkey, count(*) as n from orders group by 1, 2 having count(*) >= 3),
c as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2 having count(*) >= 3)
select r.o_orderkey, case when a.n > 0 then 0 when b.n > 0 then 1 when c.n > 0 then 2 else 3 end as level,
  coalesce(a.n, b.n, c.n, (select count(*) from orders)) as pool
from orders r left join a using (o_orderstatus, o_custkey, o_orderpriority) left join b using (o_orderstatus, o_custkey)
  left join c using (o_orderstatus, o_orderpriority)
"""


@query("l12_back_off", f"select * from ({L12}) x")
def _(t):
    o = t.base("orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    levels = [["o_orderstatus", "o_custkey", "o_orderpriority"], ["o_orderstatus", "o_custkey"], ["o_orderstatus", "o_orderpriority"], []]
    return laws.back_off(o, o, levels, least=3).select("o_orderkey", "level", "pool")


L13 = """
select i.event_id, arg_min(k.key, struct_pack(d := abs(k.key - i.value), k := k.key)) as key
from irregular i left join (select distinct event_type, round_even(value / 7, 0) * 7 as key from irregular) k using (event_type)
where i.value is not null group by i.event_id
"""


@query("l13_nearest_key", f"select * from ({L13}) x")
def _(t):
    lib = t.irregular.select("event_type", bins.to_step("value", 7.0).alias("key"))
    r = t.irregular.filter("value is not null").select("event_id", "event_type", "value")
    return laws.nearest_key(r, lib, "value", "key", ["event_type"]).select("event_id", "key")


@query("l14_narrow", "select count(*) as rows, count(distinct o_custkey) as customers from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def _(t):
    o = t.base("orders")
    d = laws.narrow(o, {"o_orderstatus": "F", "o_custkey": -1, "o_orderpriority": "1-URGENT", "o_orderdate": None}, ["o_orderstatus", "o_custkey", "o_orderpriority", "o_orderdate"])
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers"))


@query("l15_seeded_draw", "select r.o_orderkey, round(coalesce(p.value, 0.18), 6) as drawn from orders r left join (select event_type, count(*) as n from irregular where value is not null group by 1) s on s.event_type = case when r.o_orderkey % 3 = 0 then 'click' when r.o_orderkey % 3 = 1 then 'purchase' else 'nothing' end left join (select event_type, value, row_number() over (partition by event_type order by value, event_id) - 1 as at from irregular where value is not null) p on p.event_type = s.event_type and p.at = (r.o_custkey * 7919 + r.o_orderkey * 104729 + 3 * 1299709) % s.n")
def _(t):
    o = t.base("orders").select("o_orderkey", F.col("o_custkey").alias("seed"), F.col("o_orderkey").alias("draw_id"), F.when(F.col("o_orderkey") % 3 == 0, "click").when(F.col("o_orderkey") % 3 == 1, "purchase").otherwise("nothing").alias("event_type"))
    return laws.draw(o, t.irregular, "value", ["event_type"], ["event_id"], 3, "drawn", F.lit(0.18)).select("o_orderkey", "drawn")


def fitted(t: Tables, typecodes: list[str] | None = None) -> fit.Laws:
    meta, track = meta_of(t), t.written(*COMMAND_COLUMNS, *PLACE_COLUMNS)
    return fit.fit_laws(islands.command_events(track), track, meta, lengths_of(t), ends_of(t), tables.settle(tod_of(t, track)), laws.condition(meta, typecodes) if typecodes else None)


@query("l15_context_draws")
def _(t):
    found = fitted(t)
    n = F.regexp_extract("flight_id", "[0-9]+", 0).cast("long")
    requests = fit.with_distance_bin(meta_of(t), found.edges).select(*K, "gc_bin", "family", (24000.0 + 500.0 * (n % 20)).alias("h_pre_max"), (250.0 + 5.0 * (n % 12)).alias("cas_pre_last"), n.alias("seed"), (n % 7).alias("draw_id"))
    return draws.draw_contexts(requests, found.anchors, found.descents, found.level_mach, found.tables["cas_starts"], found.transitions)


@query("l16_family_fallback", "select m.route, m.flight_id, case when h.family is not null then m.family else coalesce(o.other, o.first) end as family_used from meta m left join (select distinct route, family from meta where right(flight_id, 1) in ('1', '2', '3')) h on h.route = m.route and h.family = m.family left join (select route, max(case when family = 'Other' then family end) as other, min(family) as first from meta where right(flight_id, 1) in ('1', '2', '3') group by route) o on o.route = m.route")
def _(t):
    m = meta_of(t)
    return laws.family_fallback(m, m.filter(F.right("flight_id", F.lit(1)).isin("1", "2", "3")), ["route"]).select(*K, "family_used")


# --- Pool comparison ---------------------------------------------------------------------------------------------------


def pools(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.track.select(*K, "timestamp", "phase", F.col("altitude").alias("h_ft"), (F.col("vertical_rate") / 100).alias("gamma_deg"), F.col("CAS").alias("tas_kt"), F.col("vertical_rate").alias("vz_fpm"))
    odd = F.right("flight_id", F.lit(1)).isin("1", "3", "5", "7", "9")
    return d.filter(odd), d.filter(~odd)


POOL = "select *, right(flight_id, 1) in ('1', '3', '5', '7', '9') as odd from track"
QS = "[" + ", ".join(str(q) for q in compare.QUANTILES) + "]"
LONG = f"select odd, phase, unnest(['h_ft', 'gamma_deg', 'tas_kt', 'vz_fpm']) as col, unnest([altitude, vertical_rate / 100, CAS, vertical_rate]) as v from ({POOL}) p"


def w1_sql(source: str, by: str) -> str:
    sums = " + ".join(f"abs(a.q[{k}] - b.q[{k}])" for k in range(1, 20))
    side = f"select {by}, quantile_cont(v, {QS}) as q from ({source}) s where v is not null"
    return f"select {', '.join('a.' + c for c in by.split(', '))}, round(({sums}) / 19, 6) as w1 from ({side} and odd group by {by}) a join ({side} and not odd group by {by}) b using ({by})"


@query("d1_quantile_distance", f"select col as column, w1 from ({w1_sql(LONG, 'col')}) x")
def _(t):
    a, b = pools(t)
    return compare.quantile_distance(a, b)


@query("d2_compare_pools", f"select phase, col as column, w1 from ({w1_sql(f'{LONG} where phase <> ' + chr(39) + 'GROUND' + chr(39) + ' union all select odd, ' + chr(39) + 'ALL' + chr(39) + f', col, v from ({LONG}) l', 'phase, col')}) x")
def _(t):
    a, b = pools(t)
    return compare.compare_pools(a, b)


@query("d3_operational_pool", f"select route, flight_id, count(*) as rows, round(avg(h), 4) as h_ft from ({PLAYED}) x group by 1, 2", 4)
def _(t):
    m = meta_of(t).join(t.flights.select(*K, "firstseen"), K)
    d = replay.operational_pool(t.track, m)
    return d.groupBy(*K).agg(F.count(F.lit(1)).alias("rows"), F.avg("h_ft").alias("h_ft"))


KS = f"select v, sum(cast(odd as int)) as a, sum(cast(not odd as int)) as b from (select odd, altitude as v from ({POOL}) p where altitude is not null) s group by v"


@query("d4_ks", f"select n, m, round(d, 6) as statistic, round(case when l < 0.2 then 1.0 else least(greatest(2 * (select sum(case when k % 2 = 1 then 1 else -1 end * exp(-2.0 * k * k * l * l)) from (select unnest(range(1, 101)) as k) s), 0), 1) end, 6) as p_value from (select n, m, d, sqrt(n * m / (n + m)) * d as l from (select max(n) as n, max(m) as m, max(abs(ca / n - cb / m)) as d from (select sum(a) over () as n, sum(b) over () as m, sum(a) over (order by v) as ca, sum(b) over (order by v) as cb from ({KS}) k) x) y) z")
def _(t):
    a, b = pools(t)
    return compare.ks(a, b, "h_ft")


@query("d5_phi_bands", f"select phase, (k + 0.5) / 25 as phi, round(q[1], 6) as p10, round(q[2], 6) as p50, round(q[3], 6) as p90 from (select phase, k, quantile_cont(altitude, [0.1, 0.5, 0.9]) as q from (select *, (select count(*) from (select unnest(range(1, 25)) as e) b where x.phi > b.e * (1.0e0 / 25)) as k from ({PHI}) x where phi is not null and altitude is not null) y group by phase, k) z")
def _(t):
    return compare.phi_bands(series.share_in_phase(t.track), "altitude", ["phase"])


ENV_G = f"select {ID}, k, s0 + (s1 - s0) * k / 40 as t from (select {ID}, min(epoch(timestamp)) as s0, max(epoch(timestamp)) as s1 from track where altitude is not null group by {ID}) s, (select unnest(range(0, 41)) as k) u"
ENV = f"select g.k, coalesce(b.altitude + (f.altitude - b.altitude) * (g.t - b.t) / nullif(f.t - b.t, 0), b.altitude, f.altitude) as v from ({ENV_G}) g asof left join (select {ID}, epoch(timestamp) as t, altitude from track where altitude is not null) b on g.route = b.route and g.flight_id = b.flight_id and g.t >= b.t asof left join (select {ID}, epoch(timestamp) as t, altitude from track where altitude is not null) f on g.route = f.route and g.flight_id = f.flight_id and g.t <= f.t"


@query("d6_altitude_envelope", f"select round(k / 40, 6) as tau, round(q[1], 3) as p10, round(q[2], 3) as p50, round(q[3], 3) as p90 from (select k, quantile_cont(v, [0.1, 0.5, 0.9]) as q from ({ENV}) e group by k) x")
def _(t):
    d = compare.altitude_envelope(t.track, "altitude")
    return d.select("tau", *[F.round(c, 3).alias(c) for c in ("p10", "p50", "p90")])


@query("d7_median_of_medians", f"select phase, k as bin, round(median(m), 6) as median, count(m) as flights from (select phase, {ID}, k, median(altitude) as m from (select *, (select count(*) from (select unnest(range(1, 20)) as e) b where x.phi > b.e * 0.05e0) as k from ({PHI}) x where phi is not null) y group by phase, {ID}, k) z group by phase, k")
def _(t):
    return compare.median_of_medians(series.share_in_phase(t.track), "altitude", ["phase"])


@query("d8_tails", "select route, round(avg(cast(altitude > 30000 as int)), 6) as above, round(avg(cast(altitude < 3000 as int)), 6) as below from track where altitude is not null group by route")
def _(t):
    return compare.tails(t.track, "altitude", ["route"], 30000.0, 3000.0)


@query("d9_fill_rates", "select unnest(['altitude', 'Mach', 'TAS', 'track']) as column, unnest([count(altitude), count(Mach), count(TAS), count(track)]) as known, round(unnest([count(altitude), count(Mach), count(TAS), count(track)]) / count(*), 6) as share_known, round(1 - unnest([count(altitude), count(Mach), count(TAS), count(track)]) / count(*), 6) as share_null from track")
def _(t):
    return compare.fill_rates(t.track, ["altitude", "Mach", "TAS", "track"])


@query("d10_describe", "select col as column, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as q25, round(median(v), 6) as q50, round(quantile_cont(v, 0.75), 6) as q75, round(max(v), 6) as max from (select unnest(['altitude', 'CAS']) as col, unnest([altitude, CAS]) as v from track) x where v is not null group by col")
def _(t):
    return compare.describe(t.track, ["altitude", "CAS"])
