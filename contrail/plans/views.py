"""Tables of the library's own shape, derived from the general tables that the registered queries are given.

Each view is one SQL text that both Spark and the checking engine accept. Arithmetic keeps to integers and dyadic fractions
where it can, so both agree to the bit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.operators import series
from contrail.sources import tables

BASE = ("lineitem", "orders", "customer", "supplier", "nation", "region", "events")

#: A flight per supplier, a row per second: climb, cruise with steps, descent; gaps where a line number says so.
TRACK = """
select concat('N', cast(l_suppkey % 7 as string), '_N', cast(l_suppkey % 7 + 8 as string)) as route, concat('F', cast(l_suppkey as string)) as flight_id,
  timestamp '2024-01-01 00:00:00' + i * interval '1' second as timestamp, i, n, ln, rf, cast(i as double) as time,
  case when ln <> 7 then cast(floor(cruise * ramp / n) as double) end as altitude, slope + (q - 25) * 4 as vertical_rate,
  case when not (ln = 6 and i % 16 = 0) then (180.0e0 + floor(8.0e0 * i / n)) / 256.0e0 + (ln % 2) / 1024.0e0 end as Mach,
  case when ln <> 5 then 250.0e0 + 10.0e0 * floor(6.0e0 * i / n) + (ln % 3) end as CAS,
  case when ln > 2 then 250.0e0 + 10.0e0 * floor(6.0e0 * i / n) + floor(ramp * 128 / n) end as TAS,
  case when ln = 1 then -20.0e0 - floor(ramp * 32 / n) when ln = 2 then 250.0e0 end as static_temperature,
  case when ln <> 4 then 10.0e0 * (i % 36) end as heading, 5.0e0 * (i % 72) as track_deg, cast(null as double) as track,
  case when ln <> 3 then 25.0e0 * floor(cruise * ramp / n / 25) + 3 end as selected_mcp,
  case when ln <> 2 then 500.0e0 * floor(floor(8.0e0 * ramp / n) * cruise / 4000.0e0) end as h_sel,
  case when ln <> 5 then 50.0e0 * floor(slope / 50) + 100.0e0 * (floor(i / 40.0e0) % 3) end as vz_sel,
  case when ramp * 4 > n * 3 then (180.0e0 + floor(8.0e0 * i / n)) / 256.0e0 end as mach_sel,
  case when ramp * 4 <= n * 3 then 250.0e0 + 10.0e0 * floor(6.0e0 * i / n) end as cas_sel,
  case when i < 3 then 'GROUND' when 4 * i < n then 'CLIMB' when 4 * (n - i) < n then 'DESCENT' else 'LEVEL' end as phase,
  case when ln <> 7 then 30.0e0 + l_suppkey % 7 + 8.0e0 * i / n end as latitude, -20.0e0 + 2 * (l_suppkey % 7) + 16.0e0 * i / n as longitude, CAST(groundspeed as double) as groundspeed_kt
from (select *, 24000.0e0 + 500.0e0 * (l_suppkey % 20) as cruise, cast(least(4 * i, n, 4 * (n - i)) as double) as ramp, 240.0e0 + (i % 16) as groundspeed,
    case when 4 * i < n then (24000.0e0 + 500.0e0 * (l_suppkey % 20)) * 240 / n when 4 * (n - i) < n then -(24000.0e0 + 500.0e0 * (l_suppkey % 20)) * 240 / n else 0.0e0 end as slope
  from (select l_suppkey, l_quantity as q, l_linenumber as ln, l_returnflag as rf,
      cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as bigint) as i, cast(count(*) over (partition by l_suppkey) as bigint) as n
    from lineitem) a) b
"""
#: The irregular side of joins by time: some rows of the track, half a second later.
SPARSE = """
select route, flight_id, timestamp + interval '500 milliseconds' as timestamp, i as seq, altitude as altitude_ft, CAS as IAS, TAS, groundspeed_kt, latitude, longitude, phase from track where rf = 'R'
"""
FLIGHTS = """
select concat('N', cast(s_suppkey % 7 as string), '_N', cast(s_suppkey % 7 + 8 as string)) as route, concat('F', cast(s_suppkey as string)) as flight_id, concat('a', cast(s_suppkey as string)) as icao24,
  case when s_suppkey % 5 = 0 then cast(null as string) when s_suppkey % 5 = 1 then '  ' else concat('CS ', cast(s_suppkey as string)) end as callsign,
  concat('N', cast(s_suppkey % 7 as string)) as departure, concat('N', cast(s_suppkey % 7 + 8 as string)) as arrival,
  timestamp '2024-01-01 00:00:30' + (s_suppkey % 11) * interval '1' second as firstseen, timestamp '2024-01-01 00:05:00' + (s_suppkey % 13) * interval '1' minute as lastseen,
  case when s_suppkey % 6 = 5 then 'error' when s_suppkey % 6 = 4 then 'pending' else 'done' end as status, s_acctbal as balance
from supplier
"""
AIRCRAFT = """
select concat('a', cast(s_suppkey as string)) as icao24, case s_suppkey % 6 when 0 then 'A320' when 1 then 'B738' when 2 then 'E190' when 3 then 'BCS1' when 4 then 'a20n ' end as typecode, concat('REG', cast(s_suppkey as string)) as registration
from supplier where s_suppkey % 9 <> 8
"""
AIRPORTS = "select concat('N', cast(n_nationkey as string)) as icao, n_name as name, 30.0e0 + n_nationkey as latitude, -20.0e0 + 2 * n_nationkey as longitude, 10.0e0 * n_nationkey as altitude from nation"
IRREGULAR = "select concat('U', cast(user_id as string)) as flight_id, event_id, ts as timestamp, event_type, value from events"
#: A log of updates: every order is a record of its customer.
LOG = "select concat('C', cast(o_custkey as string)) as flight_id, o_orderkey as seq, o_orderstatus as status, o_totalprice as price from orders"

VIEWS = {"track": TRACK, "sparse": SPARSE, "flights": FLIGHTS, "aircraft": AIRCRAFT, "airports": AIRPORTS, "irregular": IRREGULAR, "log": LOG}

#: Views of the checking engine only: results of operators, written another way.
CHECKED = {
    "meta": "select f.route, f.flight_id, a.typecode, case upper(trim(a.typecode)) when 'A319' then 'A320 family' when 'A320' then 'A320 family' when 'A321' then 'A320 family' when 'A20N' then 'A320 family' when 'A21N' then 'A320 family' when 'BCS1' then 'A220' when 'BCS3' then 'A220' when 'B738' then 'B737' when 'B737' then 'B737' when 'B739' then 'B737' when 'E190' then 'E-Jet' when 'E195' then 'E-Jet' when 'E290' then 'E-Jet' when 'E295' then 'E-Jet' when 'E75L' then 'E-Jet' else 'Other' end as family, f.firstseen, l.gc_nm from flights f left join aircraft a using (icao24) left join lengths l using (route)",
    "lengths": "select route, km as gc_km, km / 1.852 as gc_nm from (select r.route, 2 * 6371.0 * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))) as km from (select distinct route from flights) r left join airports a on a.icao = split_part(r.route, '_', 1) left join airports b on b.icao = split_part(r.route, '_', 2))",
    "cmd": "select route, flight_id, command, min(timestamp) as t0, max(timestamp) as t1, epoch(max(timestamp)) - epoch(min(timestamp)) as duration_s, avg(v) as value from (select *, sum(case when prev is null or abs(q - prev) > step then 1 else 0 end) over (partition by route, flight_id, command order by timestamp) as island from (select *, lag(q) over (partition by route, flight_id, command order by timestamp) as prev from (select route, flight_id, timestamp, command, v, step, round_even(v / step, 0) * step as q from (select route, flight_id, timestamp, unnest([{'command': 'mach_sel', 'v': mach_sel, 'step': 0.01e0}, {'command': 'cas_sel', 'v': cas_sel, 'step': 5e0}, {'command': 'vz_sel', 'v': vz_sel, 'step': 50e0}, {'command': 'h_sel', 'v': h_sel, 'step': 100e0}, {'command': 'selected_mcp', 'v': selected_mcp, 'step': 25e0}], recursive := true) from track) x) y) z where q is not null) w group by route, flight_id, command, island",
    "ev": "select c.*, p.phase from cmd c join track p on p.route = c.route and p.flight_id = c.flight_id and p.timestamp = c.t0",
    "slab": "select route, flight_id, phase, min(timestamp) as s0, max(timestamp) as s1, epoch(max(timestamp)) - epoch(min(timestamp)) as span, count(*) as rows from track group by all",
    "held": "select *, last_value(h_sel ignore nulls) over (partition by route, flight_id order by timestamp) as hh from track",
    "tod": "select * from (select *, row_number() over (partition by route, flight_id order by case when hh <= 22000 then 0 else 1 end, timestamp) as k from (select *, lag(hh) over (partition by route, flight_id order by timestamp) as hp from held) a where hp - hh >= 500 and hp >= 5000) b where k = 1",
}


def with_views(sql: str) -> str:
    """sql with the views that it names, and those that they name, in front."""
    every, need = VIEWS | CHECKED, []

    def visit(text: str) -> None:
        for name in every:
            if name not in need and re.search(rf"\b(?:from|join|,)\s+{name}\b", text, re.IGNORECASE):
                visit(every[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({every[n].strip()})" for n in need) + "\n" + sql.strip()


class Tables:
    """The views of one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.rows = 0  # of the track, once it is read

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        uses = {b: self.base(b) for b in BASE if re.search(rf"\bfrom\s+{b}\b", text)} | {v: getattr(self, v) for v in VIEWS if re.search(rf"\bfrom\s+{v}\b", text)}
        for u in uses:
            text = re.sub(rf"\bfrom\s+{u}\b", f"from {{{u}}}", text)
        if name != "track":
            return self.spark.sql(text, **uses)
        return series.dealt(self.undealt(), self.rows)

    def undealt(self) -> DataFrame:
        """The track by supplier, for what writes it first: dealt by flight after that, its rows need not be before it."""
        lines = self.base("lineitem")
        # A row a line; the number of lines comes from the files' footers.
        self.rows = lines.count()
        return self.spark.sql(re.sub(r"\bfrom\s+lineitem\b", "from {lineitem}", TRACK), lineitem=series.dealt(lines, self.rows, ["l_suppkey"]))

    def written(self, *columns: str) -> DataFrame:
        """Keys, timestamp and columns of the track, written once for what reads it several times."""
        return series.dealt(tables.settle(self.undealt().select(*series.KEYS, "timestamp", *columns)), self.rows)


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """df in types that compare alike everywhere: times as epoch microseconds, integers as longs, doubles rounded."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, T.IntegerType | T.ShortType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)
