"""Reports over routes and flights: statistics, totals, counts and filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.bins import distance_label
from contrail.operators.series import KEYS


def route_stats(manifest: DataFrame, qc: DataFrame, lengths: DataFrame, edges: list[float]) -> DataFrame:
    """By route: flights listed, done, accepted and rejected, length and its band."""
    m = manifest.groupBy("route").agg(F.count(F.lit(1)).alias("manifest_rows"), F.count_if(F.col("status") == "done").alias("done"))
    q = qc.groupBy("route").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    d = m.join(q, "route", "left").join(lengths.select("route", "gc_nm"), "route", "left")
    return d.withColumn("band", distance_label("gc_nm", edges)).fillna(0, ["accepted", "rejected"])


def totals(stats: DataFrame) -> DataFrame:
    """One row: routes, airports, accepted and done flights."""
    ends = stats.select(F.explode(F.split("route", "_", 2)).alias("airport"))
    return stats.agg(F.count_distinct("route").alias("routes"), F.sum("accepted").alias("accepted"), F.sum("done").alias("done")).join(ends.agg(F.count_distinct("airport").alias("airports")))


def airports_used(stats: DataFrame) -> DataFrame:
    """Airports at either end of a route."""
    parts = F.split("route", "_", 2)
    return stats.select(parts[0].alias("icao")).union(stats.select(parts[1])).distinct().orderBy("icao")


def key_figures(flights: DataFrame) -> DataFrame:
    """One row: flights, distinct routes, airports and type codes."""
    ends = flights.select(F.explode(F.split("route", "_", 2)).alias("airport")).agg(F.count_distinct("airport").alias("airports"))
    return flights.agg(F.count(F.lit(1)).alias("flights"), F.count_distinct("route").alias("routes"), F.count_distinct("typecode").alias("typecodes")).join(ends)


def counts(flights: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Flights by a column, most first; the first `top` if given."""
    d = flights.groupBy(by).agg(F.count(F.lit(1)).alias("flights")).orderBy(F.desc("flights"), by)
    return d.limit(top) if top else d


def choose(flights: DataFrame, families: Sequence[str] | None = None, typecodes: Sequence[str] | None = None, band: tuple[float, float] | None = None, text: str = "") -> DataFrame:
    """Flights that pass all filters given; text is looked for in the route, in either case."""
    d = flights
    if families:
        d = d.filter(F.col("family").isin(list(families)))
    if typecodes:
        d = d.filter(F.col("typecode").isin(list(typecodes)))
    if band:
        d = d.filter(F.col("gc_nm").between(*band))
    return d.filter(F.contains(F.upper("route"), F.lit(text.upper()))) if text else d


def routes_of(stats: DataFrame, flights: DataFrame) -> DataFrame:
    """Route statistics of routes that have one of the flights."""
    return stats.join(flights.select("route").distinct(), "route", "left_semi")


def payload(stats: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Everything that a page about the routes shows, as rows for a JSON sink that is partitioned by part and route:

    routes     the statistics of a route and the number of its flights (flights_n)
    flights    a row for each flight, with typecode, family and gc_nm; no route is gathered in one row
    airports   icao, name, latitude and longitude of the airports at either end of a route, unknown ones with nulls
    summary    one row of totals

    Rows have the columns of all parts; those of other parts are null. The route of airports and summary is empty."""
    part = lambda d, name: d.withColumn("part", F.lit(name))
    n = flights.groupBy("route").agg(F.count(F.lit(1)).alias("flights_n"))
    of_routes = part(stats.join(n, "route", "left").withColumn("flights_n", F.coalesce("flights_n", F.lit(0).cast("long"))), "routes")
    of_flights = part(flights.join(stats.select("route"), "route", "left_semi").select("route", "flight_id", "typecode", "family", "gc_nm"), "flights")
    places = airports.select("icao", *[c for c in ("name", "latitude", "longitude") if c in airports.columns])
    of_airports = part(airports_used(stats).join(places, "icao", "left").withColumn("route", F.lit("")), "airports")
    summary = part(totals(stats).withColumnsRenamed({c: f"total_{c}" for c in ("routes", "accepted", "done", "airports")}).withColumn("route", F.lit("")), "summary")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (of_routes, of_flights, of_airports, summary))


def first_values(df: DataFrame, value: str, order: str, keys=KEYS) -> DataFrame:
    """First known value of each flight."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))
