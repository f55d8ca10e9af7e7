"""The list of flights: building, extending and updating it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions.keys import flight_id

STATUS = ("pending", "done", "filtered", "error")


def build(flights: DataFrame, most: int, keys=("route",)) -> DataFrame:
    """Per route the `most` longest flights by time in the air, with their ids and status pending. A tie goes to the lower
    flight_id."""
    d = flights.withColumn("flight_id", flight_id("icao24", "callsign", "firstseen"))
    length = F.unix_micros(F.col("lastseen").cast("timestamp")) - F.unix_micros(F.col("firstseen").cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(length.desc(), "flight_id")
    return d.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k").withColumn("status", F.lit("pending")).withColumn("error", F.lit(None).cast("string"))


def longest(flights: DataFrame, most: int) -> DataFrame:
    """The `most` longest flights of all."""
    length = F.unix_micros(F.col("lastseen").cast("timestamp")) - F.unix_micros(F.col("firstseen").cast("timestamp"))
    return flights.orderBy(length.desc(), "flight_id").limit(most)


def extend(existing: DataFrame, new: DataFrame, total: int) -> DataFrame:
    """existing and as many new flights, by firstseen, as make up total. It is an error if existing has more, or new too few."""
    have = existing.count()
    if total < have:
        raise ValueError(f"the target {total} is below the {have} flights there are")
    fresh = new.join(existing.select("flight_id").distinct(), "flight_id", "left_anti")
    fresh = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("flight_id").orderBy("firstseen"))).filter("_k = 1").drop("_k")
    taken = fresh.orderBy("firstseen", "flight_id").limit(total - have)
    if taken.count() < total - have:
        raise ValueError(f"only {taken.count()} new flights for {total - have} places")
    return existing.unionByName(taken, allowMissingColumns=True)


def upsert(log: DataFrame, sequence: str, key: str = "flight_id") -> DataFrame:
    """The latest record of each key, by an ingest sequence."""
    return log.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sequence)))).filter("_k = 1").drop("_k")


def not_done(manifest: DataFrame) -> DataFrame:
    """Flights that still have to be fetched."""
    done = manifest.filter("status = 'done'").select("flight_id")
    return manifest.join(done, "flight_id", "left_anti")
