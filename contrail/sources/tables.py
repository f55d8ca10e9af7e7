"""Reading and writing: landed tables, routes, dimension lookups and payloads."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions.keys import minute
from contrail.operators.asof import in_interval
from contrail.operators.series import KEYS


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, or some of its columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_routes(spark: SparkSession, path: str, routes: Sequence[str], accepted: DataFrame | None = None) -> DataFrame:
    """Rows of some routes of a table partitioned by route, of accepted flights only if those are given."""
    df = spark.read.parquet(path).filter(F.col("route").isin(list(routes)))
    return df if accepted is None else df.join(accepted.select(*KEYS), list(KEYS), "left_semi")


def read_flight(spark: SparkSession, path: str, route: str, flight_id: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("route") == route) & (F.col("flight_id") == flight_id))


def without_nested(df: DataFrame) -> DataFrame:
    """df without array, map and struct columns."""
    return df.select(*[f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)])


def write(df: DataFrame, path: str, partition: str | None = "route") -> None:
    """Parquet, zstd, replacing what is there; nested columns are left out."""
    w = without_nested(df).write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition) if partition else w).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where it is not set the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


#: Lets Spark delete the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that several readers neither compute it again nor depend on
    any executor. What was shuffled for it is deleted then, so that a plan of several steps needs the disk of its largest one."""
    spark = df.sparkSession
    path, was = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str, values: DataFrame) -> None:
    """The partitions of a Parquet table that values lists become the rows of df, which are all of those: partitions with rows
    are overwritten as the job commits, and those without are removed after it. Others stay."""
    spark = df.sparkSession
    rows = without_nested(df).hint("rebalance", partition)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(partition).parquet(path)
    jvm = spark._jvm
    empty = values.select(partition).distinct().join(df.select(partition).distinct(), partition, "left_anti")
    for (value,) in empty.toLocalIterator():
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, value)
        where = jvm.org.apache.hadoop.fs.Path(path, name)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_payload(df: DataFrame, path: str) -> None:
    """JSON lines of reports.payload by part and route, replacing what is there; nulls are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").partitionBy("part", "route").json(path)


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema, those it lacks as typed nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def clean(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of floating columns as NULL."""
    odd = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in odd})


def flight_list(flights: DataFrame, departure: str, arrival: str, start: str, stop: str) -> DataFrame:
    """Flights between two airports first seen in [start, stop); the filters reach the scan."""
    return flights.filter((F.col("departure") == departure) & (F.col("arrival") == arrival) & (F.col("firstseen") >= F.lit(start).cast("timestamp")) & (F.col("firstseen") < F.lit(stop).cast("timestamp")))


def samples_of_flights(raw: DataFrame, manifest: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Raw samples with the route and flight_id of each flight of the same aircraft that was in the air, from the minute of
    firstseen to that of lastseen, the latter excluded. One join serves all flights."""
    m = manifest.select(*KEYS, "icao24", minute("firstseen").alias("_lo"), minute("lastseen").alias("_hi"))
    return in_interval(raw, m, ["icao24"], ts, "_lo", "_hi").select(*KEYS, *raw.columns)


def routes(manifest: DataFrame) -> DataFrame:
    return manifest.select("route").distinct().orderBy("route")


def accepted_flights(manifest: DataFrame, qc: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """Keys of accepted flights: those that passed quality checks, or where there are none, done flights that have data."""
    if qc is not None:
        return qc.filter("accepted").select(*KEYS).distinct()
    done = manifest.filter("status = 'done'").select(*KEYS)
    return done.intersect(present.select(*KEYS)) if present is not None else done.distinct()


def with_airport(df: DataFrame, airports: DataFrame, code: str, prefix: str, must: bool = False) -> DataFrame:
    """df with prefix_latitude, _longitude and _altitude of an airport; with must, an unknown one is an error."""
    a = airports.select(F.col("icao").alias("_icao"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("latitude", "longitude", "altitude")])
    out = df.join(a, F.upper(F.trim(F.col(code))) == a["_icao"], "left")
    if must:
        known = F.when(F.col("_icao").isNull(), F.raise_error(F.concat(F.lit("no airport "), F.coalesce(F.col(code), F.lit("null"))))).otherwise(F.col(f"{prefix}_latitude"))
        out = out.withColumn(f"{prefix}_latitude", known)
    return out.drop("_icao")


def with_aircraft(df: DataFrame, aircraft: DataFrame) -> DataFrame:
    """df with typecode and registration of its icao24."""
    return df.join(aircraft.select("icao24", "typecode", "registration"), "icao24", "left")
