"""Small helpers on sessions and frames, shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame is broadcast only if it was counted and has at most so many rows (of a few longs each).
BROADCAST_ROWS = 1_000_000
#: Bytes of a batch that is sent to Python.
ARROW_BYTES = 12 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder of the session (spark.checkpoint.dir), so that
    later reads neither compute it again nor depend on any executor. Only where no folder is set, as in tests, one
    under the warehouse is taken."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow(function, schema) in batches of ARROW_BYTES at most. A session that has a bound of its own below that
    keeps it; the usual bound, of 64 MB, takes several times as much of an executor for each of its tasks."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df.mapInArrow(function, schema)


def shared(spark: SparkSession, thing) -> Callable:
    """A function that gives a bounded thing, such as a model, inside tasks. Its attributes are broadcast, once a worker, and its
    class travels with the function, so executors need no installed copy of this package."""
    kind, attributes = type(thing), spark.sparkContext.broadcast(vars(thing))

    def given():
        made = kind.__new__(kind)
        made.__dict__.update(attributes.value)
        return made

    return given


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, which is counted here; else df for a shuffled join. df
    should be cheap to count, such as a settled frame."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def packed(df: DataFrame, **named: str) -> DataFrame:
    """Each row of df whole, as struct `row`, with some of its columns under the given names beside it; so operators may
    add columns of any name without meeting those of df. `row.*` brings the columns back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`").alias(n) for n, c in named.items()])


def crc_fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5: 0 marks a held-out document."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
