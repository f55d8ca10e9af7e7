"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 by doc_id. The number is split into two digits of a mixed radix a * b >= n and sent through
a Feistel network, whose rounds add a keyed function of one digit to the other; that is a permutation of 0..a*b-1, and
walking its cycle until the value is below n makes it one of 0..n-1. The shuffled place p gives shard p mod s and slot
p div s, so both can be computed for any row number, and back, without looking at another row. Shards differ by at most
one row: the law is `rows`.

Defined cases: null texts have size 1 and the checksum of no bytes; rows with a null doc_id come first. Rows that repeat
a doc_id are ordered by a hash of their text, and copies of one row take neighbouring numbers in any order, which
exchanges equal rows only. An empty table gives an empty result. In shard_documents other columns stay as they are; a
column named like an added one is replaced.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.llm._spark import documents, packed

SHARDS, SEED, ROUNDS = 8, 20, 6
#: Prime modulus of the round function; squares of values below it fit in a long.
PRIME = 2147483647
#: Cut points of the numbering: so many ranges of doc_id for each shuffle partition, at least LEAST_RANGES.
RANGES_A_PARTITION, LEAST_RANGES, MOST_RANGES = 8, 64, 16384
#: A doc_id that fills a range alone, and null, are a range for each of so many parts of the hashes of their texts.
PARTS = 64


def radix(n: int) -> tuple[int, int]:
    """(a, b), the digits' ranges: a * b >= n and close to n."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(multiplier, addend) of each round."""
    return [(1 + (seed * 7919 + r * 104729 + 48271) % (PRIME - 2), (seed * 15485863 + r * 32452843 + 11) % PRIME) for r in range(ROUNDS)]


def permute_once(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One pass of the network over int64 values in 0..a*b-1."""
    a, b = radix(n)
    left, right = x % a, x // a
    for r, (m, c) in enumerate(round_keys(seed)):
        y = ((right if r % 2 == 0 else left) * m + c) % PRIME
        f = y * y % PRIME
        if r % 2 == 0:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return right * a + left


def places(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The shuffled places of row numbers below n. Few values are walked: fewer than sqrt(n) + 1 lie outside 0..n-1."""
    x = permute_once(rows.astype(np.int64), n, seed)
    while (out := x >= n).any():
        x[out] = permute_once(x[out], n, seed)
    return x


def with_row_number(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(df with a long _row from 0, number of rows), by doc_id, which is numeric. Ranges of doc_id, cut at approximate
    quantiles, are counted first and then numbered in parallel, each from the sum of the counts before it; the cut points
    and counts, a bounded number, are all the driver sees. Rows of one doc_id that fills ranges by itself, and those
    without one, are spread by the hash of their text, which is their order anyway."""
    ranges = min(MOST_RANGES, max(LEAST_RANGES, RANGES_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.agg(F.percentile_approx(F.col(id_col), [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    edges, times = np.unique(np.array(cuts), return_counts=True)
    hot = edges[times > 1]

    @F.arrow_udf("long")
    def position(ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        x = np.asarray(ids.fill_null(0))
        # Even positions are between edges, odd ones of a hot edge alone; null is before all.
        at = 2 * np.searchsorted(edges, x, "right").astype(np.int64) if len(edges) else np.zeros(len(x), np.int64)
        at -= np.isin(x, hot)
        return pa.array(np.where(known, at, -2))

    text = F.xxhash64(text_col)
    at = F.col("_at")
    alone = (at < 0) | (F.pmod(at, F.lit(2)) == 1)
    part = F.when(alone, F.shiftright(text, 58) + PARTS // 2).otherwise(0)
    df = df.withColumn("_at", position(id_col)).withColumn("_range", at * PARTS + part).drop("_at")
    counts = sorted((r[0], r[1]) for r in df.groupBy("_range").count().collect())
    before, total = [], 0
    for k, c in counts:
        before.append((k, total))
        total += c
    if not total:
        return df.withColumn("_row", F.lit(0).cast("long")).drop("_range"), 0
    base = df.sparkSession.createDataFrame(before, "_range long, _before long")
    order = Window.partitionBy("_range").orderBy(F.asc_nulls_first(id_col), text)
    df = df.withColumn("_row", F.row_number().over(order) - 1).join(F.broadcast(base), "_range")
    return df.withColumn("_row", F.col("_row") + F.col("_before")).drop("_range", "_before"), total


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with law, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    rows, n = with_row_number(packed(docs.drop("law", "shard", "slot"), _id=id_col, _text=text_col), "_id", "_text")

    @F.pandas_udf("long")
    def shuffled(row: pd.Series) -> pd.Series:
        return pd.Series(places(row.to_numpy(), n, seed))

    p = rows.withColumn("_place", shuffled("_row"))
    shard, slot = F.pmod("_place", F.lit(shards)).cast("int"), F.floor(F.col("_place") / shards).cast("long")
    return p.select("row.*", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Parquet folders shard=0, 1, ..., the rows of each file in slot order."""
    out = shard_documents(docs, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_documents(slim, text_col="text_crc32").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
