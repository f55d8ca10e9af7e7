"""Centroid clustering with equal-average equal-variance search for the nearest centroid.

Vectors are turned into integers, floor(scale * x), so that sums, means and distances are exact and do not depend on how rows
are dealt. Centroids start as the vectors with the smallest hashes of their ids; each round assigns every vector to its nearest
centroid (ties: the smaller number) and moves every centroid that has vectors to the floor of their mean; then vectors are
assigned once more.

The nearest centroid is searched outward from the vector's own mean. Centroids are sorted by the sum of their components; with
S the sum and W = sqrt(dims * sum of squares - S * S), for a vector x and a centroid c

    dims * |x - c|^2  >=  (S_x - S_c)^2 + (W_x - W_c)^2,

so the scan ends where the first square alone exceeds dims * (best distance so far), and skips centroids that both squares
rule out. The bounds are in floating point with a margin wider than its rounding; what they leave is measured in integers, so
the result is that of a search of all centroids.

Only the centroids (as many as asked for) and one row of sums for each of them reach the driver in a round; sums are formed in
the tasks first, so a vector that fills a third of the table costs no more than any other. Rounds read the input again instead
of writing it; the assignments are written once, to the checkpoint folder.

Defined cases: vectors that are null, have another number of components, or hold a null, NaN or infinite one are left out.
Components beyond LARGEST after scaling count as LARGEST, so that any squared distance fits in a long; sums of
distances that do not fit are the greatest long. With fewer vectors than
centroids asked for, all are centroids; equal vectors give equal centroids, of which the later ones stay empty and where they
are. Rows that repeat an id are ordered by their vector, then rows are equal; a null id has the last hash. An empty table gives
an empty result. In cluster() other columns stay as they are; a column named like an added one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import in_arrow, packed, settle

DIMS, CENTROIDS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2
#: Squared distances of vectors of up to 64 components of this size fit in a long.
LARGEST = 189_812_531
#: Share of the bounds' terms that rounding may cost; the true error is below 1e-13 of them.
MARGIN = 1e-11
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """The integers of an array of doubles."""
    return np.clip(np.floor(scale * values), -LARGEST, LARGEST).astype(np.int64)


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S, W) of each row."""
    total = x.sum(axis=1)
    return total, np.sqrt(x.shape[1] * ((x - total[:, None] / x.shape[1]) ** 2).sum(axis=1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance to it, distances that were measured)."""
    n, dims = x.shape
    best, own = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    s, w = moments(x)
    cs, cw = moments(centroids)
    order = np.argsort(cs, kind="stable")
    sums = cs[order]
    low = np.searchsorted(sums, s) - 1
    high, live, measured = low + 1, np.arange(n), 0
    while len(live):
        below, above = s[live] - sums[np.maximum(low[live], 0)], sums[np.minimum(high[live], len(sums) - 1)] - s[live]
        far = np.iinfo(np.int64).max
        below, above = np.where(low[live] >= 0, below, far), np.where(high[live] < len(sums), above, far)
        gap = np.minimum(below, above)
        room = dims * best[live].astype(float)
        going = (gap < far) & ((gap.astype(float) ** 2) * (1 - MARGIN) <= room)
        live, down, gap, room = live[going], (below <= above)[going], gap[going].astype(float), room[going]
        c = order[np.where(down, low[live], high[live])]
        low[live] -= down
        high[live] += ~down
        least = gap**2 + (w[live] - cw[c]) ** 2
        near = least - MARGIN * (least + w[live] ** 2 + cw[c] ** 2) <= room
        at, c = live[near], c[near]
        d = ((x[at] - centroids[c]) ** 2).sum(axis=1)
        measured += len(at)
        nearer = (d < best[at]) | ((d == best[at]) & (c < own[at]))
        best[at[nearer]], own[at[nearer]] = d[nearer], c[nearer]
    return own, best, measured


def usable(vector: Column, dims: int) -> Column:
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), F.lit(False))


def _integers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def first_centroids(vectors: DataFrame, count: int, dims: int, scale: float, salt: int) -> np.ndarray:
    """vectors(_id, _vec): those with the smallest sha256 of `salt:id`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "_vec").orderBy(F.asc_nulls_last("key"), "_vec").limit(count).collect()
    return whole(np.array([r[1] for r in rows], float).reshape(-1, dims), scale)


def moved(vectors: DataFrame, centroids: np.ndarray, scale: float) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _integers(batch.column(0), dims, scale)
            if len(x):
                own, _, _ = nearest(x, shared.value)
                o = np.argsort(own, kind="stable")
                some, first = np.unique(own[o], return_index=True)
                sums[some] += np.add.reduceat(x[o], first, axis=0)
                count += np.bincount(own, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["c", "n", "sums"])

    parts = in_arrow(vectors.select("_vec"), partial, "c long, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for row in parts.groupBy("c").agg(F.sum("n").alias("n"), *total).collect():
        out[row[0]] = [int(s) // row[1] for s in row[2:]]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, salt: int = SALT,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(the usable rows of vectors with cluster, distance, cluster_inertia, inertia and centroid_sha256, final centroids)."""
    if dims > DIMS:
        raise ValueError(f"distances of vectors of more than {DIMS} components may not fit in a long")
    spark = vectors.sparkSession
    rows = packed(vectors.drop(*ADDED), _id=id_col, _vec=vector_col).filter(usable(F.col("_vec"), dims)).withColumn("_vec", F.col("_vec").cast("array<double>"))
    middle = first_centroids(rows, centroids, dims, scale, salt)
    if not len(middle):
        added = [F.lit(None).cast(t).alias(c) for c, t in zip(ADDED, ("int", "long", "long", "long", "string"), strict=True)]
        return rows.filter(F.lit(False)).select("row.*", *added), middle
    for _ in range(rounds):
        middle = moved(rows, middle, scale)
    shared = spark.sparkContext.broadcast(middle)

    @F.arrow_udf("struct<cluster:int,distance:bigint>")
    def near(vec: pa.Array) -> pa.Array:
        own, d, _ = nearest(_integers(vec, dims, scale), shared.value) if len(vec) else (np.zeros(0, int),) * 3
        return pa.StructArray.from_arrays([pa.array(own.astype(np.int32)), pa.array(d)], ["cluster", "distance"])

    found = settle(rows.select("row", near("_vec").alias("_near")).select("row", "_near.*"))
    sums = {c: int(s) for c, s in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda s: min(s, (1 << 63) - 1)
    table = spark.createDataFrame([(c, fits(s), fits(sum(sums.values())), digest(middle[c])) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("row.*", *ADDED), middle


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))[0].drop("embedding")


def _sql() -> str:
    """The same by measuring every vector against every centroid, round by round."""
    steps = [
        f"""kept as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
            where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS})""",
        f"c0 as materialized (select row_number() over (order by sha256('{SALT}:' || vec_id), v) - 1 as c, v from kept qualify c < {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} as materialized (select vec_id, any_value(x.v) as v, min(d) as d, arg_min(c, (d, c)) as c from (
            select k.rowid_ as rowid_, vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from (select row_number() over () as rowid_, * from kept) k, c{r} c) x group by rowid_, vec_id)"""
        )
        steps.append(
            f"""c{r + 1} as materialized (select c0.c, coalesce(m.v, c0.v) as v from c{r} c0 left join (
            select c, list(m order by i) as v from (select c, i, floor(sum(x)::hugeint / count(*))::bigint as m from (
            select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by c, i) group by c) m on c0.c = m.c)"""
        )
    return f"""with {", ".join(steps[:-1])}
        select vec_id, a.c::integer as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
               sha256(array_to_string(m.v, ',')) as centroid_sha256
        from a{ROUNDS} a join c{ROUNDS} m on a.c = m.c"""


SQL = _sql()
