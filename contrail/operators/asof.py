"""Joins by time: nearest, forward and interval joins of whole collections of series, without products of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from contrail.operators.scan import SLICE_S, scanned, slice_of
from contrail.operators.series import KEYS, dealt


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _union(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, right_ts: str, values: Mapping[str, Column], right_order: Sequence[str], right_first: bool) -> DataFrame:
    rest = [c for c in left.columns if c not in keys]
    lhs = left.select(*keys, _us(ts).alias("_t"), F.lit(1 if right_first else 0).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*rest).alias("_left"))
    # Equal-time right rows are taken in the order of right_order.
    tie = F.row_number().over(Window.partitionBy(*keys, right_ts).orderBy(*right_order)).cast("long") if right_order else F.lit(None).cast("long")
    rhs = right.select(*keys, _us(right_ts).alias("_t"), F.lit(0 if right_first else 1).alias("_side"), tie.alias("_tie"), *[F.when(v.isNotNull(), F.struct(_us(right_ts).alias("t"), v.alias("v"))).alias(f"_r_{k}") for k, v in values.items()])
    return lhs.unionByName(rhs, allowMissingColumns=True)


def _in_slices(both: DataFrame, reach_us: int, slice_s: float, part: str | None, halo_us: int) -> DataFrame:
    """both with _part, the slice of a row's time. Right rows stand in every slice that has left rows within reach_us of them;
    left rows have a slice already if part is a column of theirs, and may then be up to halo_us before it."""
    own = slice_of(F.col("_t"), slice_s) if part is None else F.col(f"_left.{part}")
    first, last = slice_of(F.col("_t") - reach_us, slice_s), slice_of(F.col("_t") + reach_us + halo_us, slice_s)
    return both.withColumn("_part", F.explode(F.when(F.col("_left").isNotNull(), F.array(own)).otherwise(F.sequence(first, last))))


def _orders(keys: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """The rows up to the current one in order, and those from it on, as the rows before it in reverse order. (A frame that
    runs from the current row to the end would be gone through anew for every row.)"""
    w, cols = Window.partitionBy(*keys), ("_t", "_side", "_tie")
    return w.orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0), w.orderBy(*[F.desc(c) for c in cols]).rowsBetween(Window.unboundedPreceding, 0)


def _back(both: DataFrame, keys: Sequence[str], left: DataFrame, found: Mapping[str, Column], part: str | None = None) -> DataFrame:
    """The left rows of both with what was found. part is their column that is _part, by which they stay partitioned."""
    rest = [c for c in left.columns if c not in keys]
    own = ["_part"] if part is not None else []
    chosen = both.select(*keys, *own, "_left", *[v.alias(k) for k, v in found.items()]).filter(F.col("_left").isNotNull())
    return chosen.select(*keys, *[(F.col("_part") if c == part else F.col(f"_left.`{c}`")).alias(c) for c in rest], *found)


def asof_nearest(
    left: DataFrame, right: DataFrame, values: Mapping[str, tuple[Column, float | None]], keys: Sequence[str] = KEYS, ts: str = "timestamp", right_ts: str = "timestamp", right_order: Sequence[str] = (),
    slice_s: float | None = SLICE_S, part: str | None = None, halo_s: float = 0.0, rows: int = 0,
) -> DataFrame:
    """left with columns taken from the nearest right row of the same keys. values maps a name to (right expression,
    tolerance in seconds, inclusive, or None). Each looks for the nearest row at which it is not null, so different columns
    may come from different rows; pass a struct to take a row as it is. A tie goes to the earlier row; of rows of one time
    the last serves those after it and the first those before it.

    Both sides are sorted together, once in each direction, and each column is the last right value in either order. That is
    done in slices of slice_s seconds, so a long series is many tasks (None: series by series). Right rows near the end of a
    slice stand in its neighbour as well; without a tolerance, what lies further off is carried over the slices. part names a
    column of left with the slices of its rows, which may begin halo_s before their slice. rows is about how many both sides have, if
    they are many: they are dealt() by it.
    """
    both = _union(left, right, keys, ts, right_ts, {k: v for k, (v, _) in values.items()}, right_order, True)
    tolerances = [tol for _, tol in values.values()]
    if slice_s is not None and None in tolerances:
        ways = {f"_{way}_{k}": (way, f"_r_{k}") for k in values for way in ("last", "next")}
        both = scanned(both, ways, slice_of(F.col("_t"), slice_s), keys, ("_t", "_side", "_tie"), rows)
        around = {k: (F.col(f"_last_{k}.v"), F.col(f"_next_{k}.v")) for k in values}
    else:
        if slice_s is not None:
            both = _in_slices(both, int(max(tolerances) * 1_000_000), slice_s, part, int(halo_s * 1_000_000))
        within = [*keys, "_part"] if slice_s is not None else list(keys)
        both = dealt(both, rows, within)
        w, r = _orders(within)
        around = {k: (F.last(f"_r_{k}", ignorenulls=True).over(w), F.last(f"_r_{k}", ignorenulls=True).over(r)) for k in values}
    found = {}
    for k, (_, tol) in values.items():
        b, f = around[k]
        behind, ahead = F.col("_t") - b["t"], f["t"] - F.col("_t")
        near = F.when(ahead.isNull() | (behind <= ahead), F.struct(behind.alias("d"), b["v"].alias("v"))).otherwise(F.struct(ahead.alias("d"), f["v"].alias("v")))
        found[k] = near["v"] if tol is None else F.when(near["d"] <= int(tol * 1_000_000), near["v"])
    return _back(both, keys, left, found, part if slice_s is not None and None not in tolerances else None)


def asof_forward(
    left: DataFrame, right: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = KEYS, ts: str = "timestamp", right_ts: str = "timestamp", right_order: Sequence[str] = (), slice_s: float | None = SLICE_S, rows: int = 0,
) -> DataFrame:
    """left with columns of the first right row at or after its time, or of the last row if there is none. Long series are
    gone through in slices of slice_s seconds, with what lies in other slices carried over (None: series by series). rows as for
    asof_nearest."""
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    both = _union(left, right, keys, ts, right_ts, {"row": row}, right_order, False)
    if slice_s is not None:
        both = scanned(both, {"_next": ("next", "_r_row"), "_last": ("last", "_r_row")}, slice_of(F.col("_t"), slice_s), keys, ("_t", "_side", "_tie"), rows)
        near = F.coalesce("_next.v", "_last.v")
    else:
        both = dealt(both, rows, keys)
        w, r = _orders(keys)
        near = F.coalesce(F.last("_r_row", ignorenulls=True).over(r), F.last("_r_row", ignorenulls=True).over(w))
    return _back(both, keys, left, {k: near["v"][k] for k in values})


#: Seconds of the smallest bucket of intervals.
BUCKET_S = 28800


def in_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, how: str = "inner", bucket_s: int = BUCKET_S) -> DataFrame:
    """points with the columns of each interval of the same keys with start <= ts < end.

    Time is cut into buckets of bucket_s seconds, of twice that, and so on. An interval goes by buckets of the first size that it
    does not exceed, of which it touches two at most, however long it is; a point stands in one bucket of each size that some
    interval has, which is one size unless there are intervals longer than bucket_s. So a point is compared with the intervals of
    its own buckets only. The sizes, a few numbers, are all the driver sees. how is inner, or left, which keeps points in no
    interval once."""
    length = (_us(end) - _us(start)) / F.lit(1e6)
    # The exponent of the first power of two that the length in buckets does not exceed.
    size = F.when(length <= bucket_s, 0).otherwise(F.ceil(F.log2(length / bucket_s)))
    held = intervals.filter(F.col(start) < F.col(end)).withColumn("_size", size.cast("int"))
    sizes = sorted(r[0] for r in held.select("_size").distinct().collect()) or [0]
    bucket = lambda c, k: F.floor(_us(c) / (F.pow(F.lit(2.0), k) * F.lit(1e6 * bucket_s))).cast("long")
    i = held.withColumn("_bucket", F.explode(F.sequence(bucket(start, F.col("_size")), bucket(end, F.col("_size"))))).alias("i")
    p = points.withColumn("_place", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), bucket(ts, F.lit(float(k))).alias("bucket")) for k in sizes])))
    p = p.withColumns({"_size": F.col("_place.size"), "_bucket": F.col("_place.bucket")}).drop("_place").alias("p")
    inside = (F.col(f"p.{ts}") >= F.col(f"i.{start}")) & (F.col(f"p.{ts}") < F.col(f"i.{end}"))
    for k in keys:
        inside = (F.col(f"p.{k}") == F.col(f"i.{k}")) & inside
    extra = [c for c in intervals.columns if c not in keys and c not in points.columns]
    met = (F.col("p._size") == F.col("i._size")) & (F.col("p._bucket") == F.col("i._bucket")) & inside
    found = p.join(i, met).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}") for c in extra])
    if how == "inner":
        return found
    alone = points
    for k in sizes:
        own = i.filter(F.col("_size") == k).alias("i")
        alone = alone.alias("p").join(own, (bucket(f"p.{ts}", F.lit(float(k))) == F.col("i._bucket")) & inside, "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def plateau_of(points: DataFrame, plateaus: DataFrame, ts: str = "start_timestamp", start: str = "start_timestamp", duration: str = "duration_s", least_s: float = 60.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """points with plateau_start, plateau_value and u, their position in the plateau that holds them: [its start, the next
    one's start), the last one lasting its duration or least_s, whichever is longer. u is clipped to 0..1, plateaus count as
    one second at least. Points before the first plateau, or after the last, are left out.

    As no two plateaus of a series overlap, the last plateau started at or before a point is the only one that can hold it.
    """
    w = Window.partitionBy(*keys).orderBy(start)
    t0 = _us(start)
    stop = F.coalesce(F.lead(t0).over(w), t0 + (F.greatest(F.coalesce(F.col(duration), F.lit(0.0)), F.lit(least_s)) * 1e6).cast("long"))
    spans = plateaus.select(*keys, F.col(start).alias("_at"), F.struct(F.col(start).alias("start"), t0.alias("t0"), stop.alias("t1"), F.col("value").alias("value")).alias("span"))
    both = _union(points, spans, keys, ts, "_at", {"span": F.col("span")}, (), True)
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    held = F.last("_r_span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))["v"]
    out = _back(both, keys, points, {"_span": held}).filter(_us(ts) < F.col("_span.t1"))
    length = F.greatest((F.col("_span.t1") - F.col("_span.t0")) / F.lit(1e6), F.lit(1.0))
    u = F.least(F.greatest((_us(ts) - F.col("_span.t0")) / F.lit(1e6) / length, F.lit(0.0)), F.lit(1.0))
    return out.withColumn("plateau_start", F.col("_span.start")).withColumn("plateau_value", F.col("_span.value")).withColumn("u", u).drop("_span")
