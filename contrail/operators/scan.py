"""Scans of long series in slices of time, so that one series is many tasks.

A window over a series is one task for it, however long it is. Here the slice of a row's time is a further partition key of all
windows. What a row needs from other slices, the last and next known values, sums and extremes so far, comes from one row for
each slice: these are few, a window over them carries them along the series, and a join by series and slice brings them back. They are
written first, so that the rows, which are dealt out by series and slice for them and again for the windows and the join, are not on disk
twice at a time. df is read twice, so a costly one should be written first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.operators.series import KEYS, ORDER, dealt

#: Seconds of a slice.
SLICE_S = 7200.0


def slice_of(us: Column, slice_s: float = SLICE_S) -> Column:
    """Number of the slice of a time in microseconds."""
    return F.floor(us / F.lit(int(slice_s * 1_000_000)))


def scanned(df: DataFrame, running: Mapping[str, tuple[str, Column | str | None]], part: Column, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int = 0) -> DataFrame:
    """df with one column for each name of running, taken over the whole series. Each is (how, value), how being

    row         number of the row, from 1 (value is not used)
    last, next  struct n, v: row number and value of the last known one up to the row, or the next from it on; null if none
    sum, min, max   over the known values up to the row; null if there are none

    A value that is a column of df is best given by its name: it is not dealt out a second time then.
    part numbers slices in the order of the rows, and order tells all rows of a series apart. Keys are not null. rows is about how
    many df has, if they are many: they are dealt() by it.
    """
    from contrail.sources.tables import settle  # it imports this module

    up = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_part").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    values = {f"_v_{n}": v for n, (how, v) in running.items() if isinstance(v, Column)}
    of = {n: v if isinstance(v, str) else f"_v_{n}" for n, (how, v) in running.items()}
    d = dealt(df.withColumn("_part", part).withColumns(values), rows, [*keys, "_part"]).withColumn("_k", F.row_number().over(up).cast("long"))
    known = lambda n: F.when(F.col(of[n]).isNotNull(), F.struct(F.col("_k").alias("n"), F.col(of[n]).alias("v")))

    # One row for each slice, carried along the series.
    found = [F.count(F.lit(1)).alias("_rows")]
    for n, (how, _) in running.items():
        if how in ("last", "next"):
            pick = F.max_by if how == "last" else F.min_by
            found.append(pick(of[n], F.when(F.col(of[n]).isNotNull(), F.col("_k"))).alias(f"_t_{n}"))
            found.append((F.max if how == "last" else F.min)(F.when(F.col(of[n]).isNotNull(), F.col("_k"))).alias(f"_at_{n}"))
        elif how in fold:
            found.append(fold[how](of[n]).alias(f"_t_{n}"))
    slices = d.groupBy(*keys, "_part").agg(*found)
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    r = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0)))
    carried = {}
    for n, (how, _) in running.items():
        if how in ("last", "next"):
            whole = F.when(F.col(f"_at_{n}").isNotNull(), F.struct((F.col(f"_at_{n}") + F.col("_before")).alias("n"), F.col(f"_t_{n}").alias("v")))
            carried[f"_c_{n}"] = F.last(whole, ignorenulls=True).over(w if how == "last" else r)
        elif how in fold:
            carried[f"_c_{n}"] = fold[how](f"_t_{n}").over(w)
    slices = settle(slices.select(*keys, "_part", "_before", *[c.alias(n) for n, c in carried.items()]))

    local = {}
    for n, (how, _) in running.items():
        if how in ("last", "next"):
            local[f"_l_{n}"] = F.last(known(n), ignorenulls=True).over(up if how == "last" else down)
        elif how in fold:
            local[f"_l_{n}"] = fold[how](of[n]).over(up)
    d = d.withColumns(local).join(slices, [*keys, "_part"], "left")
    out = {}
    for n, (how, _) in running.items():
        here, there = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if how == "row":
            out[n] = F.col("_k") + F.col("_before")
        elif how in ("last", "next"):
            out[n] = F.when(here.isNotNull(), F.struct((here["n"] + F.col("_before")).alias("n"), here["v"].alias("v"))).otherwise(there)
        elif how == "sum":
            out[n] = F.coalesce(here + there, here, there)
        else:
            out[n] = (F.least if how == "min" else F.greatest)(here, there)
    added = [n for n in out if n in df.columns]
    return d.select(*[c for c in df.columns if c not in added], *[c.alias(n) for n, c in out.items()])


def between(value: Column, row: Column, last: Column, following: Column, empty: float | None = None) -> Column:
    """value, or if it is null linearly by row number between the known ones around it, constant beyond both ends, or `empty`."""
    span = following["n"] - last["n"]
    line = last["v"] + (following["v"] - last["v"]) * (row - last["n"]) / F.when(span > 0, span)
    return F.coalesce(value, line, last["v"], following["v"], F.lit(empty).cast("double"))


def within(last: Column, row: Column, limit: int) -> Column:
    """The last known value if it is at most limit rows back."""
    return F.when(row - last["n"] <= limit, last["v"])
