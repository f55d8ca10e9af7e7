"""Ordered series: window specifications, fills, interpolation, rolling values and smoothing.

A series is the rows of one key, in the order of some columns. Missing values are NULL; turn NaN and infinities into NULL
at ingest (sources.tables.clean).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("route", "flight_id")
ORDER = ("timestamp",)


def series(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def before(w: WindowSpec, rows: int | None = None) -> WindowSpec:
    """The rows up to the current one, or the last `rows` before it and itself."""
    return w.rowsBetween(Window.unboundedPreceding if rows is None else -rows, 0)


def backwards(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    """The series from its end. Looking ahead is looking back in this order: a frame that runs from the current row to the
    end would be gone through anew for every row."""
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])


#: Rows that a task is dealt, and rows from which on they are dealt so.
ROWS_A_TASK, DEALT_FROM = 100_000, 1_000_000

#: Bytes of files that a task reads where rows are dealt.
SCANNED_BYTES = 8 << 20


def scanned_in_parts(spark: SparkSession) -> None:
    """Lets a task read SCANNED_BYTES of files at most; a session that has a bound of its own below that keeps it. A task that deals
    rows to many partitions holds all it has read in memory, which with Spark's usual 128 MB is millions of rows."""
    name = "spark.sql.files.maxPartitionBytes"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > SCANNED_BYTES:
        spark.conf.set(name, str(SCANNED_BYTES))


def dealt(df: DataFrame, rows: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """df, of about so many rows, with each series whole in one of so many partitions that each has about ROWS_A_TASK rows. Windows over
    keys then take it as it is. Spark sizes its own partitions by compressed bytes, of which regular series have few, so that a
    task would sort millions of rows, several times over in a chain of windows. Small tables are left to Spark."""
    if rows < DEALT_FROM:
        return df
    scanned_in_parts(df.sparkSession)
    return df.repartition(-(-rows // ROWS_A_TASK), *keys)


def laid(df: DataFrame, marks: Mapping[str, DataFrame], at: str = "rn", keys: Sequence[str] = KEYS, rows: int = 0) -> DataFrame:
    """df with each name of marks, the value of the last of its marks (keys, at, name, which is not null) that stands at or before
    the row in its series.

    Marks stand between the rows as rows of their own. A join by place would shuffle all rows by it, in Spark's own partitions, and
    once more by series for the windows after it. Marks are written first, so that no task holds what finds them beside the rows. rows is
    the number that df is dealt() by, if it is: marks are dealt alike, and the rows stay where they are."""
    from contrail.sources.tables import settle  # it imports this module

    d = df
    for n, m in marks.items():
        d = d.unionByName(dealt(settle(m.select(*keys, at, n)), rows, keys), allowMissingColumns=True)
    row = reduce(Column.__and__, [F.col(n).isNull() for n in marks])
    w = Window.partitionBy(*keys).orderBy(at, "_row")
    d = d.withColumn("_row", row).withColumns({f"_at_{n}": F.last(n, ignorenulls=True).over(before(w)) for n in marks}).filter("_row")
    return d.select(*df.columns, *[F.col(f"_at_{n}").alias(n) for n in marks])


def forward_fill(value: Column | str, w: WindowSpec, limit: int | None = None) -> Column:
    """The last non-null value; after more than limit nulls in a row, null."""
    return F.last(value, ignorenulls=True).over(before(w, limit))


def held(value: str, rn: str, w: WindowSpec, limit: int) -> Column:
    """forward_fill with a limit, by the row number rn: a frame of limit rows would be gone through anew for every row."""
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(rn).alias("n"), F.col(value).alias("v"))), ignorenulls=True).over(before(w))
    return F.when(F.col(rn) - last["n"] <= limit, last["v"])


def backward_fill(value: Column | str, r: WindowSpec, limit: int | None = None) -> Column:
    """The next non-null value; r is the series backwards."""
    return forward_fill(value, r, limit)


def fill_both(value: Column | str, w: WindowSpec, r: WindowSpec) -> Column:
    return F.coalesce(forward_fill(value, w), backward_fill(value, r))


def with_rows(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, name: str = "rn") -> DataFrame:
    """df with the row number of each series, from 1, as a long."""
    return df.withColumn(name, F.row_number().over(series(keys, order)).cast("long"))


def interpolate(value: str, rn: str, w: WindowSpec, r: WindowSpec, empty: float | None = None) -> Column:
    """Linear interpolation by row number, constant beyond both ends; a series without any value is `empty`."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(rn).alias("n"), F.col(value).alias("v")))
    b, f = F.last(known, ignorenulls=True).over(before(w)), backward_fill(known, r)
    span = f["n"] - b["n"]
    between = b["v"] + (f["v"] - b["v"]) * (F.col(rn) - b["n"]) / F.when(span > 0, span)
    return F.coalesce(F.col(value), between, b["v"], f["v"], F.lit(empty).cast("double"))


def centred(w: WindowSpec, width: int) -> WindowSpec:
    """A centred frame of `width` rows; an even one has its odd row before the current row."""
    return w.rowsBetween(-(width // 2), width - 1 - width // 2)


def rolling(value: Column | str, w: WindowSpec, width: int, how: str) -> Column:
    """Centred rolling mean, min, max or median of the non-null values; frames may be cut at the ends."""
    frame = centred(w, width)
    if how == "median":
        return F.percentile(value, F.lit(0.5)).over(frame)
    return {"mean": F.avg, "min": F.min, "max": F.max}[how](value).over(frame)


def binned_mean(value: str, rn: str, keys: Sequence[str], width: int) -> Column:
    """Mean of the non-null values of each chunk of width rows, counted from the first row."""
    return F.avg(value).over(Window.partitionBy(*keys, F.floor((F.col(rn) - 1) / width)))


def rolling_extremes(df: DataFrame, value: str, width: int, low: str, high: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """df with the least and greatest non-null value of a centred frame of width rows, cut at the ends.

    Rows are cut into blocks of the frame's width, with running extremes from both ends of each block. A frame then touches two
    blocks at most: the end of one, from its first row on, and the beginning of the next, up to its last row. The work of a row
    does not depend on the width, and the running windows, over series and block, spread a long series over many tasks.
    """
    ahead = width - 1 - width // 2
    w, all_rows = series(keys, order), whole(keys)
    d = with_rows(df, keys, order, "_rn").withColumn("_block", F.floor((F.col("_rn") - 1) / width))
    block = Window.partitionBy(*keys, "_block")
    ways = {"_up": before(block.orderBy("_rn")), "_down": before(block.orderBy(F.desc("_rn")))}
    for name, way in ways.items():
        d = d.withColumn(name, F.struct(F.min(value).over(way).alias("low"), F.max(value).over(way).alias("high")))
    # A frame that is cut at the end ends with the last row; one that is cut at the beginning lies in the first block.
    d = d.withColumn("_n", F.max("_rn").over(all_rows)).withColumn("_last", F.max(F.when(F.col("_rn") == F.col("_n"), F.col("_up"))).over(all_rows))
    d = d.withColumn("_to", F.coalesce(F.lead("_up", ahead).over(w), "_last") if ahead else F.col("_up"))
    d = d.withColumn("_from", F.lag("_down", width // 2).over(w) if width > 1 else F.col("_down"))
    # One that begins in the last block and is cut is the end of that block alone.
    start = F.col("_rn") - width // 2
    alone = (start >= 1) & (F.col("_rn") + ahead > F.col("_n")) & (F.floor((start - 1) / width) == F.floor((F.col("_n") - 1) / width))
    pick = lambda f, c: f(F.col(f"_from.{c}"), F.when(~alone, F.col(f"_to.{c}")))
    return d.withColumn(low, pick(F.least, "low")).withColumn(high, pick(F.greatest, "high")).drop("_rn", "_block", "_up", "_down", "_n", "_last", "_to", "_from")


def quadratic_smooth(df: DataFrame, value: str, name: str, width: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """df with `name`, the moving least-squares parabola of `width` rows (made odd, at most the series length) at each row.

    Nulls are interpolated first. Rows near an end are read off the parabola of the first or last full frame. Series of
    fewer than three rows keep their values. The fit is in closed form, from the moments of the frame. These are differences
    and sums of running moments of blocks of the frame's width, counted from the block's first row so that no digits are lost;
    the work of a row does not depend on the width.
    """
    width = max(3, width + (width + 1) % 2)
    half = width // 2
    w, all_rows = series(keys, order), whole(keys)
    d = with_rows(df, keys, order, "_rn").withColumn("_n", F.count(F.lit(1)).over(all_rows))
    d = d.withColumn("_y", interpolate(value, "_rn", w, backwards(keys, order)))
    # Half of the frame: that of width, or of the longest odd frame in a shorter series.
    m = F.floor((F.least(F.lit(width), F.col("_n") - (F.col("_n") % 2 == 0).cast("long")) - 1) / 2)
    d = d.withColumn("_m", m).withColumn("_block", F.floor((F.col("_rn") - 1) / width))
    t = (F.col("_rn") - 1 - F.col("_block") * width).cast("double")
    block = Window.partitionBy(*keys, "_block")
    sums = lambda x, way, p: F.sum(F.col("_y") * (x**p if p else F.lit(1.0))).over(way).alias(f"s{p}")
    up, down = before(block.orderBy("_rn")), before(block.orderBy(F.desc("_rn")))
    d = d.withColumn("_up", F.struct(*[sums(t, up, p) for p in range(3)])).withColumn("_down", F.struct(*[sums(t, down, p) for p in range(3)]))
    # The first and the last full frame, about their middle rows.
    for name_, middle, inside in (("_head", F.col("_m") + 1, F.col("_rn") <= 2 * F.col("_m") + 1), ("_tail", F.col("_n") - F.col("_m"), F.col("_rn") >= F.col("_n") - 2 * F.col("_m"))):
        x = (F.col("_rn") - middle).cast("double")
        d = d.withColumn(name_, F.struct(*[F.sum(F.when(inside, F.col("_y") * (x**p if p else F.lit(1.0)))).over(all_rows).alias(f"s{p}") for p in range(3)]))
    d = d.withColumn("_to", F.lead("_up", half).over(w)).withColumn("_from", F.lag("_down", half).over(w))
    first = F.floor((F.col("_rn") - 1 - half) / width) * width + 1  # the first row of the block in which the frame begins
    one = (F.col("_rn") - half) == first  # the frame is that block

    def about(s: str, start: Column, p: int) -> Column:
        """Moments counted from row start, about this row."""
        x = (F.col("_rn") - start).cast("double")
        s0, s1, s2 = (F.col(f"{s}.s{k}") for k in range(3))
        return (s0, s1 - x * s0, s2 - 2 * x * s1 + x * x * s0)[p]

    inner = [F.when(one, about("_to", first, p)).otherwise(about("_from", first, p) + about("_to", first + width, p)) for p in range(3)]
    head, tail = F.col("_rn") <= F.col("_m") + 1, F.col("_rn") >= F.col("_n") - F.col("_m")
    for p in range(3):
        d = d.withColumn(f"_s{p}", F.when(head, F.col(f"_head.s{p}")).when(tail, F.col(f"_tail.s{p}")).otherwise(inner[p]))
    at = F.when(head, F.col("_rn") - F.col("_m") - 1).when(tail, F.col("_rn") - F.col("_n") + F.col("_m")).otherwise(0).cast("double")
    m = F.col("_m").cast("double")
    n, x2 = 2 * m + 1, m * (m + 1) * (2 * m + 1) / 3
    x4 = x2 * (3 * m * m + 3 * m - 1) / 5
    det = n * x4 - x2 * x2
    safe = lambda x: F.when(x != 0, x)
    fit = (x4 * F.col("_s0") - x2 * F.col("_s2")) / safe(det) + F.col("_s1") / safe(x2) * at + (n * F.col("_s2") - x2 * F.col("_s0")) / safe(det) * at * at
    out = F.when((F.col("_n") < 3) | F.col("_y").isNull(), F.col("_y")).otherwise(fit)
    return d.withColumn(name, out).drop("_rn", "_n", "_y", "_m", "_block", "_up", "_down", "_head", "_tail", "_to", "_from", "_s0", "_s1", "_s2")


def smooth(df: DataFrame, value: str, name: str, width: int | None, how: str = "binned", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """df with value smoothed by `binned` or `rolling` means, or by `parabola` (any other name)."""
    if width is None or width <= 1:
        return df.withColumn(name, F.col(value))
    if how == "rolling":
        return df.withColumn(name, rolling(value, series(keys, order), width, "mean"))
    if how == "binned":
        return with_rows(df, keys, order, "_rn").withColumn(name, binned_mean(value, "_rn", keys, width)).drop("_rn")
    return quadratic_smooth(df, value, name, width, keys, order)


def odd(width: int | None, default: int) -> int:
    """A window width as used for smoothing: at least 3, even ones one larger."""
    if width is None:
        return default
    return max(3, width) + (max(3, width) + 1) % 2


def elapsed_s(ts: str, keys: Sequence[str] = KEYS) -> Column:
    """Seconds since the first row of the series."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return (t - F.min(t).over(whole(keys))) / F.lit(1e6)


def share_in_phase(df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = KEYS, least_s: float = 30.0) -> DataFrame:
    """df with phi, the position in time within the row's phase, 0 to 1; null for phases of least_s seconds or less."""
    w = Window.partitionBy(*keys, "phase")
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    span = (F.max(t).over(w) - F.min(t).over(w)) / F.lit(1e6)
    return df.withColumn("phi", F.when(span > least_s, (t - F.min(t).over(w)) / F.lit(1e6) / span))


def first_row(df: DataFrame, predicate: Column, rn: str = "rn", keys: Sequence[str] = KEYS) -> Column:
    """Row number of the first row of the series for which predicate holds; null if there is none."""
    return F.min(F.when(predicate, F.col(rn))).over(whole(keys))


#: Changes of a chunk and of a piece of a fold.
CHUNK, PIECE = 256, 65_536


def plateaus(df: DataFrame, value: str, tol: float, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, piece: int = PIECE, rows: int = 0) -> DataFrame:
    """df with rn, plateau_start (row number) and plateau_value of each non-null row. A plateau is a run of non-null rows
    within tol of its first value.

    Whether a row begins a plateau depends on the first value of the plateau before it. But a row after a null, or more than
    twice tol from the row before, begins one whatever that value was, so a series falls into stretches that know nothing of
    each other. Their changes are folded in pieces of at most `piece` changes, side by side, each as though it began a plateau.
    Pieces that go on with a plateau of the piece before are folded again from its first value, until none is left. As two folds
    are one from the first start they share, that is mostly one round; a stretch in which they never meet (a slow ramp) takes
    one for each piece. The changes are written to the shared folder; df is read twice, so a costly one should be written first.
    rows is the number that df is dealt() by, if it is; changes are dealt by it too, and starts are then laid between the rows.
    """
    from contrail.sources.tables import settle  # it imports this module

    w = series(keys, order)
    d = with_rows(df, keys, order)
    v, last = F.col(value).cast("double"), F.lag(F.col(value).cast("double")).over(w)
    # A little more than twice, as differences are rounded.
    apart = last.isNull() | v.isNull() | (F.abs(v - last) > 2.000001 * tol)
    marked = d.select(*keys, *[c for c in order if c not in keys], "rn", v.alias("v"), (~v.eqNullSafe(last) | (F.col("rn") == 1)).alias("_changed"), apart.alias("_apart"))
    marked = marked.withColumn("_n", F.sum(F.col("_changed").cast("long")).over(before(w))).withColumn("_head", F.last(F.when(F.col("_changed") & F.col("_apart"), F.col("_n")), ignorenulls=True).over(before(w)))
    ids = [*keys, "_head", "_piece"]
    changes = settle(marked.filter(F.col("_changed") & F.col("v").isNotNull()).select(*keys, "_head", F.floor((F.col("_n") - F.col("_head")) / piece).alias("_piece"), "rn", "v"))
    # All joins are merged: written tables of series are tiny as files, so Spark would take their millions of rows through the driver.
    blocks = dealt(changes, rows, ids).groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("rn", "v"))).alias("_runs"))

    def folded(came: Column) -> Column:
        """Struct of the starts of a piece and the first value of its last plateau, if it goes on with a plateau that began with came."""
        runs = "array<struct<rn:bigint,v:double>>"
        none = F.array().cast(runs)

        def step(a: Column, x: Column) -> Column:
            begins = a["anchor"].isNull() | (F.abs(x["v"] - a["anchor"]) > tol)
            return F.when(begins, F.struct(x["v"].alias("anchor"), F.concat(a["starts"], F.array(x)).alias("starts"))).otherwise(a)

        def part(a: Column, i: Column) -> Column:
            # Each step copies the starts so far, so these are kept apart for a chunk of changes.
            here = F.aggregate(F.slice("_runs", i * CHUNK + 1, CHUNK), F.struct(a["anchor"].alias("anchor"), none.alias("starts")), step)
            return F.transform(F.array(here), lambda r: F.struct(r["anchor"].alias("anchor"), F.concat(a["starts"], r["starts"]).alias("starts")))[0]

        chunks = F.sequence(F.lit(0), F.floor((F.size("_runs") - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(came.cast("double").alias("anchor"), none.alias("starts")), part)

    several = changes.filter("_piece > 0").select(*keys, "_head").distinct().hint("merge")
    if several.isEmpty():
        blocks = blocks.withColumn("_came", F.lit(None).cast("double"))
    else:
        blocks = settle(blocks)
        # One row for each piece of longer stretches: the value it was folded from and the one it leaves.
        state = settle(blocks.join(several, [*keys, "_head"], "left_semi").select(*ids, F.lit(None).cast("double").alias("_came"), folded(F.lit(None))["anchor"].alias("_left")))
        while True:
            due = state.withColumn("_due", F.lag("_left").over(series([*keys, "_head"], ["_piece"]))).filter(~F.col("_came").eqNullSafe(F.col("_due")))
            due = settle(due.select(*ids, "_due"))
            if due.isEmpty():
                break
            again = blocks.join(due.hint("merge"), ids).select(*ids, F.col("_due").alias("_came"), folded(F.col("_due"))["anchor"].alias("_left"))
            state = settle(state.join(due.hint("merge"), ids, "left_anti").unionByName(again))
        blocks = blocks.join(state.drop("_left").hint("merge"), ids, "left")
    starts = blocks.select(*keys, F.explode(folded(F.col("_came"))["starts"]).alias("s")).select(*keys, F.col("s.rn").alias("rn"), F.struct("s.rn", "s.v").alias("_start"))
    if rows < DEALT_FROM:
        d = d.join(starts.hint("merge"), [*keys, "rn"], "left")
        d = d.withColumn("_held", F.last("_start", ignorenulls=True).over(before(w))).drop("_start")
    else:
        # A join by place would shuffle all rows by it, and once more by series.
        d = laid(d, {"_held": starts.withColumnRenamed("_start", "_held")}, "rn", keys, rows)
    known = F.col(value).isNotNull()
    return d.withColumn("plateau_start", F.when(known, F.col("_held.rn"))).withColumn("plateau_value", F.when(known, F.col("_held.v"))).drop("_held")


def fill_rate(
    df: DataFrame, value: str, name: str, bridge: bool = True, hold_rows: int | None = 120, fill: bool = True, ramp_rows: int = 1, tol: float = 50.0,
    keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int = 0,
) -> DataFrame:
    """df with gaps of a commanded rate filled: linearly between the first values of the plateaus around a gap (one step
    per row), then gaps of up to hold_rows rows by the value before them, then by the last and next value. With ramp_rows
    over 1, adjoining plateaus are joined by a ramp of so many rows. A series without values stays null. rows is that of plateaus."""
    w, r = series(keys, order), backwards(keys, order)
    # Only bridges and ramps go by plateaus.
    d = plateaus(df, value, tol, keys, order, rows=rows) if bridge or ramp_rows > 1 else with_rows(df, keys, order)
    out = F.col(value).cast("double")
    if bridge:
        mark = F.when(F.col("plateau_start").isNotNull(), F.struct("rn", F.col("plateau_value").alias("v")))
        d = d.withColumn("_b", F.last(mark, ignorenulls=True).over(before(w))).withColumn("_f", backward_fill(mark, r))
        gap = F.col("_f.rn") - F.col("_b.rn") - 1
        steps = F.col("rn") - F.col("_b.rn")
        out = F.coalesce(out, F.col("_b.v") + steps / (gap + 1) * (F.col("_f.v") - F.col("_b.v")))
    d = d.withColumn("_o", out)
    if hold_rows:
        known = F.when(F.col("_o").isNotNull(), F.col("rn"))
        start, stop = F.last(known, ignorenulls=True).over(before(w)), F.coalesce(backward_fill(known, r), F.max("rn").over(whole(keys)) + 1)
        d = d.withColumn("_o", F.coalesce("_o", F.when(stop - start - 1 <= hold_rows, F.last("_o", ignorenulls=True).over(before(w)))))
    if fill:
        d = d.withColumn("_o", fill_both("_o", w, r))
    if ramp_rows > 1:
        # The plateau just before this one, if it ends in the row before.
        previous = F.when(F.col("plateau_start") == F.col("rn"), F.struct(F.col("rn").alias("at"), F.lag("plateau_value").over(w).alias("v")))
        d = d.withColumn("_p", F.last(previous, ignorenulls=True).over(before(w, ramp_rows - 1)))
        along = F.col("rn") - F.col("_p.at")
        ramp = F.col("_p.v") + (along + 1) / F.lit(ramp_rows) * (F.col("plateau_value") - F.col("_p.v"))
        d = d.withColumn("_o", F.when(F.col("_p.v").isNotNull() & (F.col("_p.at") == F.col("plateau_start")) & (F.abs(F.col("plateau_value") - F.col("_p.v")) > tol), ramp).otherwise(F.col("_o"))).drop("_p")
    return d.withColumn(name, F.col("_o")).drop("_o", "_b", "_f", "rn", "plateau_start", "plateau_value")


#: Ranges in which the rows of one group are ordered side by side.
RANGES = 64


def value_range(df: DataFrame, value: str, of: str | None = None, ranges: int = RANGES) -> Column:
    """The range of column `of` (value if not given), an int that rises with it, cut at approximate quantiles of value over all of df (which are all the
    driver sees); 0 for nulls. With it a running value over one large group is a window in each range and what the ranges before
    give, so no task orders the whole group."""
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    v = F.col(of or value).cast("double")

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < cuts[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    return F.when(v.isNull(), F.lit(0)).otherwise(place(0, len(cuts)))


def with_totals_before(df: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """df, whose column `_r` is its range, with for each name: column of sums the sum of the column over the ranges of the
    group before its own, and as name_all over the whole group."""
    each = df.groupBy(*keys, "_r").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # A group has as many rows here as there are ranges.
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    run = w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*keys, "_r", *[F.coalesce(F.sum(n).over(run), F.lit(0)).alias(n) for n in sums], *[F.sum(n).over(w).alias(f"{n}_all") for n in sums])
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = F.col("l._r") == F.col("r._r")
    for c in same:
        on = on & c
    return df.alias("l").join(each.alias("r"), on).select("l.*", *[f"r.{n}" for n in sums], *[f"r.{n}_all" for n in sums])


def empirical_cdf(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, value, cdf) at the distinct values of each group. Values are counted first and ordered in ranges."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    d = with_totals_before(counted.withColumn("_r", value_range(df, value)), keys, {"_n": "_k"})
    run = before(Window.partitionBy(*keys, "_r").orderBy(value))
    return d.select(*keys, value, ((F.col("_n") + F.sum("_k").over(run)) / F.col("_n_all")).alias("cdf"))


#: Ranges of a doubling of the value, and a number above those of the smallest double's distance from 1.
OCTAVE, SHIFT = 4096, 5_000_000


def magnitude(value: Column) -> Column:
    """An int that rises with a double: its sign, and its logarithm in steps of 0.02 %. It needs no look at the data, and few distinct
    values share one unless all of them lie within such a step."""
    size = F.floor(F.log2(F.abs(value)) * OCTAVE) + SHIFT
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def quantiles(df: DataFrame, value: str, keys: Sequence[str], probabilities: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name, count): the exact quantiles of the non-null values of each group, an array in the order of probabilities,
    interpolated linearly between ranks; groups without values are left out (without keys, one row of nulls). Values are counted first and ranked in ranges, so a
    few large groups spread over all tasks; for many small groups F.percentile is the shorter way."""
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"))
    counted = counted.withColumn("_r", magnitude(F.col("_v")))
    asked, last = F.array(*[F.lit(float(x)) for x in probabilities]), F.col("_n_all") - 1
    # Ranks count from 0. First the ranges that hold a rank that is asked for, two for each probability at most, then the values there.
    holds = lambda start, stop: F.exists(asked, lambda x: ((F.floor(x * last) >= start) & (F.floor(x * last) < stop)) | ((F.ceil(x * last) >= start) & (F.ceil(x * last) < stop)))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    each = counted.groupBy(*keys, "_r").agg(F.sum("_k").alias("_s"))
    each = each.withColumn("_to", F.sum("_s").over(before(w.orderBy("_r")))).withColumn("_n_all", F.sum("_s").over(w)).filter(holds(F.col("_to") - F.col("_s"), F.col("_to")))
    on = F.col("l._r") == F.col("r._r")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    ranged = counted.alias("l").join(each.alias("r"), on).select("l.*", (F.col("r._to") - F.col("r._s")).alias("_n"), "r._n_all")
    ranged = ranged.withColumn("_stop", F.col("_n") + F.sum("_k").over(before(Window.partitionBy(*keys, "_r").orderBy("_v"))))
    kept = ranged.filter(holds(F.col("_stop") - F.col("_k"), F.col("_stop")))
    g = kept.groupBy(*keys).agg(F.max("_n_all").alias("count"), F.sort_array(F.collect_list(F.struct("_stop", "_v"))).alias("_held"))
    at = lambda rank: F.filter("_held", lambda h: h["_stop"] > rank)[0]["_v"]
    place = lambda x: x * (F.col("count") - 1)
    lo, hi = (lambda x: F.floor(place(x))), (lambda x: F.ceil(place(x)))
    q = F.transform(asked, lambda x: F.when(lo(x) == hi(x), at(lo(x))).otherwise((hi(x) - place(x)) * at(lo(x)) + (place(x) - lo(x)) * at(hi(x))))
    return g.select(*keys, F.when(F.col("count").isNotNull(), q).alias(name), "count")
