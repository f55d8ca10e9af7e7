"""Gaps and islands: runs of rows that belong together, as segments and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from contrail.functions.bins import to_step
from contrail.operators.series import KEYS, ORDER, before, laid, rolling_extremes, series, smooth, with_rows

# Steps of the commands whose plateaus become events.
EVENT_STEPS = {"mach_sel": 0.01, "cas_sel": 5.0, "vz_sel": 50.0, "h_sel": 100.0, "selected_mcp": 25.0}


def _steps(value: Column, step: Column, w: WindowSpec) -> tuple[Column, Column, Column]:
    """The value in steps, that of the row before, and the step."""
    q = F.when(step > 0, F.rint(value / step) * step).otherwise(value.cast("double"))
    return q, F.lag(q).over(w), step


def _begins(q: Column, last: Column, step: Column) -> Column:
    """1 where an island begins, else 0."""
    jump = F.abs(q - last) > F.greatest(step, F.lit(1e-9))
    return F.when(q.isNotNull() & F.coalesce(jump, F.lit(True)), 1).otherwise(0)


def value_islands(df: DataFrame, value: str, step: Column | float, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """The non-null rows of df with `island`, counting runs in which the value, in steps, differs from the row before by one
    step at most. A null row ends a run. With step 0 values are taken as they are."""
    step = F.lit(step) if not isinstance(step, Column) else step
    w = series(keys, order)
    q, last, step = _steps(F.col(value), step, w)
    d = df.withColumn("_q", q).withColumn("_new", _begins(q, last, step))
    return d.withColumn("island", F.sum("_new").over(before(w))).filter(F.col("_q").isNotNull()).drop("_q", "_new")


def segments(df: DataFrame, value: str, by: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """One row per island: start, end, duration in seconds, and mean of the value as it was."""
    start, end = F.min(ts), F.max(ts)
    length = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
    return df.groupBy(*by, "island").agg(start.alias("start_timestamp"), end.alias("end_timestamp"), length.alias("duration_s"), F.avg(value).alias("value"))


def command_events(df: DataFrame, steps: Mapping[str, float] = EVENT_STEPS, keys: Sequence[str] = KEYS, ts: str = "timestamp") -> DataFrame:
    """Events of all commands: (keys, command, start_timestamp, end_timestamp, duration_s, value), one per plateau. Islands of
    all commands are counted side by side over the rows of df, which are unpivoted after that, so that they are shuffled once and
    not once a command; columns that df lacks have no events."""
    have = [c for c in steps if c in df.columns]
    w = series(keys, [ts])
    d = df.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in have])
    new = {f"_new_{c}": _begins(*_steps(F.col(c), F.lit(float(steps[c])), w)) for c in have}
    d = d.withColumns(new).withColumns({f"_island_{c}": F.sum(f"_new_{c}").over(before(w)) for c in have})
    each = [F.struct(F.lit(c).alias("command"), F.col(c).alias("value"), F.col(f"_island_{c}").alias("island")) for c in have]
    long = d.select(*keys, ts, F.explode(F.array(*each)).alias("x")).select(*keys, ts, "x.*").filter("value is not null")
    return segments(long, "value", [*keys, "command"], ts).drop("island")


def stable_segments(
    df: DataFrame, value: str, tol: float, min_len: int, altitude: str | None = None, above_ft: float | None = None, min_abs: float | None = None, width: int | None = None, how: str = "binned",
    keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, time: str = "time",
) -> DataFrame:
    """Segments of at least min_len rows in which the smoothed value spreads by less than tol over min_len centred rows:
    (keys, segment, start_row, end_row, start_time, end_time, var_mean, alt_mean). Rows are numbered from 1. The value
    itself must be known; above_ft asks for a greater altitude, min_abs for a greater smoothed magnitude. The first row is
    never stable."""
    d = rolling_extremes(smooth(df, value, "_s", width, how, keys, order), "_s", min_len, "_low", "_high", keys, order)
    d = with_rows(d, keys, order)
    good = (F.col("rn") > 1) & (F.col("_high") - F.col("_low") < tol) & F.col(value).isNotNull()
    if above_ft is not None:
        good = good & (F.col(altitude) > above_ft)
    if min_abs is not None:
        good = good & (F.abs("_s") > min_abs)
    d = d.withColumn("_good", F.coalesce(good, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*keys, "_good").orderBy(*order))
    d = d.withColumn("_island", F.when(F.col("_good"), F.col("rn") - place)).filter("_good")
    alt = F.avg(altitude) if altitude else F.lit(None).cast("double")
    out = d.groupBy(*keys, "_island").agg(F.min("rn").alias("start_row"), F.max("rn").alias("end_row"), F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.avg(value).alias("var_mean"), alt.alias("alt_mean"), F.count(F.lit(1)).alias("_len"))
    return out.filter(F.col("_len") >= min_len).drop("_island", "_len")


def merge_blocks(found: DataFrame, bridge: float, start: str = "start_time", end: str = "end_time", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, block_start, block_end): intervals joined where the next starts no more than bridge after all before it end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = found.withColumn("_new", F.when(reach.isNull() | (F.col(start) - reach > bridge), 1).otherwise(0))
    d = d.withColumn("_block", F.sum("_new").over(before(w)))
    return d.groupBy(*keys, "_block").agg(F.min(start).alias("block_start"), F.max(end).alias("block_end")).drop("_block")


def with_block(df: DataFrame, at: str, blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows of df within a block of merge_blocks, with block_start and block_end. Blocks of a series do not overlap, so the last
    one that starts at or before a row is the only one that can hold it."""
    starts = blocks.select(*keys, F.col("block_start").alias(at), F.struct("block_start", "block_end").alias("_block"))
    both = df.select(*keys, at, F.struct(*df.columns).alias("_row")).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, F.col("_row").isNotNull())
    held = both.withColumn("_block", F.last("_block", ignorenulls=True).over(before(w))).filter(F.col("_row").isNotNull() & (F.col(at) <= F.col("_block.block_end")))
    return held.select("_row.*", "_block.block_start", "_block.block_end")


def paint(df: DataFrame, found: DataFrame, name: str, value: str = "var_mean", rn: str = "rn", keys: Sequence[str] = KEYS, rows: int = 0) -> DataFrame:
    """df with `name`, the value of the segment that holds the row, else null. Segments of a series do not overlap, so each
    is laid on its first row and carried to its last. rows is the number that df is dealt() by, if it is."""
    return paint_all(df, {name: (found, value)}, rn, keys, rows)


def paint_all(df: DataFrame, found: Mapping[str, tuple[DataFrame, str]], rn: str = "rn", keys: Sequence[str] = KEYS, rows: int = 0) -> DataFrame:
    """df with each name of found, (segments, value), painted in one pass over the rows."""
    starts = {f"_seg_{n}": f.select(*keys, F.col("start_row").alias(rn), F.struct(F.col("end_row").alias("to"), F.col(v).alias("v")).alias(f"_seg_{n}")) for n, (f, v) in found.items()}
    d = laid(df, starts, rn, keys, rows)
    return d.withColumns({n: F.when(F.col(f"_seg_{n}.to") >= F.col(rn), F.col(f"_seg_{n}.v")) for n in found}).drop(*starts)


def quantised(df: DataFrame, steps: Mapping[str, float]) -> DataFrame:
    """df with columns rounded to their steps."""
    return df.withColumns({c: to_step(c, s) for c, s in steps.items() if c in df.columns})
