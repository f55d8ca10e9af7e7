"""Values for synthetic flights, drawn for a whole table of requests at once from the pools of fitted laws.

A request asks for rows of a pool that match it in some columns, taken one after another; a column that would leave fewer than a
number of rows is passed over. The rows of the pool are counted in every cell that some of the columns form, a cube; the choice for
a request is then a look-up of one count for each column, and the drawn row is the one of its rank in the chosen cell. All of it is
grouping and joins, so requests and pools may both be large; the cell of all rows is ranked in ranges of its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.aero import clip
from contrail.functions.bins import CAS_STEP_KT, HEIGHT_STEP_FT, MACH_STEP, PHI_STEP, to_step
from contrail.operators.series import KEYS, quantiles
from contrail.plans.laws import LEAST_POOL, draw
from contrail.sources import tables

# Defaults of the shares of the way, and limits of airspeeds at the start of a climb.
PHI_UP, PHI_DOWN_LATER, START_CAS_KT = 0.18, 0.05, (130.0, 340.0)
LAWS = ("phi_d", "start_cas_kt", "n_mach", "phi_up", "mach_level", "phi_dn")


def _text(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c if df.schema[name].dataType.typeName() == "string" else (c.cast("double") + F.lit(0.0)).cast("string")


def _cell(trial: int, mask: Column, columns: Sequence[Column]) -> Column:
    """Name of the cell of the columns whose bits are set in mask."""
    parts = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, c).otherwise("") for i, c in enumerate(columns)]
    return F.concat_ws("|", F.lit(trial), mask.cast("string"), *parts)


def cells(library: DataFrame, trial: int, columns: Sequence[str], must: bool = False) -> DataFrame:
    """library once for each cell it is in (_cell): one for each set of columns that are known in the row, or with must only
    that of all columns."""
    texts = [_text(library, c) for c in columns]
    every = (1 << len(columns)) - 1
    masks = [every] if must else range(every + 1)
    known = lambda m: reduce(Column.__and__, [t.isNotNull() for i, t in enumerate(texts) if m >> i & 1], F.lit(True))
    made = F.array(*[F.when(known(m), _cell(trial, F.lit(m), texts)) for m in masks])
    return library.select("*", F.explode(made).alias("_cell")).filter(F.col("_cell").isNotNull())


def narrowed(requests: DataFrame, library: DataFrame, trial: int, columns: Sequence[str], least: int, must: bool = False) -> DataFrame:
    """requests with _cell_<trial>: the cell of library that is left when columns are taken in order, each only if it is known
    in the request and leaves at least `least` rows. With must all have to be, or there is no cell (null)."""
    name = f"_cell_{trial}"
    texts = [_text(requests, c) for c in columns]
    if must:
        return requests.withColumn(name, F.when(reduce(Column.__and__, [t.isNotNull() for t in texts], F.lit(True)), _cell(trial, F.lit((1 << len(columns)) - 1), texts)))
    d = requests.withColumn("_mask", F.lit(0))
    if columns:
        counts = tables.settle(cells(library, trial, columns).groupBy("_cell").count())
        for i, t in enumerate(texts):
            wider = F.col("_mask").bitwiseOR(F.lit(1 << i))
            d = d.withColumn("_try", F.when(t.isNotNull(), _cell(trial, wider, texts)))
            d = d.join(counts.withColumnsRenamed({"_cell": "_try", "count": "_n"}), "_try", "left")
            d = d.withColumn("_mask", F.when(F.col("_n") >= least, wider).otherwise(F.col("_mask"))).drop("_try", "_n")
    return d.withColumn(name, _cell(trial, F.col("_mask"), texts)).drop("_mask")


def draw_narrowed(
    requests: DataFrame, library: DataFrame, value: str, trials: Sequence[Sequence[str]], law: int, name: str, default: Column | None = None, least: int = LEAST_POOL, must: bool = False, order: Sequence[str] = KEYS,
) -> DataFrame:
    """requests with `name`, drawn by laws.draw from the known values in the cell of the first of trials that has any. A trial
    is a list of columns of both tables; () is all of library. Without any value it is default, or null."""
    pools, d = [], requests
    for j, columns in enumerate(trials):
        forced = must and bool(columns)
        d = narrowed(d, library, j, columns, least, forced)
        pools.append(cells(library.filter(F.col(value).isNotNull()), j, columns, forced).select("_cell", F.col(value).alias("_value"), *order))
    pool = tables.settle(reduce(DataFrame.unionByName, pools))
    sizes = tables.settle(pool.groupBy("_cell").count())
    for j in range(len(trials)):
        d = d.join(sizes.select(F.col("_cell").alias(f"_cell_{j}"), F.col("count").alias(f"_n_{j}")), f"_cell_{j}", "left")
    d = d.withColumn("_cell", F.coalesce(*[F.when(F.col(f"_n_{j}") > 0, F.col(f"_cell_{j}")) for j in range(len(trials))]))
    d = tables.settle(d.select(*requests.columns, "_cell"))
    asked = pool.join(d.select("_cell").distinct(), "_cell", "left_semi")
    return draw(d, asked, "_value", ["_cell"], order, law, name, default).drop("_cell")


def draw_contexts(requests: DataFrame, anchors: DataFrame, descents: DataFrame, level: DataFrame, starts: DataFrame, transitions: DataFrame, least: int = LEAST_POOL) -> DataFrame:
    """requests(gc_bin, family, h_pre_max, cas_pre_last, seed, draw_id, and any others) with six values, later ones from earlier
    ones:

    phi_d         share of the way at the top of descent, of the distance bin, or of all; one that requests has is kept
    start_cas_kt  airspeed at the start of the climb, of distance bin and family; else the median of what transitions begin with
    n_mach        number of Mach plateaus, by distance bin and height selected before them; at least 1
    phi_up        share of the way at the first of them, by distance bin, height and airspeed selected before; else 0.18
    mach_level    Mach number in level flight, of the distance bin
    phi_dn        share of the way at the first airspeed after them, by distance bin, phi_d, mach_level and n_mach, then by
                  distance bin and phi_d, then of all; else 0.05 after phi_d

    Null where there is nothing to draw from. The libraries are those of laws.mach_anchors, descent_phi, level_mach,
    starts_and_counts and transition_library. Each step is written to the shared folder."""
    law = {name: i + 1 for i, name in enumerate(LAWS)}
    d = requests.withColumns({"h_pre_bin": to_step("h_pre_max", HEIGHT_STEP_FT), "cas_pre_bin": to_step("cas_pre_last", CAS_STEP_KT)})
    given = F.col("_given") if "phi_d" in requests.columns else F.lit(None).cast("double")
    if "phi_d" in requests.columns:
        d = d.withColumnRenamed("phi_d", "_given")
    d = draw_narrowed(d, descents, "phi_d", (("gc_bin",), ()), law["phi_d"], "_phi_d", least=1)
    d = d.withColumn("phi_d", F.coalesce(given, "_phi_d")).drop("_given", "_phi_d")

    climb = starts.filter(F.upper("phase") == "CLIMB")
    d = draw_narrowed(d, climb, "start_bin", (("gc_bin", "family"),), law["start_cas_kt"], "_start", must=True)
    begins = quantiles(transitions.filter(F.upper("phase") == "CLIMB"), "cas_prev_bin", [], (0.5,)).select(F.col("q")[0].alias("_median"))
    d = d.join(F.broadcast(begins)).withColumn("start_cas_kt", clip(F.coalesce("_start", "_median"), *START_CAS_KT)).drop("_start", "_median")

    d = draw_narrowed(d, anchors, "n_mach", (("gc_bin", "h_pre_bin"),), law["n_mach"], "_n_mach", least=least)
    d = d.withColumn("n_mach", F.greatest(F.coalesce(F.col("_n_mach"), F.lit(1)), F.lit(1)).cast("long")).drop("_n_mach")
    d = draw_narrowed(d, anchors, "phi_up", (("gc_bin", "h_pre_bin", "cas_pre_bin"), ()), law["phi_up"], "phi_up", F.lit(PHI_UP), least=least)
    d = draw_narrowed(d, level, "mach_bin", (("gc_bin",),), law["mach_level"], "mach_level", must=True)
    d = d.withColumns({"phi_tod_bin": to_step("phi_d", PHI_STEP), "mach_bin": to_step("mach_level", MACH_STEP)})
    later = clip(F.col("phi_d") + PHI_DOWN_LATER, 0.0, 1.0)
    d = draw_narrowed(d, anchors, "phi_dn", (("gc_bin", "phi_tod_bin", "mach_bin", "n_mach"), ("gc_bin", "phi_tod_bin"), ()), law["phi_dn"], "phi_dn", later, least=least)
    return d.select(*[c for c in requests.columns if c not in LAWS], *LAWS)
