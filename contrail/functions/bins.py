"""Binning of values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the conditional distribution tables.
PHI_STEP, RATE_STEP_FPM, HEIGHT_STEP_FT, CAS_STEP_KT, MACH_STEP = 0.02, 100.0, 500.0, 5.0, 0.01
PHI_BINS, PLATEAU_BINS, LEAST_SEGMENT_S = 20, 10, 3.0

# Aircraft families by type code.
FAMILIES = {
    "A320 family": ["A319", "A320", "A321", "A20N", "A21N"],
    "A220": ["BCS1", "BCS3"],
    "B737": ["B738", "B737", "B739"],
    "E-Jet": ["E190", "E195", "E290", "E295", "E75L"],
}
OTHER_FAMILY = "Other"


def to_step(value: Column | str, step: float) -> Column:
    """value rounded half-to-even to a multiple of step."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rint(value / F.lit(step)) * F.lit(step)


def phi_bin(phi: Column | str, bins: int = PHI_BINS, closed: str = "right") -> Column:
    """Bin number of a share in [0, 1]: right-closed bins with 0 in the first, or left-closed ones with 1 in the last. The
    edges are the doubles i / bins; null outside [0, 1]."""
    phi = F.col(phi) if isinstance(phi, str) else phi
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    out = F.when((phi < 0) | (phi > 1), F.lit(None))
    for i in range(bins):
        inside = (phi <= edges[i + 1]) if closed == "right" else ((phi < edges[i + 1]) if i < bins - 1 else phi.isNotNull())
        out = out.when(inside, F.lit(i))
    return out.cast("int")


def plateau_bin(u: Column | str, bins: int = PLATEAU_BINS) -> Column:
    """Bin of a position within a plateau, 0 to bins - 1."""
    u = F.col(u) if isinstance(u, str) else u
    return F.floor(F.least(F.greatest(u, F.lit(0.0)), F.lit(0.999)) * bins).cast("int")


def distance_bin(value: Column | str, edges: list[float]) -> Column:
    """Left-closed bin among edges, clamped to the first and last bin."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.when(value.isNull(), F.lit(None))
    for i in range(len(edges) - 2):
        out = out.when(value < edges[i + 1], F.lit(i))
    return out.otherwise(F.lit(len(edges) - 2)).cast("int")


def distance_label(value: Column | str, edges: list[float]) -> Column:
    """`lo–hi nm` of the value's distance bin."""
    at = distance_bin(value, edges)
    labels = F.array(*[F.lit(f"{lo:g}–{hi:g} nm") for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
    return F.get(labels, at)


def family(typecode: Column | str) -> Column:
    """Aircraft family of a type code; unknown and null codes are `Other`."""
    code = F.upper(F.trim(F.col(typecode) if isinstance(typecode, str) else typecode))
    out = F.when(code.isNull(), OTHER_FAMILY)
    for name, codes in FAMILIES.items():
        out = out.when(code.isin(codes), name)
    return out.otherwise(OTHER_FAMILY)
