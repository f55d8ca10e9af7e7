"""Fitting of all conditional tables in one go, over the flights of any number of routes, with or without conditioning."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.operators.series import KEYS
from contrail.plans import laws
from contrail.sources import tables

PHASES = ("CLIMB", "DESCENT")


@dataclass(frozen=True)
class Laws:
    """edges: one row with the edges of the distance bins. tables: the six of laws.phase_laws, by distance bin, family and phase.
    anchors, level_mach and descents: of Mach plateaus and tops of descent. rates and transitions: of all flights, whatever the
    conditioning."""

    edges: DataFrame
    tables: Mapping[str, DataFrame]
    anchors: DataFrame
    level_mach: DataFrame
    descents: DataFrame
    rates: DataFrame
    transitions: DataFrame


def with_distance_bin(df: DataFrame, edges: DataFrame) -> DataFrame:
    """df with gc_bin, the left-closed bin of gc_nm among the edges, clamped to the first and last; null lengths have none."""
    inner = F.slice("edges", 2, F.size("edges") - 2)
    return df.drop("gc_bin").join(F.broadcast(edges.select("edges"))).withColumn("gc_bin", F.when(F.col("gc_nm").isNotNull(), F.size(F.filter(inner, lambda e: F.col("gc_nm") >= e)))).drop("edges")


def fit_laws(events: DataFrame, df: DataFrame, meta: DataFrame, lengths: DataFrame, ends: DataFrame, tod: DataFrame, flights: DataFrame | None = None) -> Laws:
    """Laws of the events of the flights given (as from laws.condition; None, or none at all, is every flight). df is the
    grid with phases and commands, meta the flights' metadata, lengths and ends the routes' lengths and destinations, and tod the
    tops of descent. Edges are the tertiles of lengths.

    The events get their phases once and are written to the shared folder with what else every table needs; conditioned tables
    take those of the flights from there."""
    edges = tables.settle(laws.distance_edge_table(lengths))
    every = tables.settle(laws.with_phase(events, df))
    windows = tables.settle(laws.phase_windows(df))
    place, reach = tables.settle(with_distance_bin(meta, edges)), tables.settle(with_distance_bin(lengths, edges))
    chosen = every if flights is None or flights.isEmpty() else every.join(flights.select(*KEYS).distinct(), list(KEYS), "left_semi")
    found = laws.phase_laws(chosen, df, place, None, windows)
    both = [laws.transition_library(every, df, meta.select(*KEYS), phase) for phase in PHASES]
    return Laws(
        edges, found, laws.mach_anchors(chosen, df, ends, tod, reach, None), laws.level_mach(chosen, reach, None), laws.descent_phi(tod, reach, None),
        laws.event_library(every), both[0].unionByName(both[1]),
    )
