"""Connected components of a large edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm._spark import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), component being the smallest node that can be reached.

    Each round points every node at its smallest neighbour (pointers only go down, so they form trees), follows the
    pointer once more, and replaces the edges by those between the pointed-at nodes. Edges shrink by at least half of
    the nodes that are not yet roots; nothing is gathered outside Spark, and each round is written to the shared
    checkpoint folder.
    """
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    live = settle(live)
    label = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        parent = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("up"))
        parent = settle(parent)
        high = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = settle(parent.join(high, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
        if label is None:
            label = parent.select("node", F.col("up").alias("component"))
        else:
            over = parent.select(F.col("node").alias("component"), "up")
            label = settle(label.join(over, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        pa, pb = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        live = settle(live.join(pa, "a").join(pb, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).filter("a < b").distinct())
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
