"""Connected components over edge tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import materialize


def _roots(up: DataFrame) -> DataFrame:
    """(node, up) with up followed to its end, twice as far each time: chains of n steps take log2(n) + 1 tables."""
    while True:
        step = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up")
        step = materialize(step.select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        up = step.select("node", "up")
        if step.where("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); component is the smallest node reachable.

    Each round every node points to its smallest neighbour (a map-side combined minimum, so hubs don't gather) and
    pointers are followed to their ends, which are smaller than their neighbours; edges move to those ends and
    repeated ones go. At least half of the nodes of a component go in a round, so rounds are logarithmic in it, for
    paths and chains too; they end when no edge is left. Every step is written to the shared folder. The joins are
    plain equi joins of written tables, so that adaptive execution can split hot keys. Self loops and null ends are
    ignored; no edges give no rows."""
    live = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    live = materialize(live.distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _roots(materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))))
        moved = (
            live.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
            .where(F.col("ua") != F.col("ub"))
            .select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b"))
        )
        live = materialize(moved.distinct())
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "up")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
