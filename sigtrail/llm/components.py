"""Connected components of a link table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.llm.scratch import drop, staged


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Every round a node takes the smallest label among its own, its neighbours' and its
    label's label; the last doubles the reach, so rounds grow with the logarithm of the
    longest path.  Labels are aggregated before they are shuffled, so a node with very
    many links costs one row per task.  Unlinked nodes are not in the result; loops and
    null ends are ignored.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = staged(ends.union(ends.select("y", "x")).distinct())
    labels = staged(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = edges.join(labels, edges.y == labels.node).select(edges.x.alias("node"), "component")
        best = near.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("best"))
        up = labels.select(F.col("node").alias("best"), F.col("component").alias("next"))
        step = labels.join(best, "node").join(up, "best", "left")
        new = staged(step.select("node", F.least("best", F.coalesce("next", "best")).alias("component"), (F.col("component") > F.least("best", F.coalesce("next", "best"))).alias("moved")))
        moved = new.where("moved").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            drop(edges)
            return labels.select("node", "component")
