"""Connected components of an edge table, by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, spread_join, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b.  Returns node, label: the least node of its component.  No edges: no rows.

    Each step joins edges with the labels of their far ends, takes the least per node, and jumps to the label's own label.
    Nothing is gathered by component: nodes of many edges and labels of many nodes are joined by broadcast."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    hubs = frequent(both, "b")
    while True:
        far = labels.select(F.col("node").alias("b"), "label")
        near = spread_join(both, far, "b", hot=hubs).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        step = stored(step)
        tops = step.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        step = spread_join(step, stored(tops.where("far < label").select("label", "far")), "label", "left")
        step = stored(step.select("node", "was", F.coalesce("far", "label").alias("label")))
        labels = step.select("node", "label")
        if step.where(F.col("was") != F.col("label")).isEmpty():
            return labels
