"""Connected components of an edge table, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (columns a, b: long): root is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours (combined before the shuffle), then
    replaces the label by its own label, so that chains shrink by halves. Joins are plain equi-joins, whose hot keys
    adaptive execution splits. Each round is saved, which cuts the lineage. No edges give no rows.
    """
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = scratch.save(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root")))
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = scratch.save(lower.join(up, "root").select("node", "was", F.col("up").alias("root")))
        scratch.drop(labels, lower)
        labels = new
        if labels.filter("root != was").isEmpty():
            scratch.drop(both)
            return labels.select("node", "root")
