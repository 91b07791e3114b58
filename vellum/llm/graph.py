"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_counting


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): the smallest node that each can reach.

    Nodes take the smallest label around them, then the label of their label, until
    nothing changes; each round halves the depth of what is left.  Minima combine
    before the shuffle, so a node with very many edges is no burden to one task.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        stepped = hooked.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        stepped, changed = cut_counting(stepped, F.col("old") != F.col("label"))
        labels = stepped.select("node", "label")
        if not changed:
            return labels


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, label) of components' result after further edges (a, b): only what these join is worked on."""
    ends = lambda column: labels.select(F.col("node").alias(column), F.col("label").alias(f"label_{column}"))
    named = edges.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    named = cut(named.select("a", "b", F.coalesce("label_a", "a").alias("from"), F.coalesce("label_b", "b").alias("to")))
    moved = components(named.select(F.col("from").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("into"))
    new = named.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return cut(labels.union(new).join(moved, "label", "left").select("node", F.coalesce("into", "label").alias("label")))
