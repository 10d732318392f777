"""Connected components of an undirected graph, by repeated smallest-label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut


def connected_components(nodes: DataFrame | None, edges: DataFrame, node: str = "id", source: str = "a", target: str = "b") -> DataFrame:
    """``node, component``: the smallest node of the component of each node.

    Every round takes the smallest label among a node and its neighbours and then the label of that label, so that the rounds
    grow with the logarithm of the longest path. Only nodes with edges take part in the rounds; all state stays in the cluster
    and is written to the shared folder, and a round ends with one look for a label that moved. Nodes without edges are
    components of their own, and are left out if ``nodes`` is None; edges may repeat, loop, be null or name no node.
    """
    pairs = edges.select(F.col(source).alias("x"), F.col(target).alias("y")).filter("x <> y")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("x", "y").hint("merge"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "x", "left").select("x", F.least("label", F.coalesce("near", "label")).alias("next"), F.col("label").alias("old"))
        jump = step.select(F.col("x").alias("next"), F.col("next").alias("far"))
        now = cut(step.join(jump.hint("merge"), "next", "left").select("x", F.least("next", F.coalesce("far", "next")).alias("label"), "old"))
        labels = now.select("x", "label")
        if now.filter("label <> old").isEmpty():
            break
    if nodes is None:
        return labels.select(F.col("x").alias(node), F.col("label").alias("component"))
    own = nodes.select(F.col(node).alias("x")).filter("x is not null").distinct()
    return own.join(labels, "x", "left").select(F.col("x").alias(node), F.coalesce("label", "x").alias("component"))
