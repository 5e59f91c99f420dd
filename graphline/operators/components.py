"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.plans.iterate import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    Each round hooks every node to its smallest neighbour's neighbour, maps the
    edges to their new labels and drops those that fall together, so the graph
    shrinks until no edge is left. Every round ends in tables in the shared folder.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        again = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = cut(hook.join(again, "p", "left").select(F.col("a").alias("of"), F.coalesce("pp", "p").alias("to")))
        labels = cut(labels.join(jump, labels.component == jump.of, "left").select("node", F.coalesce("to", "component").alias("component")))
        to_a, to_b = jump.select(F.col("of").alias("a"), F.col("to").alias("na")), jump.select(F.col("of").alias("b"), F.col("to").alias("nb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("na <> nb")
        edges = cut(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    return labels
