"""Strongly connected components, and the graph that is left when each becomes one node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.operators.components import components
from graphline.operators.spread import spread, united
from graphline.plans.buckets import bucketed
from graphline.plans.iterate import counted, cut


def _trimmed(live: DataFrame, worth: float = 0.02) -> tuple[DataFrame, int]:
    """Edges without nodes that can't be on a cycle, as nothing leads to or from them; ends when a round gains little."""
    left = live.count()
    while left:
        inner = live.select(F.col("a").alias("n")).intersect(live.select("b"))
        kept = live.join(inner.withColumnRenamed("n", "a"), "a", "left_semi").join(inner.withColumnRenamed("n", "b"), "b", "left_semi")
        before, (live, seen) = left, counted(kept.select("part", "a", "b"), n=F.count(F.lit(1)))
        left = seen["n"]
        if before - left <= worth * before:
            break
    return live, left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b) that lie on a cycle of several nodes; component is the smallest node of it.

    Nodes that nothing leads to or from go first. What hangs together without regard
    to direction is a part, so the number of rounds doesn't grow with that of
    components that stand apart. In every part of the rest the
    node of most edges is a pivot; what it reaches and what reaches it is found
    together, for all parts at once. Nodes of both kinds are its component. Nodes
    of one kind, of the other and of neither are parts of their own in the next
    round, as no cycle leads through two of them.
    """
    live = cut(edges.select(F.lit(0).cast("long").alias("part"), "a", "b").where("a <> b").distinct())
    found = []
    while True:
        live, left = _trimmed(live)
        if not left:
            break
        apart = components(live)
        live = cut(live.select("a", "b").join(apart.select(F.col("node").alias("a"), F.xxhash64("component").alias("part")), "a").select("part", "a", "b"))
        ends = live.select("part", F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(live.select("part", "b", F.lit(0), F.lit(1)))
        weight = ends.groupBy("part", "node").agg((F.sum("o") * F.sum("i")).alias("w"))
        pivots = weight.groupBy("part").agg(F.max_by("node", F.struct("w", "node")).alias("node"))
        # block 0: forward, block 1: backward; edges stay within their part, so one bit serves all parts
        step = live.select(F.col("a").alias("node"), F.lit(0).cast("long").alias("block"), F.col("b").alias("next")).union(live.select("b", F.lit(1).cast("long"), "a"))
        seeds = pivots.select("node", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("block"), F.lit(1).cast("long").alias("bits"))
        reached = united(spread(bucketed(step, "node"), seeds, by_block=True))
        kinds = cut(reached.groupBy("node").agg(F.sum(F.col("block") + 1).alias("kind")))
        of_part = live.select("part", F.col("a").alias("node")).distinct()  # after trimming and for what has a cycle every node has edges out
        found.append(cut(kinds.where("kind = 3").select("node").join(of_part.union(pivots.select("part", "node")).distinct(), "node").select("part", "node")))
        sides = live
        for end in ("a", "b"):
            sides = sides.join(kinds.select(F.col("node").alias(end), F.col("kind").alias(f"kind_{end}")), end, "left").fillna(0, [f"kind_{end}"])
        live = cut(sides.where("kind_a = kind_b AND kind_a <> 3").select("part", "a", "b"))
    if not found:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    rounds = [t.withColumn("round", F.lit(k)) for k, t in enumerate(found)]
    every = cut(reduce(DataFrame.unionByName, rounds))
    label = every.groupBy("round", "part").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return every.join(label, ["round", "part"]).select("node", "component")


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between components, without loops, and the membership (node, component) of ``strong_components``."""
    members = cut(strong_components(edges))
    moved = edges.select("a", "b")
    for end in ("a", "b"):
        moved = moved.join(members.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    moved = moved.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    return moved.where("a <> b").distinct(), members
