"""Weakly connected components and subgraphs of the best-connected nodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphline.functions.labels import filled
from graphline.model import PropertyGraph, by_node
from graphline.operators.components import components
from graphline.plans.iterate import cut
from graphline.schema import UNKNOWN


def weak_components(graph: PropertyGraph) -> DataFrame:
    """(node_id, component) for every node; component is the smallest node_id of it."""
    found = components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(graph: PropertyGraph) -> DataFrame:
    return weak_components(graph).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(graph: PropertyGraph) -> PropertyGraph:
    """The subgraph of the largest component; among equals the one whose first node comes first."""
    found = cut(weak_components(graph).join(graph.nodes.select("node_id", "ord"), "node_id"))
    best = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("ord", "node_id")).alias("first")).orderBy(F.desc("size"), "first").limit(1)
    return graph.induced(found.join(best.select("component"), "component", "left_semi"))


def top_degree(graph: PropertyGraph, k: int = 10) -> DataFrame:
    """node_id, program, degree of the k best-connected nodes; ties in node order."""
    return graph.nodes.select("node_id", "program", "ord").join(by_node(graph.degrees().select("node_id", "degree")), "node_id").orderBy(F.desc("degree"), "ord", "node_id").limit(k).drop("ord")


def top_k_subgraph(graph: PropertyGraph, k: int | None = 200) -> PropertyGraph:
    """The k best-connected nodes, and of them the largest component; all of the graph if it has no more than k nodes."""
    if k is None or graph.nodes.count() <= k:
        return graph
    return largest_component(graph.induced(cut(top_degree(graph, k))))


def balanced_sample(graph: PropertyGraph, limit: int) -> DataFrame:
    """node_id of at most ``limit`` nodes: of each program its best-connected up to a quota, then the best of the rest.

    The quota is max(1, ceil(limit / programs)); programs come in the order of
    their first node, and the list is cut at ``limit`` in that order.
    """
    rows = graph.nodes.select("node_id", "ord", F.coalesce(filled("program"), F.lit(UNKNOWN)).alias("program")).join(by_node(graph.degrees().select("node_id", "degree")), "node_id")
    first = rows.groupBy("program").agg(F.min(F.struct("ord", "node_id")).alias("first"))
    programs = first.count()
    quota = max(1, math.ceil(limit / max(1, programs)))
    in_program = Window.partitionBy("program").orderBy(F.desc("degree"), "ord", "node_id")
    ranked = cut(rows.join(first, "program").withColumn("rn", F.row_number().over(in_program)))
    chosen = ranked.where(F.col("rn") <= quota).select("node_id", F.lit(0).alias("phase"), F.struct("first", "rn").alias("by"))
    rest = ranked.where(F.col("rn") > quota).orderBy(F.desc("degree"), "ord", "node_id").limit(limit).select("node_id", F.col("degree"), F.col("ord"))
    head = chosen.orderBy("by").limit(limit)
    missing = limit - head.count()
    if missing <= 0:
        return head.select("node_id")
    return head.select("node_id").union(rest.orderBy(F.desc("degree"), "ord", "node_id").limit(missing).select("node_id"))


def balanced_subgraph(graph: PropertyGraph, limit: int | None) -> PropertyGraph:
    """The balanced sample, and of it the largest component; all of the graph if it has no more than ``limit`` nodes."""
    if limit is None or graph.nodes.count() <= limit:
        return graph
    return largest_component(graph.induced(cut(balanced_sample(graph, limit))))
