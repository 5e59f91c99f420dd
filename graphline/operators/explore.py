"""The interactive pipeline: filter, sample, neighbourhood, paths, render set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.functions.labels import label, with_colour_index, with_hub, with_size
from graphline.model import PropertyGraph, by_node
from graphline.operators.reach import inbound_paths, k_hop_inbound, shortest_path
from graphline.operators.structure import balanced_subgraph
from graphline.plans.iterate import cut
from graphline.sources.sinks import elements


@dataclass
class View:
    """elements; paths (source, hops, path); options (value, label); the two messages; the node ids of the path."""

    elements: DataFrame
    paths: DataFrame | None
    options: DataFrame
    focus_message: str
    path_message: str
    path: list[str]


def explore(graph: PropertyGraph, limit: int = 500, external_only: bool = False, focus: str | None = None, depth: int = 3, start: str | None = None, path_only: bool = False, size_mode: str = "fixed") -> View:
    """Filter first, then take a balanced sample of at most ``limit`` nodes (between 1 and all of them), and add the nodes of the path.

    Sizes come from the filtered graph, the degrees shown from the rendered one.
    Hubs are marked only where sizes follow the degree.
    """
    shown = graph.external_only() if external_only else graph
    shown = PropertyGraph(cut(shown.nodes), cut(shown.edges), shown.meta)
    sample = balanced_subgraph(shown, max(1, min(limit, graph.nodes.count())))
    spark = graph.nodes.sparkSession
    nodes, edges = spark.createDataFrame([], "node_id string"), spark.createDataFrame([], "src string, dst string")
    focus_message, path_message = "Select a focus function to inspect inbound callers.", "Select a start and focus function to view shortest paths."
    paths, path = None, []
    there = {r["node_id"] for r in shown.nodes.where(F.col("node_id").isin([x for x in (focus, start) if x])).select("node_id").collect()}
    if focus:
        focus_message = "Focus function is currently filtered out."
        path_message = "Select a start function to compute a path."
    if focus in there:
        near, sub = k_hop_inbound(shown, focus, depth)
        nodes, edges = nodes.union(near.select("node_id")), edges.union(sub.edges.select("src", "dst"))
        name = shown.nodes.where(F.col("node_id") == focus).select(label().alias("l")).first()["l"]
        focus_message = f"{near.count()} functions within {depth} hops can reach {name}."
        paths = inbound_paths(shown, focus, depth)
        if start in there:
            row = shortest_path(shown, start, focus).first()
            path_message, path = row["message"], row["path"] or []
    steps = spark.createDataFrame([(p,) for p in path], "node_id string")
    if path:
        nodes = nodes.union(steps)
        edges = edges.union(spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "src string, dst string"))
    rendered = shown.induced(steps if path_only and path else cut(sample.nodes.select("node_id").union(steps).distinct()))
    degree = rendered.degrees().select("node_id", "degree")
    sized = with_size(shown.nodes.select("node_id").join(by_node(shown.degrees()), "node_id"), size_mode).select("node_id", "size")
    coloured = with_colour_index(shown.nodes.select("node_id", "program"), 8).select("node_id", "colour")
    table = rendered.nodes.join(by_node(degree), "node_id").join(by_node(sized), "node_id").join(by_node(coloured), "node_id")
    table = with_hub(cut(table)) if size_mode == "degree" else table.withColumn("hub", F.lit(False))
    options = shown.nodes.select(F.col("node_id").alias("value"), label().alias("label")).orderBy("value")
    return View(elements(rendered, table, nodes, edges), paths, options, focus_message, path_message, path)
