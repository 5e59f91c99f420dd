"""Keeping a graph, its components and its degrees up to date from a folder that graph files arrive in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphline.model import PropertyGraph, merged
from graphline.operators.components import components
from graphline.schema import EDGES, GRAPH_DOCUMENT, NODES
from graphline.sources.readers import GRAPH_GLOB, module_graph

STATE = "node_id string, component string, in_degree long, out_degree long"


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, maintain: bool = False, **trigger) -> StreamingQuery:
    """Append the nodes and edges of new module graphs to Parquet tables below ``out``, by batch.

    A batch that is run again overwrites its own partition, so every file counts
    once. With ``maintain`` each batch also brings components and degrees up to
    date (see ``maintained``).
    """
    files = spark.readStream.option("pathGlobFilter", GRAPH_GLOB).option("recursiveFileLookup", True).text(folder, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("path"))

    def save(batch: DataFrame, number: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        docs = batch.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.pmod(F.xxhash64("path"), F.lit(2**31)).cast("int").alias("file"), F.from_json("value", GRAPH_DOCUMENT).alias("d")).select("path", "stem", "file", "d.*")
        graph = module_graph(docs)
        graph.nodes.write.mode("overwrite").parquet(f"{out}/nodes/batch={number}")
        graph.edges.write.mode("overwrite").parquet(f"{out}/edges/batch={number}")
        if maintain:
            update(batch.sparkSession, out, number)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, out: str) -> PropertyGraph:
    """The graph of all batches so far; later batches override."""
    nodes = spark.read.parquet(f"{out}/nodes").withColumnRenamed("batch", "turn")
    edges = spark.read.parquet(f"{out}/edges").withColumnRenamed("batch", "turn")
    return PropertyGraph(merged(nodes, ["node_id"], list(NODES), nodes.count()), merged(edges, ["src", "dst"], list(EDGES), edges.count()), {})


def _versions(spark: SparkSession, out: str, what: str, least: int = -1) -> list[int]:
    """Numbers of the batches that a table below ``out`` is complete for."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(f"{out}/{what}")
    store = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(base):
        return []
    named = [(re.fullmatch(r"batch=(\d+)", f.getPath().getName()), f.getPath()) for f in store.listStatus(base)]
    return sorted(int(m[1]) for m, path in named if m and int(m[1]) > least and store.exists(hadoop.Path(path, "_SUCCESS")))


def update(spark: SparkSession, out: str, number: int) -> None:
    """Components and degrees behind batch ``number``, from those behind the batch before and the nodes and edges of this one.

    The batch's edges are hooked to the components that their ends had: only labels
    that the batch touches are joined up. Edges that came before aren't counted
    again; of the earlier edges those from the batch's own sources are looked at.
    A batch that is run again starts from the same table and writes the same.
    """
    before = [v for v in _versions(spark, out, "state") if v < number]
    state = spark.read.schema(STATE).parquet(f"{out}/state/batch={before[-1]}") if before else spark.createDataFrame([], STATE)
    nodes = spark.read.parquet(f"{out}/nodes/batch={number}").select("node_id").distinct()
    edges = spark.read.parquet(f"{out}/edges/batch={number}").select("src", "dst").distinct()
    fresh = edges
    if earlier := [v for v in _versions(spark, out, "edges") if v < number]:
        known = spark.read.parquet(*[f"{out}/edges/batch={v}" for v in earlier]).select("src", "dst")
        fresh = edges.join(known.join(edges.select("src").distinct(), "src", "left_semi"), ["src", "dst"], "left_anti")

    labels = state.select("node_id", "component")
    ends = fresh
    for end in ("src", "dst"):
        ends = ends.join(labels.select(F.col("node_id").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    hooks = components(ends.select(F.coalesce("of_src", "src").alias("a"), F.coalesce("of_dst", "dst").alias("b")))

    more = fresh.select(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(fresh.select("dst", F.lit(1), F.lit(0)))
    more = more.groupBy("node_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    every = state.join(nodes.withColumn("here", F.lit(True)), "node_id", "full").withColumn("label", F.coalesce("component", "node_id"))
    every = every.join(hooks.select(F.col("node").alias("label"), F.col("component").alias("to")), "label", "left").join(more, "node_id", "left")
    zero = F.lit(0).cast("long")
    plus = lambda a, b: (F.coalesce(a, zero) + F.coalesce(b, zero)).alias(a)
    after = every.select("node_id", F.coalesce("to", "label").alias("component"), plus("in_degree", "i"), plus("out_degree", "o"))
    after.write.mode("overwrite").parquet(f"{out}/state/batch={number}")


def maintained(spark: SparkSession, out: str) -> DataFrame:
    """(node_id, component, in_degree, out_degree) behind the last batch: the smallest node of each weak component, and the degrees of distinct edges."""
    found = _versions(spark, out, "state")
    return spark.read.schema(STATE).parquet(f"{out}/state/batch={found[-1]}") if found else spark.createDataFrame([], STATE)
