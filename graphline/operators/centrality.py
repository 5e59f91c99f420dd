"""Degree, PageRank and betweenness."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.model import PropertyGraph
from graphline.plans.buckets import bucketed
from graphline.plans.iterate import counted, cut


def pagerank(graph: PropertyGraph, damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-10, most: int = 200, quiet: float = 0.0) -> DataFrame:
    """(node_id, rank): ranks sum to 1; nodes without edges out spread theirs evenly.

    ``iterations`` fixes the number of rounds; else they end when the ranks move
    by less than ``tolerance`` in all, or after ``most``. Behind the first round
    nodes send on only what they have newly got (their residual), and those whose
    residual is at most ``quiet`` keep it until it has grown; with 0 the ranks of a
    round are those of the power iteration.

    Edges and state are dealt by node once, so a round shuffles what is sent alone,
    added up by task before.
    """
    nodes = graph.nodes.select("node_id")
    out = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    links = bucketed(graph.edges.select("src", "dst"), "src")
    start = nodes.join(out.withColumnRenamed("src", "node_id"), "node_id", "left")
    state = bucketed(start.select("node_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.lit(None).cast("double").alias("rank"), F.lit(0.0).alias("residual")), "node_id")
    n = state.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    sends = F.lit(1.0 / n)  # first all ranks, then the residuals
    spare = state.where("links = 0").count() / n
    for turn in range(iterations if iterations is not None else most):
        first = turn == 0
        speaking = F.lit(True) if first else F.abs("residual") > quiet
        given = state.where((F.col("links") > 0) & speaking).select(F.col("node_id").alias("src"), (sends / F.col("links")).alias("part")).join(links, "src")
        got = given.groupBy("dst").agg(F.sum("part").alias("in")).withColumnRenamed("dst", "node_id")
        change = damping * (F.coalesce("in", F.lit(0.0)) + F.lit(spare / n))
        rank = F.lit((1 - damping) / n) + change if first else F.col("rank") + change
        left = change - F.lit(1.0 / n) + F.lit((1 - damping) / n) if first else change + F.when(speaking, F.lit(0.0)).otherwise(F.col("residual"))
        state = bucketed(state.join(got, "node_id", "left").select("node_id", "links", rank.alias("rank"), left.alias("residual")), "node_id", dealt=True)
        sends = F.col("residual")
        loose = F.when(F.col("links") == 0, F.col("residual"))
        if iterations is not None and turn == iterations - 1:
            break
        spare, moved = state.agg(F.coalesce(F.sum(F.when(F.abs("residual") > quiet, loose)), F.lit(0.0)), F.sum(F.abs("residual"))).first()
        if iterations is None and moved < tolerance:
            break
    return state.select("node_id", F.coalesce("rank", F.lit(1.0 / n)).alias("rank"))


def betweenness(graph: PropertyGraph, broadcast_edges: int = 5_000_000, per_task: int = 64, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """(node_id, betweenness): directed, unweighted, not normalised, exact.

    Up to ``broadcast_edges`` edges and ``broadcast_nodes`` nodes each task has the
    adjacency arrays (8 bytes an edge) and runs searches from its share of the
    sources; beyond that shortest paths are counted by joins, level by level.
    """
    if graph.edges.count() > broadcast_edges or graph.nodes.count() > broadcast_nodes:
        return betweenness_by_joins(graph)
    spark = graph.nodes.sparkSession
    index = cut(graph.dense_index())
    n = index.count()
    ends = graph.edges.where("src <> dst").select("src", "dst").distinct()
    ends = ends.join(index.select(F.col("node_id").alias("src"), F.col("idx").alias("a")), "src").join(index.select(F.col("node_id").alias("dst"), F.col("idx").alias("b")), "dst")
    table = ends.select("a", "b").toArrow()
    tails, to = table["a"].to_numpy(), table["b"].to_numpy()
    by_tail = np.argsort(tails, kind="stable")
    told = spark.sparkContext.broadcast((np.searchsorted(tails[by_tail], np.arange(n + 1)).astype(np.int64), to[by_tail].astype(np.int32)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, to = told.value
        total = np.zeros(len(first) - 1)
        state = np.full(len(total), -1), np.zeros(len(total)), np.zeros(len(total))
        for part in parts:
            ids = part["id"].to_numpy()
            for source in ids[first[ids + 1] > first[ids]]:  # what has no edges out is no source
                _add_dependencies(int(source), first, to, total, state)
        on = np.flatnonzero(total)
        yield pd.DataFrame({"idx": on, "score": total[on]})

    tasks = max(1, min(n // per_task, spark.sparkContext.defaultParallelism * 4))
    scores = spark.range(0, n, 1, tasks).mapInPandas(run, "idx long, score double").groupBy("idx").agg(F.sum("score").alias("betweenness"))
    return index.join(scores, "idx", "left").select("node_id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _add_dependencies(source: int, first: np.ndarray, to: np.ndarray, total: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds to ``total`` what shortest paths from one source pass through each node: counts by level, then back.

    ``state`` (depths of -1, paths and shares of 0, for every node) is found and left
    as it was; only the nodes that the source reaches are touched.
    """
    depth, paths, share = state
    depth[source], paths[source] = 0, 1.0
    level, levels, reached = np.array([source]), [], [np.array([source])]
    while len(level):
        sizes = first[level + 1] - first[level]
        tail = np.repeat(level, sizes)
        head = to[np.repeat(first[level] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        new = depth[head] < 0
        depth[head[new]] = depth[source] + len(levels) + 1
        on = depth[head] == len(levels) + 1
        tail, head = tail[on], head[on]
        np.add.at(paths, head, paths[tail])
        levels.append((tail, head))
        level = np.unique(head)
        reached.append(level)
    for tail, head in reversed(levels):
        np.add.at(share, tail, paths[tail] / paths[head] * (1 + share[head]))
    share[source] = 0
    touched = np.concatenate(reached)
    total[touched] += share[touched]
    depth[touched], paths[touched], share[touched] = -1, 0.0, 0.0


def betweenness_by_joins(graph: PropertyGraph, most_pairs: int = 20_000_000, first_batch: int = 64) -> DataFrame:
    """The same by joins: path counts level by level from a batch of sources, then dependencies back along the levels.

    A node that nothing leads to and that has one edge out goes the ways of its
    neighbour: it is folded into that, which counts for as many sources more. Nodes
    without edges out are no sources. The first batch has ``first_batch`` sources;
    how many nodes they reach tells how many sources the next may have, so that a
    batch keeps to about ``most_pairs`` (source, node) pairs.
    """
    edges = graph.edges.where("src <> dst").select("src", "dst").distinct()
    forth = bucketed(edges, "src")
    back = bucketed(edges, "dst")
    single = forth.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"))
    leaves = cut(single.where("n = 1").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select("src", "to"))
    folded = leaves.groupBy(F.col("to").alias("src")).agg(F.count(F.lit(1)).alias("leaves"))
    sources = single.join(leaves.select("src"), "src", "left_anti").select("src").unionByName(leaves.select(F.col("to").alias("src"))).distinct()
    sources = sources.join(folded, "src", "left").select(F.col("src").alias("s"), F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves"))
    line = cut(sources.withColumn("place", F.xxhash64("s")))
    scores, total, done, size = [], line.count(), 0, first_batch
    # batches are ranges of the hash, as wide as their share of the sources
    while done < total:
        share = [min(1.0, x / total) for x in (done, done + size)]
        low, high = (int((x - 0.5) * 2**64) for x in share)
        batch = line.where((F.col("place") >= F.lit(max(low, -(2**63)))) & (F.col("place") < F.lit(min(high, 2**63 - 1))) if share[1] < 1.0 else F.col("place") >= F.lit(max(low, -(2**63))))
        found, pairs, used = _dependencies(batch, forth, back)
        scores.append(found)
        done += size
        size = max(1, int(most_pairs * max(1, used) / max(1, pairs)))
    ids = graph.nodes.select("node_id")
    if not scores:
        return ids.withColumn("betweenness", F.lit(0.0))
    every = reduce(DataFrame.unionByName, scores).groupBy("node_id").agg(F.sum("share").alias("betweenness"))
    return ids.join(every, "node_id", "left").select("node_id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _dependencies(sources: DataFrame, forth: DataFrame, back: DataFrame) -> tuple[DataFrame, int, int]:
    """(node_id, share): what shortest paths from the sources (s, leaves) pass through each node; how many pairs that took, and for how many sources.

    Every round writes the table of pairs anew and reads that of the round before alone.
    """
    used = sources.count()
    state = cut(sources.select("s", F.col("s").alias("t"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))
    depth, pairs = 0, used
    while True:
        moved = state.where(F.col("depth") == depth).join(forth, F.col("t") == F.col("src")).select("s", F.col("dst").alias("t"), F.lit(None).cast("int").alias("depth"), "paths")
        both = state.unionByName(moved).groupBy("s", "t").agg(F.max("depth").alias("old"), F.sum(F.when(F.col("depth").isNotNull(), F.col("paths"))).alias("known"), F.sum(F.when(F.col("depth").isNull(), F.col("paths"))).alias("fresh"))
        state, seen = counted(both.select("s", "t", F.coalesce("old", F.lit(depth + 1)).alias("depth"), F.coalesce("known", "fresh").alias("paths")), n=F.count(F.lit(1)))
        if (size := seen["n"]) == pairs:
            break
        depth, pairs = depth + 1, size
    levels = cut(state.repartition("depth", "s"), "depth")
    reached = state.groupBy("s").agg((F.count(F.lit(1)) - 1).alias("n")).join(sources.where("leaves > 0"), "s")
    shares = [reached.select(F.col("s").alias("node_id"), (F.col("n") * F.col("leaves")).cast("double").alias("share"))]
    weight = sources.select("s", (1 + F.col("leaves")).alias("weight"))
    below = levels.where(F.col("depth") == depth).select("s", "t", "paths", F.lit(0.0).alias("share"))
    # the sources themselves (depth 0) lie between nothing
    for k in range(depth - 1, 0, -1):
        given = below.join(back, F.col("t") == F.col("dst")).select("s", F.col("src").alias("t"), ((1 + F.col("share")) / F.col("paths")).alias("given"))
        level = levels.where(F.col("depth") == k).select("s", "t", "paths")
        below = cut(level.join(given.groupBy("s", "t").agg(F.sum("given").alias("given")), ["s", "t"], "left").select("s", "t", "paths", (F.col("paths") * F.coalesce("given", F.lit(0.0))).alias("share")))
        shares.append(below.join(weight, "s").groupBy(F.col("t").alias("node_id")).agg(F.sum(F.col("share") * F.col("weight")).alias("share")))
    return cut(reduce(DataFrame.unionByName, shares).groupBy("node_id").agg(F.sum("share").alias("share"))), pairs, used


def summary(graph: PropertyGraph, metric: str = "degree", top: int = 10) -> tuple[dict, DataFrame]:
    """Counts, and (node_id, program, name, score) of the nodes with the highest score; ties in node order."""
    chosen = metric.lower()
    if chosen == "degree":
        scores = graph.degrees().select("node_id", F.col("degree").cast("double").alias("score"))
    elif chosen == "betweenness":
        scores = betweenness(graph).withColumnRenamed("betweenness", "score")
    elif chosen == "pagerank":
        scores = pagerank(graph).withColumnRenamed("rank", "score")
    else:
        raise ValueError(f"unknown metric: {metric}")
    counts = graph.counts().first()
    rows = graph.nodes.join(scores, "node_id").orderBy(F.desc("score"), "ord", "node_id").limit(top)
    name = F.substring(F.coalesce("name", "node_id"), 1, 50)
    return {"vertices": counts["node_count"], "edges": counts["edge_count"], "metric": chosen}, rows.select("node_id", F.coalesce("program", F.lit("")).alias("program"), name.alias("name"), F.round("score", 4).alias("score"))
