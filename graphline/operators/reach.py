"""Reachability: sets of targets passed along edges as bitmaps, shortest paths by parent tables.

Only pairs with the given targets are built, never all pairs. Where depths don't
matter and targets are many, every strongly connected component becomes one node
first. Every round ends in a table in the shared folder and reads the round
before it alone; the edges are dealt by node once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphline.functions.labels import label, path_text
from graphline.model import PropertyGraph, by_node
from graphline.operators.condense import condensed
from graphline.operators.spread import BITS, members_of, numbered, seeds_of, spread, united
from graphline.plans.buckets import bucketed
from graphline.plans.iterate import counted, cut

#: From so many targets on, components are condensed before sets are passed on.
CONDENSE = 64 * BITS


def _ends(direction: str) -> tuple[str, str]:
    return ("dst", "src") if direction == "in" else ("src", "dst")


#: Up to so many rounds edges are shuffled in each of them; dealing them once costs as much.
FEW_ROUNDS = 3


def _step(edges: DataFrame, direction: str, most: int | None = None) -> DataFrame:
    """(node, next), dealt by node for more than a few rounds; loops lead to nothing new."""
    at, to = _ends(direction)
    rows = edges.where("src <> dst").select(F.col(at).alias("node"), F.col(to).alias("next"))
    return cut(rows) if most is not None and most <= FEW_ROUNDS else bucketed(rows, "node")


def closure(edges: DataFrame, targets: DataFrame, direction: str = "in", max_depth: int | None = None) -> DataFrame:
    """(node, target, depth) of nodes that reach the targets (``in``) or are reached from them (``out``).

    ``targets`` has the column node_id; every target has itself at depth 0.
    """
    places = numbered(targets)
    rounds = spread(_step(edges, direction, max_depth), seeds_of(places), max_depth)
    each = [t.select("node", "block", "fresh", F.lit(k).alias("depth")) for k, t in enumerate(rounds)]
    return members_of(reduce(DataFrame.unionByName, each), places, "fresh").select("node", "target", "depth")


#: With many targets sets are first passed along the edges themselves, as long as a round passes no more rows on than this for each edge.
ENOUGH = 4


def _ahead(step: DataFrame) -> DataFrame:
    """``step`` with the number of steps that follow on next."""
    follow = step.groupBy(F.col("node").alias("next")).agg(F.count(F.lit(1)).alias("ahead"))
    return step.join(follow, "next", "left").select("node", "next", F.coalesce("ahead", F.lit(0).cast("long")).alias("ahead"))


def _plain_sets(edges: DataFrame, places: DataFrame, direction: str) -> DataFrame | None:
    """The sets without condensing, or None where they would grow by cycles or dense layers."""
    at, to = _ends(direction)
    rows, seen = counted(edges.where("src <> dst").select(F.col(at).alias("node"), F.col(to).alias("next")), n=F.count(F.lit(1)))
    found = spread(bucketed(_ahead(rows), "node"), seeds_of(places), enough=max(1, ENOUGH * seen["n"]))
    return None if found is None else united(found)


def reach_sets(edges: DataFrame, targets: DataFrame, direction: str = "in", condense: bool | None = None, dealt: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node, block, bits): the targets that each node reaches (``in``) or is reached from (``out``), itself included, and their places.

    A place may have several rows; each target is in one of them. ``condense`` passes
    sets between strongly connected components; by default where there are CONDENSE
    targets or more and a round would pass too much on. Without ``dealt`` the edges
    are read as they lie, and dealt by node only once a round has many rows. Both
    decide on speed alone.
    """
    places = numbered(targets)
    if condense is None and places.count() >= CONDENSE:
        plain = _plain_sets(edges, places, direction)
        if plain is not None:
            return plain, places
        condense = True
    at, to = _ends(direction)
    if not condense:
        if dealt:
            return united(spread(_step(edges, direction), seeds_of(places))), places
        rows = edges.where("src <> dst").select(F.col(at).alias("node"), F.col(to).alias("next"))
        return united(spread(rows, seeds_of(places), deal=lambda step: bucketed(step, "node"))), places
    between, members = condensed(edges.select(F.col(at).alias("a"), F.col(to).alias("b")))
    between = cut(between)
    of = members.select("node", F.col("component").alias("of"))
    seeds = seeds_of(places).join(of, "node", "left").select(F.coalesce("of", "node").alias("node"), "block", "bits")
    known = united(spread(bucketed(between.select(F.col("a").alias("node"), F.col("b").alias("next")), "node"), seeds))
    # a component is named by one of its nodes, and is the only one of that name
    inside = known.join(members.select(F.col("component").alias("node"), F.col("node").alias("member")), "node", "left")
    return inside.select(F.coalesce("member", "node").alias("node"), "block", "bits"), places


def reach_totals(edges: DataFrame, targets: DataFrame, direction: str = "in") -> DataFrame:
    """(node, n): how many targets other than itself each node reaches (``in``) or is reached from (``out``), without those that have none.

    Sets are of components and not of targets, and are counted by how many targets
    their components have, so that no set is written out for the nodes of a component.
    """
    aims = targets.select("node_id").distinct()
    at, to = _ends(direction)
    between, members = condensed(edges.select(F.col(at).alias("a"), F.col(to).alias("b")))
    between, of = cut(between), members.select("node", F.col("component").alias("of"))
    held = aims.select(F.col("node_id").alias("node")).join(of, "node", "left").select(F.coalesce("of", "node").alias("node_id"))
    weights = cut(held.groupBy("node_id").agg(F.count(F.lit(1)).alias("weight")))
    places = numbered(weights)
    known = united(spread(bucketed(between.select(F.col("a").alias("node"), F.col("b").alias("next")), "node"), seeds_of(places)))
    of_block = places.join(weights, "node_id").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bit", "weight"))).alias("weights"))  # BITS at most
    of_bits = F.aggregate(F.map_entries("weights"), F.lit(0).cast("long"), lambda n, e: n + F.when(F.call_function("getbit", F.col("bits"), e["key"]) == 1, e["value"]).otherwise(F.lit(0).cast("long")))
    totals = cut(known.join(of_block, "block").groupBy("node").agg(F.sum(of_bits).alias("n")))
    every = totals.join(of.select(F.col("of").alias("node"), F.col("node").alias("member")), "node", "left").select(F.coalesce("member", "node").alias("node"), "n")
    own = aims.select(F.col("node_id").alias("node"), F.lit(1).alias("own"))
    return every.join(own, "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")


def reach_counts(sets: DataFrame, places: DataFrame) -> DataFrame:
    """(node, n): how many targets other than itself each node has in its sets; nodes with none are left out."""
    own = places.select(F.col("node_id").alias("node"), F.lit(1).alias("own"))
    counted = sets.groupBy("node").agg(F.sum(F.bit_count("bits")).alias("n")).join(own, "node", "left")
    return counted.select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")


def reach_pairs(sets: DataFrame, places: DataFrame) -> DataFrame:
    """(node, target) of the sets, without a target's own."""
    return members_of(sets, places).where("node <> target")


def ancestors(graph: PropertyGraph, targets: DataFrame, max_depth: int | None = None, depths: bool = True) -> DataFrame:
    """(node, target, depth) of nodes with a path to a target; a target isn't its own ancestor, not even on a cycle. Without ``depths`` the pairs alone."""
    if not depths and max_depth is None:
        return reach_pairs(*reach_sets(graph.edges, targets))
    found = closure(graph.edges, targets, "in", max_depth).where("node <> target")
    return found if depths else found.drop("depth")


def descendants(graph: PropertyGraph, sources: DataFrame, max_depth: int | None = None, depths: bool = True) -> DataFrame:
    """(node, source, depth) of nodes that a source has a path to, without itself. Without ``depths`` the pairs alone."""
    if not depths and max_depth is None:
        return reach_pairs(*reach_sets(graph.edges, sources, "out")).withColumnRenamed("target", "source")
    found = closure(graph.edges, sources, "out", max_depth).where("node <> target").withColumnRenamed("target", "source")
    return found if depths else found.drop("depth")


def has_path(graph: PropertyGraph, pairs: DataFrame, dealt: bool = True) -> DataFrame:
    """``pairs`` (source, target) with ``reachable``; a node reaches itself. The bit of each pair is looked up, no other pair is written out. ``dealt`` as in ``reach_sets``."""
    sets, places = reach_sets(graph.edges, pairs.select(F.col("target").alias("node_id")), dealt=dealt)
    asked = pairs.join(places.withColumnRenamed("node_id", "target"), "target")
    sources = pairs.select("source").distinct()
    held = sets.withColumnRenamed("node", "source").join(sources, "source", "left_semi").groupBy("source", "block").agg(F.bit_or("bits").alias("bits"))
    hit = F.coalesce(F.call_function("getbit", F.col("bits"), F.col("bit")) == 1, F.lit(False))
    return asked.join(held, ["source", "block"], "left").select("source", "target", hit.alias("reachable"))


def k_hop_inbound(graph: PropertyGraph, focus: str, depth: int = 3) -> tuple[DataFrame, PropertyGraph]:
    """(node_id, depth) of nodes within ``depth`` hops of the focus, itself included, and the subgraph of them."""
    near = distances(graph, focus, "in", depth)
    return near, graph.induced(near)


def _one(graph: PropertyGraph, node: str) -> DataFrame:
    return graph.nodes.where(F.col("node_id") == node).select("node_id")


def distances(graph: PropertyGraph, source: str, direction: str = "out", max_depth: int | None = None) -> DataFrame:
    """(node_id, depth): hops from the source (``out``) or to it (``in``)."""
    return _found(_Search(graph, source, direction, max_depth).run())


def _found(table: DataFrame) -> DataFrame:
    return table.select(F.col("node").alias("node_id"), "depth")


class _Search:
    """Breadth-first search from one node, level by level: ``table`` has (node, depth, parent), the parent being the smallest of a level nearer."""

    def __init__(self, graph: PropertyGraph, start: str, direction: str, most: int | None = None):
        self.step, self.most, self.depth = _step(graph.edges, direction, most), most, 0
        none = F.lit(None).cast("string")
        self.table, seen = counted(_one(graph, start).select(F.col("node_id").alias("node"), F.lit(0).alias("depth"), none.alias("parent")), n=F.count(F.lit(1)))
        self.size = seen["n"]

    def last(self) -> DataFrame:
        return self.table.where(F.col("depth") == self.depth)

    def go_on(self) -> bool:
        """One level more; false where there is none."""
        if not self.size or (self.most is not None and self.depth >= self.most):
            self.size = 0
            return False
        moved = self.last().select("node").join(self.step, "node").select(F.col("next").alias("node"), F.lit(self.depth + 1).alias("depth"), F.col("node").alias("parent"))
        first = self.table.unionByName(moved).groupBy("node").agg(F.min(F.struct("depth", "parent")).alias("f"))
        self.depth += 1
        self.table, seen = counted(first.select("node", "f.depth", "f.parent"), n=F.count_if(F.col("depth") == self.depth))
        self.size = seen["n"]
        return self.size > 0

    def run(self) -> DataFrame:
        while self.go_on():
            pass
        return self.table


def parents(graph: PropertyGraph, focus: str, max_depth: int | None = None) -> DataFrame:
    """(node_id, depth, next): of each node that leads to the focus the hops, and the next node of its shortest path there; of several paths the smallest by node ids."""
    return _Search(graph, focus, "in", max_depth).run().select(F.col("node").alias("node_id"), "depth", F.col("parent").alias("next"))


def _shortest(graph: PropertyGraph, start: str, end: str) -> list[str] | None:
    """The shortest path, of several the smallest by node ids, or None.

    Two searches, from the start and to the end, of which the one with the smaller
    last level goes on, until they meet; no path is shorter than the levels that
    both have gone then. Levels of the first are cut down to what leads to where
    they met, and each node told the smallest next one; then the steps are looked up.
    """
    there, back = _Search(graph, start, "out"), _Search(graph, end, "in")
    if not there.size or not back.size:
        return None
    while (met := cut(there.last().select("node").join(back.last().select("node"), "node"))).isEmpty():
        if not min((there, back), key=lambda s: s.size).go_on():
            return None
    steps, level = [], met
    for depth in range(there.depth - 1, -1, -1):
        near = there.table.where(F.col("depth") == depth).select("node")
        on = near.join(there.step, "node").join(level.select(F.col("node").alias("next")), "next").groupBy("node").agg(F.min("next").alias("next"))
        level = cut(on)
        steps.append(level)
    path = [start]
    told: list[tuple[DataFrame, Column]] = [(t, F.col("next")) for t in reversed(steps)] + [(back.table, F.col("parent"))] * back.depth
    for table, step in told:
        path.append(table.where(F.col("node") == path[-1]).select(step.alias("step")).first()["step"])
    return path


def shortest_path(graph: PropertyGraph, start: str, end: str) -> DataFrame:
    """One row: hops, path and a message; hops and path are null if there is no path or a node is missing."""
    path = _shortest(graph, start, end)
    if path is None:
        text = "No forward path found; showing inbound callers only."
    elif start == end:
        text = "Start and focus functions are identical."
    else:
        text = f"Shortest path length: {len(path) - 1} hops."
    return graph.nodes.sparkSession.createDataFrame([(None if path is None else len(path) - 1, path, text)], "hops int, path array<string>, message string")


def shortest_paths(graph: PropertyGraph, source: str, target: str) -> list[str]:
    """The nodes of the shortest path; a missing path is an error."""
    path = _shortest(graph, source, target)
    if path is None:
        raise ValueError(f"no path from {source} to {target}")
    return path


def inbound_paths(graph: PropertyGraph, focus: str, depth: int = 3, most: int = 12, labels: int = 8) -> DataFrame:
    """(source, hops, path, node_id) of the nearest callers by (distance, node order), as label texts of at most ``labels`` steps."""
    told = parents(graph, focus, depth)
    order = graph.nodes.select("node_id", "ord", label().alias("label"))
    near = cut(by_node(told.where("depth > 0")).join(order.select("node_id", "ord"), "node_id").orderBy("depth", "ord", "node_id").limit(most).select("node_id", "depth", "ord"))
    # ``most`` rows with their place on the way, traced back a step at a time
    trail = [near.select("node_id", F.col("node_id").alias("step"), F.lit(0).alias("at"))]
    go_on = told.select(F.col("node_id").alias("step"), "next")
    for k in range(depth):
        trail.append(cut(go_on.join(F.broadcast(trail[-1]), "step").where("next IS NOT NULL").select("node_id", F.col("next").alias("step"), F.lit(k + 1).alias("at"))))
    steps = reduce(DataFrame.unionByName, trail)
    steps = order.select(F.col("node_id").alias("step"), "label").join(F.broadcast(steps), "step")
    listed = near.join(steps.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("s")), "node_id")
    return listed.orderBy("depth", "ord", "node_id").select(F.col("s")[0]["label"].alias("source"), F.col("depth").alias("hops"), path_text(F.col("s.label"), labels).alias("path"), "node_id")
