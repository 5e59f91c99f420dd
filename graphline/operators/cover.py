"""Targets, orphans, coverage and minimal covers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphline.functions.labels import PROGRAM_HINT, TARGET_PREFIXES, has_prefix, is_candidate, is_target, label, name_label, program_ends_with
from graphline.model import PropertyGraph, by_node
from graphline.operators.reach import reach_counts, reach_sets
from graphline.operators.spread import BITS, FEW_ROWS, member_lists, members_of
from graphline.plans.iterate import counted, cut


def unreferenced_targets(graph: PropertyGraph, prefixes: str | Sequence[str] = TARGET_PREFIXES, name_attr: str = "name", program_hint: str | None = PROGRAM_HINT) -> DataFrame:
    """node_id of targets that no edge leads to (a self-loop is one). Without prefixes nothing is a target here."""
    named = has_prefix(name_label(name_attr), prefixes, if_empty=False)
    found = graph.nodes.where(named & is_target(program_hint, prefixes) if program_hint else named)
    return found.select("node_id").join(graph.edges.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti")


def target_set(graph: PropertyGraph, names: Sequence[str] | None = None, prefixes: str | Sequence[str] = TARGET_PREFIXES, program_hint: str | None = PROGRAM_HINT) -> tuple[DataFrame, DataFrame]:
    """Targets (node_id) and the names that weren't found (name).

    Names are node ids or else labels; without names the predicate decides. Without prefixes every label is a target.
    """
    if not names:
        return graph.nodes.where(is_target(program_hint, prefixes)).select("node_id"), graph.nodes.sparkSession.createDataFrame([], "name string")
    # the names come from the caller's list, so they are small; nodes are scanned once and never shuffled
    asked = graph.nodes.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    keys = F.array(F.struct(F.col("node_id").alias("name"), F.lit(0).alias("rule")), F.struct(label().alias("name"), F.lit(1).alias("rule")))
    hits = cut(graph.nodes.select("node_id", F.explode(keys).alias("k")).select("node_id", "k.*").join(F.broadcast(asked), "name"))
    best = hits.groupBy("name").agg(F.min("rule").alias("rule"))
    found = hits.join(F.broadcast(best), ["name", "rule"])
    return found.select("node_id").distinct(), asked.join(F.broadcast(best), "name", "left_anti")


def candidates(graph: PropertyGraph, programs: Sequence[str] | None = None, candidate_filter: Column | None = None) -> DataFrame:
    """node_id, label, program, ord of candidates. A ``candidate_filter`` replaces the default, ``programs`` included."""
    keep = is_candidate(programs) if candidate_filter is None else candidate_filter
    return graph.nodes.where(keep).select("node_id", label().alias("label"), F.coalesce("program", F.lit("")).alias("program"), "ord")


def covered_sets(graph: PropertyGraph, targets: DataFrame, who: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The targets that each candidate reaches, as bitmaps (see ``reach_sets``), in a table."""
    sets, places = reach_sets(graph.edges, targets)
    return cut(sets.join(who.select(F.col("node_id").alias("node")), "node", "left_semi")), places


def orphans(graph: PropertyGraph, prefixes: str | Sequence[str] = TARGET_PREFIXES, program_hint: str | None = PROGRAM_HINT, programs: Sequence[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Candidates (node_id, label, program) that reach no target, in node order."""
    aims = target_set(graph, None, prefixes, program_hint)[0] if targets is None else targets
    who = candidates(graph, programs)
    reaching = reach_counts(*covered_sets(graph, aims, who)).select(F.col("node").alias("node_id"))
    return who.join(reaching, "node_id", "left_anti").orderBy("ord", "node_id").select("node_id", "label", "program")


def coverage_report(graph: PropertyGraph, prefixes: str | Sequence[str] = TARGET_PREFIXES, program_hint: str | None = PROGRAM_HINT, programs: Sequence[str] | None = None, targets: DataFrame | None = None, listed: bool = True) -> DataFrame:
    """Every candidate with the number of targets that it reaches (and, ``listed``, which), most first, then in node order."""
    aims = target_set(graph, None, prefixes, program_hint)[0] if targets is None else targets
    who = candidates(graph, programs)
    sets, places = covered_sets(graph, aims, who)
    per = reach_counts(sets, places).select(F.col("node").alias("node_id"), F.col("n").alias("n_covered"))
    found = who.join(per, "node_id", "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0).cast("long")))
    if listed:
        lists = member_lists(sets, places).select(F.col("node").alias("node_id"), F.array_remove("members", F.col("node")).alias("covered"))
        found = found.join(lists, "node_id", "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    return found.orderBy(F.desc("n_covered"), "ord", "node_id").drop("ord")


@dataclass
class Cover:
    """hooks: step, node_id, label, program, gain, covered (of that step). uncovered: node_id. missing: name."""

    hooks: DataFrame
    uncovered: DataFrame
    missing: DataFrame


def greedy_cover(graph: PropertyGraph, names: Sequence[str] | None = None, prefixes: str | Sequence[str] = TARGET_PREFIXES, program_hint: str | None = PROGRAM_HINT, programs: Sequence[str] | None = None, candidate_filter: Column | None = None, targets: DataFrame | None = None, batch: int = 2000, batch_pairs: int = 500_000) -> Cover:
    """Repeatedly the candidate that reaches most targets still uncovered; ties by node_id. Ends when no candidate gains.

    Gains never grow, so picks come in the order of (gain, node_id), and a candidate
    that is best at each of its uncovered targets is picked with the gain that it
    has, whatever else is. The sets are written once; what is covered is a bitmap of
    the targets. Candidates are taken in bands of the largest gains, a share of them
    all, so that the number of bands doesn't follow that of candidates. In a band all
    that are best at their targets are picked together; a band of at most
    ``batch_pairs`` pairs, or its best ``batch`` candidates where few are picked
    together, is picked in the driver.
    """
    aims, missing = target_set(graph, names, prefixes, program_hint) if targets is None else (targets, graph.nodes.sparkSession.createDataFrame([], "name string"))
    who = candidates(graph, programs, candidate_filter)
    sets, places = covered_sets(graph, aims, who)
    own = cut(places.join(by_node(who.select("node_id")), "node_id", "left_semi").select(F.col("node_id").alias("node"), "block", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("held")))
    if not own.isEmpty():
        sets = cut(_without(sets, own, ["node", "block"]))
    spark = graph.nodes.sparkSession
    picks: list[tuple[str, int]] = []
    held: DataFrame | None = None
    while True:
        gains, seen = counted(_uncovered(sets, held).groupBy("node").agg(F.sum(F.bit_count("bits")).alias("gain")), n=F.count(F.lit(1)), pairs=F.sum("gain"))
        if not seen["n"]:
            break
        share = max(BAND, min(1.0, batch / seen["n"], batch_pairs / seen["pairs"]))
        # bears on speed only
        least = 1 if share == 1 else gains.agg(F.percentile_approx("gain", 1 - share).alias("g")).first()["g"]
        band, seen = counted(gains.where(F.col("gain") >= least).select("node"), n=F.count(F.lit(1)))
        rows = _uncovered(sets, held).join(_near(band, seen["n"]), "node", "left_semi")
        while True:
            gain = F.sum(F.bit_count("bits")).over(Window.partitionBy("node"))
            rows, seen = counted(rows.withColumn("gain", gain).where(F.col("gain") >= least), pairs=F.sum(F.bit_count("bits")))
            if not seen["pairs"]:
                break
            if last := seen["pairs"] <= batch_pairs:
                new = _picked(_members(rows), (1 - least, ""))
            elif len(new := _best_everywhere(rows)) < FEW_PICKS:
                new = _best_picked(rows, batch, batch_pairs, least)
            picks += new
            now = spark.createDataFrame([(node,) for node, _ in new], "node string")
            got = cut(rows.join(F.broadcast(now), "node", "left_semi").groupBy("block").agg(F.bit_or("bits").alias("held")))
            held = got if held is None else cut(held.unionByName(got).groupBy("block").agg(F.bit_or("held").alias("held")))
            if last:
                break
            rows = _uncovered(rows.drop("gain"), got)
    picks.sort(key=lambda p: (-p[1], p[0]))
    steps = spark.createDataFrame([(k, node, gain) for k, (node, gain) in enumerate(picks, 1)], "step int, node_id string, gain long")
    # the step that covers a target is the first pick that reaches it
    reached = members_of(sets.join(F.broadcast(steps.select(F.col("node_id").alias("node"), "step")), "node"), places)
    step_of = cut(reached.groupBy("target").agg(F.min("step").alias("step")))
    covered = step_of.groupBy("step").agg(F.array_sort(F.collect_list("target")).alias("covered"))
    hooks = who.drop("ord").join(F.broadcast(steps), "node_id").join(covered, "step").select("step", "node_id", "label", "program", "gain", "covered").orderBy("step")
    return Cover(hooks, aims.join(step_of.select(F.col("target").alias("node_id")), "node_id", "left_anti"), missing)


#: The share of the candidates that a band has.
BAND = 1 / 32
#: Fewer that are picked together are picked in the driver, with what follows them.
FEW_PICKS = 16


def _near(table: DataFrame, n: int) -> DataFrame:
    """``table`` (``n`` rows), broadcast where it is small."""
    return F.broadcast(table) if n <= FEW_ROWS else by_node(table)


def _without(rows: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (node, block, bits) without the bits of ``held``."""
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long"))))
    return rows.join(held, on, "left").select("node", "block", left.alias("bits")).where("bits <> 0")


def _uncovered(rows: DataFrame, held: DataFrame | None) -> DataFrame:
    return rows if held is None else _without(rows, _near(held, held.count()), ["block"])


def _best_everywhere(rows: DataFrame) -> list[tuple[str, int]]:
    """(node, gain) of those of ``rows`` (node, block, bits, gain) that come first, by gain and node, at each of their targets."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1)).alias("bit")
    first = rows.select("node", "block", "gain", bit).groupBy("block", "bit").agg(F.min(F.struct((-F.col("gain")).alias("less"), "node")).alias("f"))
    won = first.groupBy("f.node", "f.less").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == -F.col("less"))
    return [(r["node"], r["n"]) for r in won.collect()]


def _best_picked(rows: DataFrame, batch: int, batch_pairs: int, least: int) -> list[tuple[str, int]]:
    """Picks among the best ``batch`` of ``rows`` (node, block, bits, gain), with at most ``batch_pairs`` pairs, while they beat the next one; a candidate of more pairs alone."""
    best = rows.groupBy("node").agg(F.max("gain").alias("gain")).orderBy(F.desc("gain"), "node").limit(batch + 1).collect()
    if best[0]["gain"] > batch_pairs:
        return [(best[0]["node"], best[0]["gain"])]
    most = max(1, sum(n <= batch_pairs for n in accumulate(r["gain"] for r in best[:batch])))
    some = rows.sparkSession.createDataFrame([(r["node"],) for r in best[:most]], "node string")
    bound = (-best[most]["gain"], best[most]["node"]) if len(best) > most else (1 - least, "")
    return _picked(_members(rows.join(F.broadcast(some), "node", "left_semi")), bound)


def _members(rows: DataFrame) -> dict[str, set]:
    """The targets, as numbers, of each node of ``rows`` (node, block, bits), in the driver."""
    sets: dict[str, set] = {}
    for r in rows.select("node", "block", "bits").collect():
        sets.setdefault(r["node"], set()).update(r["block"] * BITS + b for b in range(BITS) if r["bits"] >> b & 1)
    return sets


def _picked(sets: dict[str, set], bound: tuple[int, str]) -> list[tuple[str, int]]:
    """Greedy picks (node, gain) among ``sets`` as long as (-gain, node) comes before ``bound``. A heap of old gains is checked lazily."""
    heap = [(-len(s), node) for node, s in sets.items()]
    heapify(heap)
    covered: set = set()
    found = []
    while heap and heap[0] < bound:
        old, node = heappop(heap)
        left = sets[node] - covered
        if -len(left) != old:
            heappush(heap, (-len(left), node))
            continue
        found.append((node, len(left)))
        covered |= left
    return found


def target_programs(graph: PropertyGraph, program_hint: str) -> DataFrame:
    """Programs that a hint ends."""
    return graph.nodes.where(program_ends_with(program_hint)).select("program").distinct()
