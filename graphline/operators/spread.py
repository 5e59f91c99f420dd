"""Passing sets along edges as bitmaps, 64 members a long, until nothing new arrives."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.plans.iterate import counted, cut

#: Members of a block.
BITS = 64
#: So many tables of rounds are looked into before they become one.
MOST_KNOWN = 8


def numbered(members: DataFrame) -> DataFrame:
    """(node_id, block, bit): a place for each distinct node_id; blocks of a partition are full but for its last.

    Places follow the length of the ids and the ids, so that numbers that are near
    one another share blocks, as what leads to one of them often leads to the next.
    """
    near = F.length("node_id"), F.col("node_id")
    rows = members.select("node_id").distinct().repartitionByRange(*near).sortWithinPartitions(*near).withColumn("at", F.monotonically_increasing_id())
    return cut(rows.select("node_id", F.shiftright("at", BITS.bit_length() - 1).alias("block"), (F.col("at") % BITS).cast("int").alias("bit")))


def seeds_of(places: DataFrame) -> DataFrame:
    """(node, block, bits): each member at its own node."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return places.select(F.col("node_id").alias("node"), "block", one.alias("bits"))


#: Up to so many rows a table is broadcast to those that it may share places with.
FEW_ROWS = 500_000


def _news(known: list[DataFrame], rows: int, got: DataFrame, n: int) -> tuple[DataFrame, int]:
    """What is new in ``got`` (``n`` rows) against the tables ``known`` (``rows`` in all): rows of ``got`` are written again only where they share a place with those."""
    old = reduce(DataFrame.unionByName, [t.select("node", "block", "fresh") for t in known])
    if n <= FEW_ROWS:
        old = old.join(F.broadcast(got.select("node", "block")), ["node", "block"], "left_semi")
    held = old.groupBy("node", "block").agg(F.bit_or("fresh").alias("held"))
    if min(n, rows) > FEW_ROWS:
        met = held.join(got.select("node", "block"), ["node", "block"], "left_semi")
        held, seen = counted(met, n=F.count(F.lit(1)))
    else:
        # one side is small: of ``held`` at most as many rows are left
        held, seen = counted(held, n=F.count(F.lit(1)))
        if n > FEW_ROWS:
            held, seen = counted(got.select("node", "block").join(F.broadcast(held), ["node", "block"]), n=F.count(F.lit(1)))
    if not seen["n"]:
        return got, n
    small = F.broadcast(held) if seen["n"] <= FEW_ROWS else held
    fresh = F.col("fresh").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long"))))
    left = got.join(small, ["node", "block"], "left").withColumn("fresh", fresh).where("fresh <> 0").select(*got.columns)
    table, seen = counted(left, n=F.count(F.lit(1)))
    return table, seen["n"]


def spread(step: DataFrame, seeds: DataFrame, most: int | None = None, by_block: bool = False, enough: int | None = None, deal: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame] | None:
    """A table (node, block, fresh) of each round, the first of the seeds alone: the members that came to a node last. No member comes to a node twice.

    ``step`` (node, next) says where members of a node go on to; with ``by_block`` it
    has a block too, and serves that one alone. A round joins what came last with
    the steps, and looks up in the rounds before it the places that got something;
    what stands there isn't written again. Ends when nothing is new, or after
    ``most`` rounds. With ``enough`` the steps have ``ahead``, the number of steps
    that follow on next; None is given before a round that would pass more rows on.
    With ``deal`` the steps lie as they are, and what came last is broadcast to them;
    before the first round that has too many rows for that, ``deal`` gives the steps
    of all further ones.
    """
    on = ["node", "block"] if by_block else ["node"]
    first, seen = counted(seeds.groupBy("node", "block").agg(F.bit_or("bits").alias("fresh")), n=F.count(F.lit(1)))
    tables, known, rows, last, n = [first], [first], seen["n"], first, seen["n"]
    while most is None or len(tables) <= most:
        if deal and n > FEW_ROWS:
            step, deal = deal(step), None
        moved = (F.broadcast(last) if deal else last).join(step, on).groupBy(F.col("next").alias("node"), "block").agg(F.bit_or("fresh").alias("fresh"), *([F.max("ahead").alias("ahead")] if enough else []))
        got, seen = counted(moved, n=F.count(F.lit(1)), ahead=F.sum("ahead") if enough else F.lit(0))
        if not seen["n"]:
            break
        last, n = _news(known, rows, got, seen["n"])
        if not n:
            break
        if enough and (seen["ahead"] or 0) > enough:
            return None
        last = last.select("node", "block", "fresh")
        rows += n
        tables.append(last)
        known.append(last)
        if len(known) > MOST_KNOWN:
            known = [cut(reduce(DataFrame.unionByName, known).groupBy("node", "block").agg(F.bit_or("fresh").alias("fresh")))]
    return tables


def united(tables: list[DataFrame]) -> DataFrame:
    """(node, block, bits) of all rounds: a place may have several rows, a member of it one."""
    return reduce(DataFrame.unionByName, tables).select("node", "block", F.col("fresh").alias("bits"))


def _held(rows: DataFrame, places: DataFrame, bits: str) -> DataFrame:
    """``rows`` with ``held``, the node_ids of the members of their bits, in place of block and bits."""
    block = places.groupBy("block").agg(F.collect_list(F.struct("bit", "node_id")).alias("members"))  # BITS at most
    held = F.transform(F.filter("members", lambda m: F.call_function("getbit", F.col(bits), m["bit"]) == 1), lambda m: m["node_id"])
    return rows.join(block, "block").select(*[c for c in rows.columns if c not in ("block", bits)], held.alias("held"))


def members_of(rows: DataFrame, places: DataFrame, bits: str = "bits") -> DataFrame:
    """``rows`` (node, block, ...) once for each member (target) of ``bits``, without block and bits."""
    found = _held(rows, places, bits)
    return found.select(*[c for c in found.columns if c != "held"], F.explode("held").alias("target"))


def member_lists(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(node, members): the sorted members of each node of ``rows`` (node, block, bits), gathered by blocks and not one by one."""
    return _held(rows, places, "bits").groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("held"))).alias("members"))
