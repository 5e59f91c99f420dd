"""The property graph: a table of nodes, a table of edges, and facts about both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphline.functions.labels import filled
from graphline.plans.iterate import counted, cut
from graphline.schema import EDGES, LIBRARY, NODES, UNKNOWN, conform


@dataclass
class PropertyGraph:
    """nodes: one row per node_id (NODES). edges: one row per (src, dst) (EDGES). meta: program, sources."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, unique: bool = False, **meta) -> PropertyGraph:
        """From tables with some of the columns; duplicate edges are merged (``unique``: there are none), missing endpoints are not added."""
        rows = conform(edges, EDGES)
        return PropertyGraph(conform(nodes, NODES), rows if unique else rows.dropDuplicates(["src", "dst"]), meta)

    # counts and degrees

    def counts(self) -> DataFrame:
        """One row: node_count, edge_count."""
        return self.nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(self.edges.agg(F.count(F.lit(1)).alias("edge_count")))

    def degrees(self) -> DataFrame:
        """node_id, in_degree, out_degree, degree for every node; a self-loop counts in both."""
        ends = self.edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1)))
        seen = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        zero = F.lit(0).cast("long")
        every = self.nodes.select("node_id").join(by_node(seen), "node_id", "left").select("node_id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))
        return every.withColumn("degree", F.col("in_degree") + F.col("out_degree"))

    def per_program(self) -> DataFrame:
        return self.nodes.groupBy(F.coalesce(filled("program"), F.lit(UNKNOWN)).alias("program")).agg(F.count(F.lit(1)).alias("node_count"))

    def per_layer(self) -> DataFrame:
        return per_layer(self.nodes)

    def programs(self) -> DataFrame:
        """Distinct programs in order."""
        return self.nodes.select(F.coalesce(filled("program"), F.lit(UNKNOWN)).alias("program")).distinct().orderBy("program")

    # subgraphs and unions

    def induced(self, keep: DataFrame) -> PropertyGraph:
        """The nodes whose node_id is in ``keep`` and the edges between them."""
        ids = keep.select("node_id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        return PropertyGraph(self.nodes.join(ids, "node_id", "left_semi"), edges.select(*self.edges.columns), dict(self.meta))

    def external_only(self) -> PropertyGraph:
        return self.induced(self.nodes.where(F.coalesce("is_external", F.lit(False))))

    def without(self, drop: DataFrame) -> DataFrame:
        """Nodes that aren't in ``drop``."""
        return self.nodes.join(drop.select("node_id"), "node_id", "left_anti")

    @staticmethod
    def compose(graphs: Sequence[PropertyGraph]) -> PropertyGraph:
        """Union: attributes of later graphs override, except by null; the order of first appearance stays."""
        tables = []
        for kind, keys, schema in (("nodes", ["node_id"], NODES), ("edges", ["src", "dst"], EDGES)):
            # rows are counted while they are written, so that parts grow in number and not in size
            rows, seen = counted(reduce(DataFrame.unionByName, [getattr(g, kind).withColumn("turn", F.lit(k)) for k, g in enumerate(graphs)]), n=F.count(F.lit(1)))
            tables.append(merged(rows, keys, list(schema), seen["n"]))
        return PropertyGraph(*tables, {"sources": [s for g in graphs for s in g.meta.get("sources", [])]})

    def dense_index(self) -> DataFrame:
        """node_id and idx from 0 in node order: counted per range partition first, so no task sorts all nodes."""
        rows = self.nodes.select("node_id", "ord").repartitionByRange("ord", "node_id").sortWithinPartitions("ord", "node_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
        rows = cut(rows.withColumn("nth", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        return rows.join(base, "part").select("node_id", (F.col("base") + F.col("nth")).alias("idx"))

    # the adapter's look-ups

    def neighbors(self, node: str, mode: str = "out") -> DataFrame:
        """node_id of successors (out) or predecessors (in)."""
        if mode not in ("in", "out"):
            raise ValueError(f"unknown mode: {mode}")
        at, to = ("src", "dst") if mode == "out" else ("dst", "src")
        return self.edges.where(F.col(at) == node).select(F.col(to).alias("node_id"))

    def in_degree_single(self, node: str) -> int:
        return self.edges.where(F.col("dst") == node).count()


def per_layer(nodes: DataFrame) -> DataFrame:
    """layer, node_count."""
    return nodes.groupBy(F.coalesce("layer", F.lit(LIBRARY)).alias("layer")).agg(F.count(F.lit(1)).alias("node_count"))


def by_node(df: DataFrame) -> DataFrame:
    """``df``, to be joined by sorting and never broadcast: ids compress so well in a table that ten million of them pass for less than 10 MB when a join is planned."""
    return df.hint("merge")


#: Rows that one task merges.
MERGED_ROWS = 1 << 20


def merged(rows: DataFrame, keys: list[str], names: list[str], n: int) -> DataFrame:
    """One row per key: each column's last value that isn't null, by turn and ord; ord is the first.

    Of ``n`` rows, at the most, as many parts are made as keep each to MERGED_ROWS. They are dealt before they are
    grouped: most keys occur once, so grouping them beforehand as well would sort all rows twice.
    """
    when = F.struct("turn", "ord")
    picked = [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in names if c not in (*keys, "ord")]
    first = F.min_by("ord", when).alias("ord")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // MERGED_ROWS))
    return rows.repartition(parts, *keys).groupBy(*keys).agg(*picked, first).select(*names)
