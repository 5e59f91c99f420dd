"""Auditing graph files and validating graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.functions.labels import filled
from graphline.model import by_node
from graphline.schema import SYSCALL


def audit(docs: DataFrame, base_dir: str = "") -> DataFrame:
    """path, relative_path, program, node_count, edge_count, status (ok, empty, error) and reason of each document."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    nodes = F.coalesce(size("functions"), size("nodes"), "node_count", F.lit(0).cast("long"))
    edges = F.coalesce(size("edges"), "edge_count", F.lit(0).cast("long"))
    inner = F.coalesce(filled(F.trim(F.try_variant_get("raw", "$.graph.program", "string"))), filled(F.array_join(F.try_variant_get("raw", "$.graph.programs", "array<string>"), ", ")))
    program = F.coalesce(inner, filled(F.trim("program")))
    bare = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = base_dir.rstrip("/") + "/"
    rows = docs.select("path", F.when(bare.startswith(base), F.substring(bare, len(base) + 1, 2**31 - 1)).otherwise(F.col("file_name")).alias("relative_path"), "parsed", program.alias("program"), nodes.alias("n"), edges.alias("m"))
    none = F.lit(0).cast("long")
    status = F.when(~F.col("parsed"), "error").when((F.col("n") == 0) | (F.col("m") == 0), "empty").otherwise("ok")
    reason = F.when(~F.col("parsed"), "not a JSON object").when(F.col("n") == 0, "no nodes").when(F.col("m") == 0, "no edges")
    return rows.select("path", "relative_path", F.when(F.col("parsed"), F.col("program")).alias("program"), F.when(F.col("parsed"), F.col("n")).otherwise(none).alias("node_count"), F.when(F.col("parsed"), F.col("m")).otherwise(none).alias("edge_count"), status.alias("status"), reason.alias("reason"))


def flagged(report: DataFrame) -> DataFrame:
    """What the audit didn't find ok."""
    return report.where("status <> 'ok'")


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(node_id, n) of ids that the raw node list has more than once."""
    return nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with an end that the node list doesn't declare."""
    ids = nodes.select("node_id").distinct()
    found = edges.select("src", "dst")
    for end in ("src", "dst"):
        found = found.join(by_node(ids.select(F.col("node_id").alias(end), F.lit(True).alias(f"has_{end}"))), end, "left")
    return found.where("has_src IS NULL OR has_dst IS NULL").select("src", "dst")


def dangling_count(nodes: DataFrame, edges: DataFrame) -> int:
    """How many edges ``dangling_edges`` has. Ends are looked up once each; edges are shuffled only where one is missing."""
    ends = edges.select(F.col("src").alias("node_id")).distinct().union(edges.select("dst").distinct())
    lost = ends.join(by_node(nodes.select("node_id")), "node_id", "left_anti")
    return 0 if lost.isEmpty() else dangling_edges(nodes, edges).count()


def ids_amiss(nodes: DataFrame, edges: DataFrame) -> tuple[int, int]:
    """How many ends of edges the node list doesn't declare, and how many ids it has more than once: both are told by one grouping of nodes and ends by id."""
    rows = nodes.select("node_id", F.lit(1).alias("declared"), F.lit(False).alias("end")).union(edges.select(F.explode(F.array("src", "dst")), F.lit(0), F.lit(True)))
    ids = rows.groupBy("node_id").agg(F.sum("declared").alias("n"), F.max("end").alias("end"))
    row = ids.agg(F.count_if(F.col("end") & ((F.col("n") == 0) | F.col("node_id").isNull())).alias("lost"), F.count_if(F.col("n") > 1).alias("twice")).first()
    return row["lost"], row["twice"]


def raw_lists(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node and edge lists of unified documents as they stand, before anything is merged or added."""
    n = docs.where("nodes IS NOT NULL").select(F.explode("nodes").alias("n")).select(F.coalesce(filled("n.id"), filled("n.node_id")).alias("node_id")).where("node_id IS NOT NULL")
    e = docs.where("nodes IS NOT NULL").select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst")).where("src <> '' AND dst <> ''")
    return n, e


def syscall_ratio(nodes: DataFrame, exports: DataFrame, ratio: float = 0.8, module: str = "NTDLL.DLL") -> DataFrame:
    """One row: expected (exports of the module that begin with NT), actual (nodes of the syscall layer), ok."""
    expected = exports.where((F.col("module") == module) & F.col("symbol_uc").startswith("NT")).agg(F.count_distinct("symbol_uc").alias("expected"))
    actual = nodes.agg(F.sum((F.col("layer") == SYSCALL).cast("long")).alias("actual"))
    return expected.crossJoin(actual).select("expected", F.coalesce("actual", F.lit(0).cast("long")).alias("actual")).withColumn("ok", (F.col("expected") == 0) | (F.col("actual") >= F.col("expected") * ratio))


def validate(docs: DataFrame, layers: DataFrame | None = None, exports: DataFrame | None = None, ratio: float = 0.8) -> list[str]:
    """Messages of what is wrong with unified documents; none if all is well. ``layers`` (node_id, layer) and ``exports`` add the ratio check."""
    nodes, edges = raw_lists(docs)
    found = []
    if n := duplicate_ids(nodes).count():
        found.append(f"{n} duplicate node ids")
    if n := dangling_count(nodes, edges):
        found.append(f"{n} dangling edges")
    if layers is not None and exports is not None:
        row = syscall_ratio(layers, exports, ratio).first()
        if not row["ok"]:
            found.append(f"{row['actual']} syscall nodes, expected {row['expected']} x {ratio}")
    return found
