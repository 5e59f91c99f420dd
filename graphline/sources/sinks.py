"""Writing graphs and reports.

A document is a folder of part files, which by name one after another are the
document: lines are dealt by range in their order, and every task writes its own
part. ``load_graph`` reads such a folder as one document. With ``single_file`` (for
graphs that one task can write) there is one part.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphline.functions.labels import display_label, filled, with_colour_index, with_size
from graphline.model import PropertyGraph
from graphline.schema import LIBRARY

SCHEMA_VERSION = "1.0"


def _write_lines(parts: list[DataFrame], path: str, single_file: bool) -> None:
    """Parts have (section, at, line)."""
    rows = reduce(DataFrame.unionByName, parts)
    ordered = rows.coalesce(1).sortWithinPartitions("section", "at") if single_file else rows.orderBy("section", "at")
    ordered.select("line").write.mode("overwrite").text(path)


def _line(rows: DataFrame, section: int, at: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), at.cast("string").alias("at"), line.alias("line"))


def _listed(rows: DataFrame, section: int, at: Column, value: Column) -> DataFrame:
    """Elements of a JSON list, with a comma before each but the first."""
    first = F.broadcast(rows.agg(F.min(at).alias("least")))  # one row
    return _line(rows.crossJoin(first), section, at, F.concat(F.when(at == F.col("least"), F.lit("")).otherwise(F.lit(",")), value))


def _head(graph: PropertyGraph, fields: dict[str, Column]) -> DataFrame:
    """The opening of a document: its facts, without the closing brace."""
    text = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    return _line(graph.counts(), 0, F.lit(""), F.regexp_replace(text, r"\}$", ',"nodes":['))


def write_json(graph: PropertyGraph, path: str, unified: bool = False, dlls: DataFrame | None = None, windows: dict[str, str] | None = None, single_file: bool = False) -> None:
    """Nodes with typed attributes, edges with their kind. ``unified`` adds version, layers, host facts and binaries."""
    nodes = graph.nodes.withColumn("id", F.col("node_id")).drop("node_id", "ord")
    node = F.to_json(F.struct("id", *[c for c in nodes.columns if c != "id"]))
    edge = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind"))
    programs = [r["program"] for r in graph.programs().collect()]  # one row per program
    fields = {"programs": F.array(*map(F.lit, programs)).cast("array<string>"), "sources": F.array(*map(F.lit, graph.meta.get("sources", []))).cast("array<string>"), "node_count": F.col("node_count"), "edge_count": F.col("edge_count")}
    if unified:
        layers = {r["layer"]: r["node_count"] for r in graph.per_layer().collect()}
        records = [] if dlls is None else [r.asDict() for r in dlls.collect()]  # one row per binary
        extra = {"schema_version": F.lit(SCHEMA_VERSION), "graph": F.lit(graph.meta.get("name", "unified")), "windows": F.parse_json(F.lit(json.dumps(windows or {}))), "dlls": F.parse_json(F.lit(json.dumps(records))), "layers": F.parse_json(F.lit(json.dumps(layers)))}
        fields = extra | fields
    middle = graph.nodes.sparkSession.range(1).select(F.lit(2).alias("section"), F.lit("").alias("at"), F.lit('],"edges":[').alias("line"))
    end = middle.select(F.lit(4).alias("section"), "at", F.lit("]}").alias("line"))
    _write_lines([_head(graph, fields), _listed(nodes, 1, F.col("id"), node), middle, _listed(graph.edges, 3, F.concat_ws("\0", "src", "dst"), edge), end], path, single_file)


def _escaped(c: Column) -> Column:
    for raw, told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(told))
    return c


def write_graphml(graph: PropertyGraph, path: str, single_file: bool = False) -> None:
    """GraphML with string attributes: nulls are left out, maps become JSON, lists are joined by commas."""
    skip = {"node_id", "src", "dst", "ord"}

    def data(df: DataFrame, prefix: str) -> tuple[list[str], Column]:
        names = [f.name for f in df.schema if f.name not in skip]
        kinds = {f.name: f.dataType.typeName() for f in df.schema}
        text = {n: F.array_join(n, ",") if kinds[n] == "array" else F.to_json(n) if kinds[n] in ("map", "struct") else F.col(n).cast("string") for n in names}
        return names, F.concat_ws("", *[F.when(text[n].isNotNull(), F.concat(F.lit(f'<data key="{prefix}_{n}">'), _escaped(text[n]), F.lit("</data>"))) for n in names])

    node_names, node_data = data(graph.nodes, "n")
    edge_names, edge_data = data(graph.edges, "e")
    keys = [f'<key id="{p}_{n}" for="{kind}" attr.name="{n}" attr.type="string"/>' for p, kind, names in (("n", "node", node_names), ("e", "edge", edge_names)) for n in names]
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrafting.org/xmlns">' + "".join(keys) + '<graph edgedefault="directed">'
    one = graph.nodes.sparkSession.range(1)
    node = F.concat(F.lit('<node id="'), _escaped(F.col("node_id")), F.lit('">'), node_data, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _escaped(F.col("src")), F.lit('" target="'), _escaped(F.col("dst")), F.lit('">'), edge_data, F.lit("</edge>"))
    _write_lines([_line(one, 0, F.lit(""), F.lit(head)), _line(graph.nodes, 1, F.col("node_id"), node), _line(graph.edges, 2, F.concat_ws("\0", "src", "dst"), edge), _line(one, 3, F.lit(""), F.lit("</graph></graphml>"))], path, single_file)


def write_tables(graph: PropertyGraph, path: str) -> None:
    """The form for large graphs: nodes and edges as Parquet."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_report(report: DataFrame, path: str, format: str = "json", single_file: bool = False) -> None:  # noqa: A002
    """An audit report: a JSON array, or a Markdown table (md, markdown)."""
    one = report.sparkSession.range(1)
    if format == "json":
        parts = [_line(one, 0, F.lit(""), F.lit("[")), _listed(report, 1, F.col("path"), F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"})), _line(one, 2, F.lit(""), F.lit("]"))]
    elif format in ("md", "markdown"):
        columns = ["relative_path", "program", "node_count", "edge_count", "status", "reason"]
        cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        parts = [_line(one, 0, F.lit("0"), F.lit("| " + " | ".join(columns) + " |")), _line(one, 0, F.lit("1"), F.lit("|" + " --- |" * len(columns))), _line(report, 1, F.col("path"), row)]
    else:
        raise ValueError(f"unknown report format: {format}")
    _write_lines(parts, path, single_file)


def write_csv(rows: DataFrame, path: str) -> None:
    """Coverage (label, program, coverage), orphans (label, program) or top nodes, as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def coverage_csv(report: DataFrame) -> DataFrame:
    return report.select("label", "program", F.col("n_covered").alias("coverage"))


def plot_data(graph: PropertyGraph, max_labels: int = 150) -> tuple[DataFrame, str]:
    """What a plot needs: nodes with size, colour and label (none beyond ``max_labels`` nodes), and the title."""
    n, m = graph.counts().first()
    if not n:
        raise ValueError("the graph has no nodes")
    nodes = with_size(graph.nodes.join(graph.degrees(), "node_id"), "plot")
    nodes = with_colour_index(nodes, 20, grey_unknown=False)
    text = display_label(False) if n <= max_labels else F.lit(None).cast("string")
    return nodes.select("node_id", F.coalesce(filled("program"), F.lit("unknown")).alias("program"), "degree", "size", "colour", text.alias("label")), f"{n} nodes, {m} edges"


def elements(graph: PropertyGraph, nodes: DataFrame, highlight_nodes: DataFrame, highlight_edges: DataFrame) -> DataFrame:
    """Rows for a graph widget: nodes (id, label, program, degree, size, hub, colour, classes), then edges (id main-edge-<i>, source, target, classes)."""
    on = highlight_nodes.select("node_id", F.lit(True).alias("lit")).distinct()
    marked = nodes.join(on, "node_id", "left").withColumn("layer", F.coalesce("layer", F.lit(LIBRARY)))
    text = F.concat_ws(" ", F.when(F.col("is_external"), "external"), F.when(F.col("hub"), "hub"), F.when(F.col("lit"), "highlight"))
    n = marked.select(F.lit("nodes").alias("group"), F.col("node_id").alias("id"), display_label().alias("label"), F.coalesce(filled("program"), F.lit("unknown")).alias("program"), "degree", "size", "hub", "colour", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), text.alias("classes"))
    hit = highlight_edges.select("src", "dst", F.lit(True).alias("lit")).distinct()
    numbered = PropertyGraph(graph.edges.select(F.concat_ws("\0", "src", "dst").alias("node_id"), "ord"), graph.edges).dense_index()
    e = graph.edges.join(hit, ["src", "dst"], "left").withColumn("key", F.concat_ws("\0", "src", "dst")).join(numbered.withColumnRenamed("node_id", "key"), "key")
    none = F.lit(None)
    e = e.select(F.lit("edges").alias("group"), F.concat(F.lit("main-edge-"), F.col("idx").cast("string")).alias("id"), none.cast("string").alias("label"), none.cast("string").alias("program"), none.cast("long").alias("degree"), none.cast("double").alias("size"), none.cast("boolean").alias("hub"), none.cast("int").alias("colour"), F.col("src").alias("source"), F.col("dst").alias("target"), F.when(F.col("lit"), "highlight").otherwise("").alias("classes"))
    return n.unionByName(e)
