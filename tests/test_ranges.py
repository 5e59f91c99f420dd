"""Documents cut into byte ranges give the rows of documents read whole."""

from __future__ import annotations

import json

import pytest
from graphs import function, module, three_modules, unified
from pyspark.sql import functions as F

from graphline.model import PropertyGraph
from graphline.sources import ranges, readers, sinks

KEYS = ("functions", "nodes", "edges")


def awkward(folder):
    """Strings with brackets, quotes and backslashes, other members before, between and behind, empty arrays, other shapes."""
    names = ['quote " in', "slash \\", 'both \\"', "[{", "}],", "colon: , comma", "中文 é \U0001f642", "\\\\\\\\", "tab\tnew\nline", ""]
    nodes = [{"id": f"n{k}", "name": n, "program": "P", "extra": {"deep": [1, [2, {"x": n}]]}, "tags": [n, n]} for k, n in enumerate(names)]
    edges = [{"source": f"n{k}", "target": f"n{(k * 3 + 1) % 12}", "kind": names[k]} for k in range(10)]
    first = {"notes": ["[", {"nodes": [{"id": "inner"}]}], "windows": {"a": "}", "b": "1,2"}, "graph": 'a "name" \\', "nodes": nodes, "layers": {}, "edges": edges, "after": [[], [[]], {}], "end": None}
    documents = {
        "compact": json.dumps(first, separators=(",", ":")), "indented": json.dumps(first, indent=3, ensure_ascii=False), "spaced": "  \n" + json.dumps(first, separators=(" ,\n", " :\n\t ")) + "\n\n",
        "empty": json.dumps({"program": 'pro"gram\\', "functions": [], "edges": []}), "calls": json.dumps({"functions": [function("0x1", 'f"1\\'), function("0x2", "[f2]")], "edges": [{"caller": "0x1", "callee": "0x2"}] * 3, "program": "Later"}),
    }
    for name, text in documents.items():
        (folder / f"{name}.callgraph.json").write_text(text, encoding="utf-8")
    return [str(folder / f"{name}.callgraph.json") for name in documents]


def facts(graph):
    rows = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())
    return rows(graph.nodes), rows(graph.edges)


@pytest.mark.parametrize("part_bytes", [1 << 20, 100, 13])
def test_ranges_agree_with_whole_documents(spark, tmp_path, monkeypatch, part_bytes):
    files = awkward(tmp_path) + ([unified(tmp_path), *three_modules(tmp_path)] if part_bytes > 13 else [])
    monkeypatch.setattr(ranges, "MOST_TASKS", 12)
    whole = facts(readers.load_graph(spark, files))
    monkeypatch.setattr(readers, "fits", lambda *_: False)
    assert facts(readers.load_graph(spark, files, part_bytes)) == whole
    found = ranges.elements(spark, files, KEYS, part_bytes)
    assert found.heads.where("parsed").count() == len(files)
    told = {(r["file"], r["key"]): r["n"] for r in found.rows.groupBy("file", "key").agg({"pos": "count"}).withColumnRenamed("count(pos)", "n").collect()}
    assert told[0, "nodes"] == told[1, "nodes"] == told[2, "nodes"] == 10 and (3, "functions") not in told and told[4, "edges"] == 3
    graph = {r["file"]: r["members"].get("graph") for r in found.heads.collect()}
    assert json.loads(graph[0]) == json.loads(graph[1]) == json.loads(graph[2]) == 'a "name" \\'


def test_broken_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "fits", lambda *_: False)
    for k, text in enumerate(['{"functions": [{"entry_point": "0x1"}', '[{"functions": []}]', '{"functions": ["a}', "", "{}", '{"nodes": {"a": 1}, "edges": []}', "nothing"]):
        path = tmp_path / f"b{k}.callgraph.json"
        path.write_text(text)
        with pytest.raises(ValueError, match="not a graph document"):
            readers.load_graph(spark, str(path), 8)


def test_one_document_in_many_tasks(spark, tmp_path):
    """A document larger than the bound is scanned by ranges, and its elements come from many of them."""
    path = module(tmp_path, "large", "LARGE.DLL", [function(hex(k), f"f{k}") for k in range(4000)], [(hex(k), hex(k * 7 % 4000)) for k in range(4000)])
    assert readers.fits(spark, [path], 1 << 20) and not readers.fits(spark, [path], 1 << 18)
    graph = readers.load_graph(spark, path, 1 << 16)
    assert graph.counts().first().asDict() == {"node_count": 4000, "edge_count": 4000}
    assert [r["address"] for r in graph.nodes.orderBy("ord").limit(3).collect()] == ["0x0", "0x1", "0x2"]
    assert ranges.ranges(spark, [path], 1 << 16).count() > 8


def test_a_document_of_several_parts(spark, tmp_path):
    """Every task writes its part; the folder is read as one document, its ranges cut across the parts."""
    nodes = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit('name "'), F.col("id").cast("string")).alias("name"), F.lit("P").alias("program"))
    edges = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 % 300).cast("string")).alias("dst"), F.lit("direct").alias("kind"))
    graph = PropertyGraph.of(nodes, edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_json(graph, str(tmp_path / "g"), unified=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "g").glob("part-*"))
    assert len(parts) > 2
    told = json.loads("".join(p.read_text() for p in parts))
    assert len(told["nodes"]) == len(told["edges"]) == told["edge_count"] == 300
    for part_bytes in (1 << 20, 2000):
        again = readers.load_graph(spark, str(tmp_path / "g"), part_bytes)
        picked = lambda g: (sorted(map(tuple, g.nodes.select("node_id", "name", "program").collect())), sorted(map(tuple, g.edges.select("src", "dst", "kind").collect())))
        assert picked(again) == picked(graph)


def test_documents_are_not_numbered_in_one_task(spark, tmp_path):
    three_modules(tmp_path)
    docs = readers.with_order(readers.documents(spark, str(tmp_path), readers.GRAPH_GLOB))
    assert {r["file_name"]: r["file"] for r in docs.select("file_name", "file").collect()} == {"crate.dll.callgraph.json": 0, "ntdll.dll.callgraph.json": 1, "shelf.dll.callgraph.json": 2}
    assert "SinglePartition" not in docs._jdf.queryExecution().executedPlan().toString()
