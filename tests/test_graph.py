"""Operators on small graphs, against values derived by hand and brute force."""

from __future__ import annotations

import json
import random
from itertools import pairwise

import numpy as np
import pytest
from graphs import function, module, three_modules, unified
from pyspark.sql import functions as F

from graphline.model import PropertyGraph
from graphline.operators import centrality, condense, cover, quality, reach, spread, structure
from graphline.operators.explore import explore
from graphline.operators.unify import unify
from graphline.plans import iterate
from graphline.sources import readers, sinks
from graphline.streaming import ingest


def column(df, name="node_id"):
    return [r[name] for r in df.collect()]


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    return readers.load_graph(spark, three_modules(tmp_path_factory.mktemp("m")))


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    return readers.load_graph(spark, unified(tmp_path_factory.mktemp("u")))


def test_merged_modules(merged):
    assert merged.counts().first().asDict() == {"node_count": 10, "edge_count": 6}
    assert column(merged.programs(), "program") == ["CRATE.DLL", "NTDLL.DLL", "SHELF.DLL"]
    assert column(merged.nodes.orderBy("ord")) == [f"SHELF.DLL:{a}" for a in ("0xa0", "0xa1", "0xa2", "0xaf")] + [f"CRATE.DLL:{a}" for a in ("0xb0", "0xb1", "0xb2")] + [f"NTDLL.DLL:{a}" for a in ("0xc0", "0xc1", "0xc2")]


def test_targets_orphans_and_cover(merged):
    doors = {"NTDLL.DLL:0xc0", "NTDLL.DLL:0xc1"}
    assert set(column(cover.unreferenced_targets(merged))) == doors
    assert set(column(cover.unreferenced_targets(merged, program_hint=None))) == doors
    assert column(cover.unreferenced_targets(merged, prefixes=())) == []
    assert set(column(cover.target_set(merged)[0])) == doors
    assert set(column(cover.target_set(merged, program_hint=None)[0])) == doors | {"SHELF.DLL:0xaf", "CRATE.DLL:0xb1"}
    assert cover.target_set(merged, prefixes=(), program_hint=None)[0].count() == 10
    found, missing = cover.target_set(merged, ["RtlCount", "nope", "NTDLL.DLL:0xc0"])
    assert set(column(found)) == {"NTDLL.DLL:0xc2", "NTDLL.DLL:0xc0"} and column(missing, "name") == ["nope"]
    shelf, crate = ["SHELF.DLL:0xa0", "SHELF.DLL:0xa1", "SHELF.DLL:0xa2"], ["CRATE.DLL:0xb0", "CRATE.DLL:0xb2"]
    assert column(cover.orphans(merged)) == shelf + crate
    assert [(r["node_id"], r["n_covered"], r["covered"]) for r in cover.coverage_report(merged).collect()] == [(n, 0, []) for n in shelf + crate]
    told = [(r["node_id"], r["n_covered"], r["covered"]) for r in cover.coverage_report(merged, program_hint=None).collect()]
    assert told == [(n, 1, ["SHELF.DLL:0xaf"]) for n in shelf] + [(crate[0], 1, ["CRATE.DLL:0xb1"]), (crate[1], 0, [])]
    assert column(cover.orphans(merged, program_hint=None)) == [crate[1]]
    nothing = cover.greedy_cover(merged)
    assert nothing.hooks.count() == 0 and set(column(nothing.uncovered)) == doors
    two = cover.greedy_cover(merged, program_hint=None)
    assert [(r["step"], r["node_id"], r["gain"]) for r in two.hooks.collect()] == [(1, crate[0], 1), (2, shelf[0], 1)]
    assert set(column(two.uncovered)) == doors
    assert column(cover.orphans(merged, programs=["NTDLL.DLL"])) == ["NTDLL.DLL:0xc0", "NTDLL.DLL:0xc1", "NTDLL.DLL:0xc2"]
    assert cover.candidates(merged, ["ntdll.dll"]).count() == 0
    # a filter replaces the default and the programs
    assert cover.greedy_cover(merged, program_hint=None, programs=["x"], candidate_filter=F.col("name") == "PackCrate").hooks.count() == 1


OPENS, LOCKS, FINDS, DOOR, CALL, ALONE = "SHELF.DLL!OpenShelf", "SHELF.DLL!LockShelf", "SHELF.DLL!FindShelf", "NTDLL.DLL!NtOpenDoor", "SYSCALL:NtOpenDoor", "CRATE.DLL!PackCrate"


def test_unified_document(sample):
    assert {r["layer"]: r["node_count"] for r in sample.per_layer().collect()} == {"library": 5, "syscall": 1}
    degree = {r["node_id"]: r["degree"] for r in sample.degrees().collect()}
    assert degree == {OPENS: 3, LOCKS: 3, FINDS: 2, DOOR: 3, CALL: 1, ALONE: 0}
    row = reach.shortest_path(sample, OPENS, CALL).first()
    assert row["hops"] == 3 and row["path"] == [OPENS, FINDS, DOOR, CALL]
    assert reach.shortest_paths(sample, LOCKS, FINDS) == [LOCKS, OPENS, FINDS]
    with pytest.raises(ValueError, match="no path"):
        reach.shortest_paths(sample, CALL, OPENS)
    assert [reach.k_hop_inbound(sample, CALL, d)[0].count() for d in (1, 2, 3)] == [2, 4, 5]
    outside = sample.external_only()
    assert set(column(outside.nodes)) == {ALONE, CALL} and outside.edges.count() == 0
    assert sorted(column(structure.component_sizes(sample), "size")) == [1, 5]
    assert {r["node_id"]: r["betweenness"] for r in centrality.betweenness(sample).collect()} == {OPENS: 1.0, LOCKS: 1.0, FINDS: 1.0, DOOR: 3.0, CALL: 0.0, ALONE: 0.0}
    assert set(column(structure.top_k_subgraph(sample, 3).nodes)) == {OPENS, LOCKS, DOOR}
    hooks = cover.greedy_cover(sample).hooks.collect()
    assert [(h["node_id"], h["covered"]) for h in hooks] == [(FINDS, [DOOR])]
    assert reach.shortest_path(sample, CALL, OPENS).first()["hops"] is None
    assert "identical" in reach.shortest_path(sample, CALL, CALL).first()["message"]
    assert reach.shortest_path(sample, "nobody", CALL).first()["path"] is None
    assert {(r["node"], r["component"]) for r in condense.strong_components(sample.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()} == {(OPENS, LOCKS), (LOCKS, LOCKS)}


def test_odd_documents(spark, tmp_path):
    path = module(tmp_path, "odd", None, [function(None, "skipped"), function("0x1", ""), function("0x1", "later"), function("0x2", "loop")], [("0x2", "0x2"), ("0x2", "0x9"), ("0x2", "0x9"), (None, "0x1")])
    g = readers.load_graph(spark, path)
    nodes = {r["node_id"]: r for r in g.nodes.collect()}
    assert set(nodes) == {"odd.callgraph:0x1", "odd.callgraph:0x2", "odd.callgraph:0x9"}
    assert nodes["odd.callgraph:0x1"]["name"] == "later" and nodes["odd.callgraph:0x9"]["is_external"] and nodes["odd.callgraph:0x9"]["name"] is None
    assert g.edges.count() == 2
    assert {r["node_id"]: (r["in_degree"], r["degree"]) for r in g.degrees().collect()}["odd.callgraph:0x2"] == (1, 3)
    (tmp_path / "bad.callgraph.json").write_text("{nope")
    with pytest.raises(ValueError):
        readers.load_graph(spark, str(tmp_path / "bad.callgraph.json"))


def test_compose_keeps_names_against_nulls(spark, tmp_path):
    a = module(tmp_path, "a", "P", [function("0x1", "real")], [])
    b = module(tmp_path, "b", "P", [function("0x5", "x")], [("0x5", "0x1")])
    g = readers.load_graph(spark, [a, b])
    assert {r["node_id"]: r["name"] for r in g.nodes.collect()}["P:0x1"] == "real"


def test_audit_and_reports(spark, tmp_path):
    three_modules(tmp_path)
    unified(tmp_path)
    (tmp_path / "zbad.callgraph.json").write_text("{")
    (tmp_path / "zlist.callgraph.json").write_text("[1]")
    docs = readers.documents(spark, str(tmp_path), readers.GRAPH_GLOB)
    report = quality.audit(docs, str(tmp_path)).orderBy("relative_path")
    told = [(r["relative_path"], r["status"], r["node_count"], r["edge_count"], r["reason"], r["program"]) for r in report.collect()]
    assert told == [
        ("crate.dll.callgraph.json", "ok", 3, 1, None, "CRATE.DLL"), ("ntdll.dll.callgraph.json", "empty", 3, 0, "no edges", "NTDLL.DLL"),
        ("shelf.dll.callgraph.json", "ok", 4, 5, None, "SHELF.DLL"), ("unified.callgraph.json", "ok", 6, 6, None, None),
        ("zbad.callgraph.json", "error", 0, 0, "not a JSON object", None), ("zlist.callgraph.json", "error", 0, 0, "not a JSON object", None),
    ]
    sinks.write_report(report, str(tmp_path / "json"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    assert [x["status"] for x in json.loads(text)] == ["ok", "empty", "ok", "ok", "error", "error"]
    sinks.write_report(report, str(tmp_path / "md"), "md")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*"))).splitlines()
    assert len(lines) == 8 and lines[1].startswith("| ---")
    with pytest.raises(ValueError):
        sinks.write_report(report, str(tmp_path / "x"), "yaml")
    excluded = tmp_path / "excluded.json"
    excluded.write_text(json.dumps([{"relative_path": "ntdll.dll.callgraph.json"}, {"path": f"{tmp_path}/shelf.dll.callgraph.json"}, 5]))
    out = readers.excluded_paths(spark, str(excluded), str(tmp_path))
    left = [p.rpartition("/")[2] for p in column(readers.list_graph_files(spark, str(tmp_path), out), "path")]
    assert left == ["crate.dll.callgraph.json", "unified.callgraph.json", "zbad.callgraph.json", "zlist.callgraph.json"]
    assert readers.list_graph_files(spark, str(tmp_path), modules=["NTDLL.DLL"]).count() == 1


def test_json_round_trip(spark, sample, tmp_path):
    sinks.write_json(sample, str(tmp_path / "g"), unified=True)
    parts = sorted((tmp_path / "g").glob("part-*"))
    told = json.loads("".join(p.read_text() for p in parts))
    assert told["layers"] == {"library": 5, "syscall": 1} and told["node_count"] == 6 and len(told["edges"]) == 6
    again = readers.load_graph(spark, str(tmp_path / "g"), 300)
    assert again.counts().first() == sample.counts().first()
    assert again.external_only().nodes.count() == 2
    assert {(r["src"], r["dst"], r["kind"]) for r in again.edges.collect()} == {(r["src"], r["dst"], r["kind"]) for r in sample.edges.collect()}
    import xml.etree.ElementTree as ET

    sinks.write_graphml(sample, str(tmp_path / "x"))
    root = ET.fromstring("".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*"))))
    assert len(root.findall(".//{*}node")) == 6 and len(root.findall(".//{*}edge")) == 6


def test_unify(spark, tmp_path):
    m = tmp_path / "meta"
    m.mkdir()
    doc = lambda exports, imports: json.dumps({"exports": [{"name": e} for e in exports], "imports": [{"module": k, "functions": [{"name": f} for f in v]} for k, v in imports.items()]})
    alias = "api-ms-door-l1-1-0.dll"
    (m / "shelf.dll.json").write_text(doc(["OpenShelf"], {alias: ["OpenDoor"]}))
    (m / "latch.dll.json").write_text(doc(["OpenDoor"], {"ntdll.dll": ["NtOpenDoor"]}))
    (m / "ntdll.dll.json").write_text(doc(["NtOpenDoor"], {}))
    (m / f"{alias}.json").write_text(doc(["OpenDoor"], {"latch.dll": ["OpenDoor"]}))
    files = [
        module(tmp_path, "shelf.dll", "SHELF.DLL", [function("0xa0", "OpenShelf"), function("0xa1", "OpenDoor", "IMPORTED"), function("0xa2", "OpenDoor", "IMPORTED")], [("0xa0", "0xa1")]),
        module(tmp_path, "latch.dll", "LATCH.DLL", [function("0xb0", "OpenDoor"), function("0xb1", "NtOpenDoor", "IMPORTED")], [("0xb0", "0xb1")]),
        module(tmp_path, "ntdll.dll", "NTDLL.DLL", [function("0xc0", "NtOpenDoor"), function("0xc1", "RtlCount")], []),
    ]
    for order in (files, files[::-1]):
        docs = readers.with_order(readers.documents(spark, order), order)
        found = unify(docs, readers.metadata(spark, str(m)))
        assert set(column(found.graph.nodes)) == {
            "SHELF.DLL!OpenShelf", "SHELF.DLL!OpenDoor", "SHELF.DLL!OpenDoor@0xa2", "LATCH.DLL!OpenDoor", "LATCH.DLL!NtOpenDoor", "NTDLL.DLL!NtOpenDoor", "API-MS-DOOR-L1-1-0.DLL!OpenDoor", "SYSCALL:NtOpenDoor",
        }
        kinds = sorted(column(found.graph.edges, "kind"))
        assert kinds == ["forwarder"] * 4 + ["import"] * 2 + ["syscall"]
        assert reach.shortest_path(found.graph, "SHELF.DLL!OpenShelf", "SYSCALL:NtOpenDoor").first()["hops"] == 3
        assert found.unresolved.count() == 0
    alone = unify(readers.with_order(readers.documents(spark, files), files), readers.metadata(spark, str(m)).where("false"))
    assert alone.graph.nodes.count() == 3 and alone.graph.edges.count() == 0
    assert {(r["module"], r["symbol"], r["n_refs"]) for r in alone.unresolved.collect()} == {("SHELF.DLL", "OpenDoor", 2), ("LATCH.DLL", "NtOpenDoor", 1)}


def test_validate(spark, tmp_path):
    good = readers.documents(spark, unified(tmp_path))
    assert quality.validate(good) == []
    told = json.loads((tmp_path / "unified.callgraph.json").read_text())
    told["nodes"].append(told["nodes"][0])
    told["edges"].append({"source": told["nodes"][0]["id"], "target": "gone"})
    (tmp_path / "broken.callgraph.json").write_text(json.dumps(told))
    assert quality.validate(readers.documents(spark, str(tmp_path / "broken.callgraph.json"))) == ["1 duplicate node ids", "1 dangling edges"]
    nodes = readers.load_graph(spark, str(tmp_path / "unified.callgraph.json")).nodes
    exports = spark.createDataFrame([("NTDLL.DLL", f"NTX{k}") for k in range(2)], "module string, symbol_uc string")
    assert quality.validate(good, nodes, exports) == ["1 syscall nodes, expected 2 x 0.8"]


def test_explore(sample):
    view = explore(sample, limit=3, focus=CALL, start=OPENS, size_mode="degree")
    assert view.focus_message == "5 functions within 3 hops can reach NtOpenDoor."
    assert view.path_message == "Shortest path length: 3 hops." and view.path == [OPENS, FINDS, DOOR, CALL]
    assert [(r["hops"], r["path"]) for r in view.paths.collect()] == [
        (1, "NtOpenDoor → NtOpenDoor"), (2, "LockShelf → NtOpenDoor → NtOpenDoor"), (2, "FindShelf → NtOpenDoor → NtOpenDoor"), (3, "OpenShelf → FindShelf → NtOpenDoor → NtOpenDoor"),
    ]
    rows = view.elements.collect()
    assert sum(r["group"] == "edges" for r in rows) == 3 and all("highlight" in r["classes"] for r in rows if r["group"] == "edges")
    assert explore(sample, focus="nope").focus_message == "Focus function is currently filtered out."
    assert explore(sample, external_only=True).options.count() == 2


def test_stream(spark, tmp_path):
    arrivals = tmp_path / "in"
    arrivals.mkdir()
    for names in (["shelf.dll"], ["crate.dll", "ntdll.dll"]):
        made = three_modules(tmp_path)
        for path in made:
            if any(path.endswith(f"/{n}.callgraph.json") for n in names):
                (arrivals / path.rpartition("/")[2]).write_text(open(path).read())
        ingest.follow(spark, str(arrivals), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    g = ingest.current(spark, str(tmp_path / "out"))
    assert g.counts().first().asDict() == {"node_count": 10, "edge_count": 6}


def brute_closure(nodes, edges):
    to = {n: {b for a, b in edges if a == n} for n in nodes}
    found = set()
    for n in nodes:
        seen, todo = set(), list(to[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to[x]
        found |= {(n, x) for x in seen if x != n}
    return found


def brute_paths(nodes, edges):
    """The shortest path of each pair of two nodes, of several the smallest."""
    found = {}
    for a in nodes:
        paths, seen = [[a]], {a}
        while paths:
            longer = sorted(p + [y] for p in paths for x, y in edges if x == p[-1] and y not in seen)
            paths = []
            for p in longer:
                if (a, p[-1]) not in found:
                    found[a, p[-1]] = p
                    paths.append(p)
            seen |= {p[-1] for p in paths}
    return found


def brute_betweenness(nodes, edges):
    out = {n: sorted({b for a, b in edges if a == n and b != n}) for n in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        paths, level = {s: [[s]]}, {s}
        while level:
            fresh = {}
            for x in sorted(level):
                for y in out[x]:
                    if y not in paths:
                        fresh.setdefault(y, []).extend(p + [y] for p in paths[x])
            paths |= fresh
            level = set(fresh)
        for t, ps in paths.items():
            for p in ps:
                for v in p[1:-1] if t != s else []:
                    score[v] += 1 / len(ps)
    return score


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{k:02d}" for k in range(14)]
    edges = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(22)})
    names = {n: ("Nt" if rng.random() < 0.4 else "f") + n for n in ids}
    nodes = spark.createDataFrame([(n, "ntdll.dll" if names[n].startswith("Nt") else "P", names[n], "DEFAULT") for n in ids], "node_id string, program string, name string, source string")
    g = PropertyGraph.of(nodes, spark.createDataFrame(edges, "src string, dst string"))
    pairs = brute_closure(ids, edges)
    assert {(r["node"], r["target"]) for r in reach.ancestors(g, g.nodes).collect()} == pairs
    for condensing in (True, False):
        sets, places = reach.reach_sets(g.edges, g.nodes, condense=condensing)
        assert {(r["node"], r["target"]) for r in reach.reach_pairs(sets, places).collect()} == pairs
        counts = {r["node"]: r["n"] for r in reach.reach_counts(sets, places).collect()}
        assert counts == {n: k for n in ids if (k := sum(a == n for a, _ in pairs))}
    strong = {n: min({n} | {m for m in ids if (n, m) in pairs and (m, n) in pairs}) for n in ids}
    cyclic = {n: c for n, c in strong.items() if sum(x == c for x in strong.values()) > 1}
    assert {r["node"]: r["component"] for r in condense.strong_components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()} == cyclic
    targets = {n for n in ids if names[n].startswith("Nt")}
    reaching = {n: {t for a, t in pairs if a == n and t in targets} for n in ids if n not in targets}
    assert {r["node_id"]: set(r["covered"]) for r in cover.coverage_report(g).collect()} == reaching
    assert set(column(cover.orphans(g))) == {n for n, c in reaching.items() if not c}
    result = cover.greedy_cover(g)
    gains = column(result.hooks, "gain")
    assert all(a >= b for a, b in pairwise(gains)) and sum(gains) + result.uncovered.count() == len(targets)
    assert set(column(result.uncovered)) == targets - set().union(*reaching.values())
    expected = brute_betweenness(ids, edges)
    for found in (centrality.betweenness(g), centrality.betweenness_by_joins(g, most_pairs=30, first_batch=3)):
        assert {r["node_id"]: round(r["betweenness"], 9) for r in found.collect()} == {n: round(x, 9) for n, x in expected.items()}
    ranks = centrality.pagerank(g, tolerance=1e-9, most=60)
    assert abs(sum(column(ranks, "rank")) - 1) < 1e-9
    groups = {n: {n} for n in ids}
    for a, b in edges:
        both = groups[a] | groups[b]
        for x in both:
            groups[x] = both
    assert {r["node_id"]: r["component"] for r in structure.weak_components(g).collect()} == {n: min(s) for n, s in groups.items()}
    shortest = brute_paths(ids, edges)
    for a, b in ((ids[0], ids[5]), (ids[3], ids[9]), *rng.sample(sorted(shortest), 2)):
        row = reach.shortest_path(g, a, b).first()
        assert row["path"] == shortest.get((a, b)) and row["hops"] == (len(shortest[a, b]) - 1 if (a, b) in shortest else None)
    told = {r["node_id"]: (r["depth"], r["next"]) for r in reach.parents(g, ids[4]).collect()}
    assert told == {ids[4]: (0, None)} | {a: (len(p) - 1, p[1]) for (a, b), p in shortest.items() if b == ids[4]}
    near = {r["node_id"]: (r["hops"], r["path"]) for r in reach.inbound_paths(g, ids[4], 2, most=50).collect()}
    assert near == {a: (len(p) - 1, " → ".join(names[x] for x in p)) for (a, b), p in shortest.items() if b == ids[4] and len(p) < 4}


def test_cover_in_batches(spark):
    """However few candidates pass through the driver at once, the picks are those of the plain greedy."""
    rng = random.Random(5)
    reach_of = {f"c{k:02d}": {f"t{rng.randrange(30):02d}" for _ in range(rng.randrange(1, 9))} for k in range(12)}
    targets = sorted(set().union(*reach_of.values()))
    expected, covered = [], set()
    while left := max(len(s - covered) for s in reach_of.values()):
        best = min(n for n, s in reach_of.items() if len(s - covered) == left)
        expected.append((best, left))
        covered |= reach_of[best]
    nodes = [(n, "P", n, "DEFAULT") for n in reach_of] + [(t, "Q", t, None) for t in targets]
    g = PropertyGraph.of(spark.createDataFrame(nodes, "node_id string, program string, name string, source string"), spark.createDataFrame([(n, t) for n, s in reach_of.items() for t in s], "src string, dst string"))
    aims = spark.createDataFrame([(t,) for t in targets], "node_id string")
    for some in ({}, {"batch": 3}, {"batch_pairs": 12}):
        hooks = cover.greedy_cover(g, targets=aims, **some).hooks.orderBy("step").collect()
        assert [(h["node_id"], h["gain"]) for h in hooks] == expected
        assert set().union(*(h["covered"] for h in hooks)) == set(targets)


def test_cover_of_many_copies_takes_no_more_rounds(spark, monkeypatch):
    """Candidates that are best at all of their targets are picked together, so that rounds don't follow the size; one that is a target itself doesn't cover itself."""
    rng = random.Random(6)
    one = {f"c{k:02d}": {f"t{rng.randrange(12):02d}" for _ in range(rng.randrange(1, 5))} for k in range(6)}
    rounds = {}
    monkeypatch.setattr(cover, "FEW_PICKS", 1, raising=False)
    for copies in (1, 5):
        reach_of = {f"{n}-{i:02d}": {f"{t}-{i:02d}" for t in s} for n, s in one.items() for i in range(copies)}
        targets = sorted(set().union(*reach_of.values()))
        expected, covered = [], set()
        while left := max(len(s - covered) for s in reach_of.values()):
            best = min(n for n, s in reach_of.items() if len(s - covered) == left)
            expected.append((best, left))
            covered |= reach_of[best]
        nodes = [(n, "P", n, "DEFAULT") for n in reach_of] + [(t, "Q", t, None) for t in targets]
        g = PropertyGraph.of(spark.createDataFrame(nodes, "node_id string, program string, name string, source string"), spark.createDataFrame([(n, t) for n, s in reach_of.items() for t in s], "src string, dst string"))
        aims = spark.createDataFrame([(t,) for t in [*targets, "c00-00"]], "node_id string")
        tables = []
        with monkeypatch.context() as patch:
            patch.setattr(cover, "cut", lambda df: tables.append(1) or iterate.cut(df))
            result = cover.greedy_cover(g, targets=aims, batch=4, batch_pairs=12)
        assert [(h["node_id"], h["gain"]) for h in result.hooks.orderBy("step").collect()] == expected
        assert column(result.uncovered) == ["c00-00"]
        rounds[copies] = len(tables)
    assert rounds[5] <= 2 * rounds[1]


def test_unified_functions_stay_dealt(spark, tmp_path):
    """Stubs and ids are joined by module and symbol as they lie, and aren't shuffled for it."""
    module(tmp_path, "a", "A.DLL", [function("0x1", "Open"), function("0x2", "Shut", "IMPORTED")], [("0x1", "0x2")])
    meta = spark.createDataFrame([("A.DLL", [("b.dll", [("Shut",)])], [("Open",)])], "module string, imports array<struct<module: string, functions: array<struct<name: string>>>>, exports array<struct<name: string>>")
    found = unify(readers.with_order(readers.documents(spark, str(tmp_path), "*.json")), meta)
    assert [(r["src"], r["dst"]) for r in found.leads.collect()] == [("A.DLL!Shut", "B.DLL!Shut")]
    for rows in (found.stubs, found.named):
        plan = rows.groupBy("module", "symbol_uc").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_inputs_are_resolved(spark, tmp_path):
    def module(path, name):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"program": name, "functions": [{"entry_point": "0x1", "name": "f"}, {"entry_point": "0x2", "name": "g"}], "edges": [{"caller": "0x1", "callee": "0x2"}]}))
        return str(path)

    spaced, plain = module(tmp_path / "my graph+1 %.callgraph.json", "A"), module(tmp_path / "a.callgraph.json", "B")
    below, folder = module(tmp_path / "x" / "a.callgraph.json", "C"), module(tmp_path / "y" / "b.callgraph.json", "D")
    (tmp_path / "y" / "other.json").write_text("{}")
    (tmp_path / "empty").mkdir()
    programs = lambda *paths: sorted({r["program"] for r in readers.load_graph(spark, list(paths)).nodes.collect()})
    assert programs(spaced) == ["A"] and programs(plain, below) == ["B", "C"] and programs(plain, plain) == ["B"]
    assert programs(str(tmp_path / "y"), spaced) == ["A", "D"] and programs(folder) == ["D"]
    for bad in (str(tmp_path / "none.callgraph.json"), str(tmp_path / "empty")):
        with pytest.raises(FileNotFoundError):
            readers.load_graph(spark, [plain, bad])


def test_target_names_without_shuffled_joins(spark):
    """Names are looked up without a shuffle of the nodes: unions of such joins fail on large tables, where shuffles are coalesced unlike."""
    g = PropertyGraph.of(spark.createDataFrame([("a", "x"), ("b", "x"), ("x", "y"), ("c", None)], "node_id string, name string"), spark.createDataFrame([], "src string, dst string"))
    found, missing = cover.target_set(g, ["x", "y", "c", "gone"])
    assert {r[0] for r in found.collect()} == {"x", "c"} and [r[0] for r in missing.collect()] == ["gone"]
    found, _ = cover.target_set(PropertyGraph(g.nodes.where("node_id <> 'x'"), g.edges), ["x"])
    assert {r[0] for r in found.collect()} == {"a", "b"}
    assert all("SortMergeJoin" not in t._jdf.queryExecution().toString() for t in (found, missing))


def test_betweenness_touches_what_a_source_reaches():
    """A search from one source leaves other nodes alone, so its cost is that of what it reaches and not of the graph."""
    first, to = np.array([0, 1, 2, 2, 3, 3]), np.array([1, 2, 4])  # 0 -> 1 -> 2, 3 -> 4
    total, state = np.zeros(5), (np.full(5, -1), np.zeros(5), np.zeros(5))
    state[0][3:], state[1][3:] = 7, np.nan  # marks that a search over all nodes would wipe out or spread
    centrality._add_dependencies(0, first, to, total, state)
    assert total.tolist() == [0, 1, 0, 0, 0]
    assert state[0].tolist() == [-1, -1, -1, 7, 7] and state[1][:3].tolist() == [0, 0, 0] and state[2].tolist() == [0] * 5


def test_components_apart_are_found_together(spark, monkeypatch):
    """Cycles that stand apart take one round, and counts write no set out for the nodes of a component."""
    edges = [(f"{k}{a}", f"{k}{b}") for k in range(5) for a, b in (("a", "b"), ("b", "a"), ("b", "c"))]
    g = PropertyGraph.of(spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e})], "node_id string"), spark.createDataFrame(edges, "src string, dst string"))
    calls, real = [], condense.spread
    monkeypatch.setattr(condense, "spread", lambda *a, **k: calls.append(1) or real(*a, **k))
    counts = {r["node"]: r["n"] for r in reach.reach_totals(g.edges, g.nodes).collect()}
    assert counts == {f"{k}{x}": 2 for k in range(5) for x in "ab"} and len(calls) == 1


def test_rounds_write_what_is_new(spark):
    """A layered graph is passed once: no round writes again what an earlier one has, and many targets need no components."""
    step = spark.createDataFrame([("d", "c"), ("d", "b"), ("c", "b"), ("b", "a")], "node string, next string")
    tables = spread.spread(step, spark.createDataFrame([("d", 0, 1)], "node string, block long, bits long"))
    assert [sorted(column(t, "node")) for t in tables] == [["d"], ["b", "c"], ["a"]]
    full = step.withColumn("ahead", F.lit(5).cast("long"))
    assert spread.spread(full, spark.createDataFrame([("d", 0, 1)], "node string, block long, bits long"), enough=3) is None


def test_nodes_are_not_broadcast(spark, monkeypatch):
    """Joins over all nodes aren't left to the estimate of their size, which is far too small for well compressed ids."""
    g = PropertyGraph.of(spark.createDataFrame([("a", "P"), ("b", "Q")], "node_id string, program string"), spark.createDataFrame([("a", "b")], "src string, dst string"))
    g = PropertyGraph(iterate.cut(g.nodes), iterate.cut(g.edges))
    plans, real = [structure.top_degree(g, 2)], structure.cut
    monkeypatch.setattr(structure, "cut", lambda df, *f: plans.append(df) or real(df, *f))
    assert set(column(structure.balanced_sample(g, 2))) == {"a", "b"}
    assert all("SortMergeJoin [node_id" in t._jdf.queryExecution().executedPlan().toString() for t in plans)
    assert "BroadcastHashJoin" not in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_documents_are_not_shuffled_for_their_order(spark, tmp_path):
    three_modules(tmp_path)
    docs = readers.with_order(readers.documents(spark, str(tmp_path), "*.json"))
    assert sorted(r["file"] for r in docs.select("file").collect()) == [0, 1, 2]
    assert "Exchange hashpartitioning" not in docs._jdf.queryExecution().executedPlan().toString()


def test_unify_plans_what_is_asked_for(spark):
    """Documents of a table are parsed once, and nodes alone need no edges."""
    texts = [
        ("a.dll", '{"program": "a.dll", "functions": [{"entry_point": "1", "name": "Run"}, {"entry_point": "2", "name": "Go", "source": "IMPORTED"}, {"entry_point": "3", "name": "Lost", "source": "IMPORTED"}], "edges": [{"caller": "1", "callee": "2"}, {"caller": "1", "callee": "3"}, {"caller": "1", "callee": null}]}', 1),
        ("b.dll", ' \n{"program": "b.dll", "functions": [{"entry_point": "1", "name": "go"}]}', 0),
        ("bad", "{", 2), ("list", '[{"functions": []}]', 3), ("other", '{"nodes": [], "edges": []}', 4),
    ]
    docs = readers.documents_of(spark.createDataFrame(texts, "path string, value string, file int"))
    assert [r["parsed"] for r in docs.orderBy("file").collect()] == [True, True, False, False, True]
    functions, calls, n = readers.module_lists(docs)
    assert n == 7
    for rows in (functions, calls):
        assert "from_json" not in rows._jdf.queryExecution().toString()
    assert functions.count() == readers.module_functions(docs).count() == 4 and calls.count() == readers.module_edges(docs).count() == 2
    meta = spark.createDataFrame([("A.DLL", [("b", [("Go",)])], [("Run",)], None), ("B.DLL", [], [("go",)], None)], "module string, imports array<struct<module:string,functions:array<struct<name:string>>>>, exports array<struct<name:string>>, path string")
    found = unify(docs, meta)
    assert {r["node_id"] for r in found.nodes.collect()} == {"A.DLL!Run", "A.DLL!Go", "A.DLL!Lost", "B.DLL!go"}
    assert not {"ends", "paired", "leads"} & set(vars(found))
    assert {tuple(r) for r in found.edges.select("src", "dst", "kind").collect()} == {("A.DLL!Run", "B.DLL!go", "import"), ("A.DLL!Go", "B.DLL!go", "forwarder")}
    assert [tuple(r) for r in found.unresolved.collect()] == [("A.DLL", "Lost", 2)]


def test_build_checks_edges_as_they_lie(spark, monkeypatch):
    """Integrity and paths need no grouping of edges by pairs, and few targets no dealing of them; both say what they say of the graph."""
    from graphline.operators import spread, unify as unifying

    stub = lambda at, name: {"entry_point": at, "name": name, "source": "IMPORTED"}
    a = {"program": "a.dll", "functions": [{"entry_point": "1", "name": "Run"}, stub("2", "Go"), stub("3", "Lost"), stub("4", "Open"), stub("4", "Go")], "edges": [{"caller": "1", "callee": c} for c in ("2", "2", "3", "4")]}
    b = {"program": "b.dll", "functions": [{"entry_point": "1", "name": "go"}, stub("2", "NtGo"), stub("3", "Open")], "edges": [{"caller": "1", "callee": "2"}]}
    native = {"program": "ntdll.dll", "functions": [{"entry_point": "1", "name": "NtGo"}], "edges": []}
    texts = [(d["program"], json.dumps(d), k) for k, d in enumerate((a, b, native))]
    named = "module string, imports array<struct<module:string,functions:array<struct<name:string>>>>, exports array<struct<name:string>>"
    meta = [("A.DLL", [("api-ms-b", [("Go",)]), ("b", [("Open",)])], [("Run",)]), ("B.DLL", [("ntdll", [("NtGo",)])], [("go",)]), ("NTDLL.DLL", [], [("NtGo",)]), ("API-MS-B.DLL", [("b", [("Go",)])], [("Go",)])]
    meta = spark.createDataFrame(meta, named)
    asked = [("A.DLL!Run", "SYSCALL:NtGo"), ("A.DLL!Run", "A.DLL!Lost"), ("API-MS-B.DLL!Go", "B.DLL!go"), ("B.DLL!Open", "B.DLL!go"), ("A.DLL!Open", "B.DLL!Open"), ("GONE!x", "B.DLL!go")]
    pairs = spark.createDataFrame([*asked, asked[0]], "source string, target string")
    docs = readers.documents_of(spark.createDataFrame(texts, "path string, value string, file int"))
    verdicts = ["ok", "failed", "ok", "failed", "ok", "skipped"]  # a call of what nothing provides leads nowhere
    for few in (spread.FEW_ROWS, 0):
        with monkeypatch.context() as patch:
            patch.setattr(spread, "FEW_ROWS", few)
            built = unifying.build(docs, meta, pairs=pairs)
            told = {r["subject"]: r["verdict"] for r in built.verdicts.where("check = 'path'").collect()}
        assert told == {f"{s} -> {t}": v for (s, t), v in zip(asked, verdicts, strict=True)}
        assert not {"paired", "graph"} & set(vars(built.unified))
    rest = {r["check"]: (r["subject"], r["verdict"]) for r in built.verdicts.where("check <> 'path'").collect()}
    assert rest == {"dangling edges": ("0", "ok"), "duplicate ids": ("0", "ok"), "unresolved imports": ("2: A.DLL!Lost, B.DLL!Open", "failed"), "system calls": ("1 of 1", "ok")}
    pairs_of = lambda rows: {(r["src"], r["dst"]) for r in rows.collect()}
    lying = pairs_of(built.unified.ungrouped)
    assert pairs_of(built.unified.graph.edges) == lying and built.unified.graph.edges.count() == len(lying)
    assert all(quality.ids_amiss(built.unified.nodes, rows) == (0, 0) for rows in (built.unified.ungrouped, built.unified.edges))
    twice = json.dumps({"program": "a.dll", "functions": [{"entry_point": "1", "name": "Run"}] * 3, "edges": []})
    with pytest.raises(ValueError, match="1 duplicate ids"):
        unifying.build(readers.documents_of(spark.createDataFrame([("a.dll", twice, 0)], "path string, value string, file int")), meta)


def test_ids_amiss_tells_lost_ends_and_repeated_ids(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "z"), ("y", "b"), (None, "b")], "src string, dst string")
    assert quality.ids_amiss(nodes, edges) == (3, 1)
    assert quality.ids_amiss(nodes.distinct(), edges.where("src = 'a' AND dst = 'b'")) == (0, 0)


def test_merging_makes_parts_by_the_number_of_rows(spark, monkeypatch):
    """More rows make more parts, not larger ones."""
    from graphline import model

    monkeypatch.setattr(model, "MERGED_ROWS", 3)
    nodes = spark.createDataFrame([(f"n{k % 20}", f"p{k}") for k in range(40)], "node_id string, program string")
    edges = spark.createDataFrame([("n1", "n2"), ("n2", "n3")], "src string, dst string")
    found = PropertyGraph.compose([PropertyGraph.of(nodes, edges), PropertyGraph.of(nodes.where("node_id = 'n1'").withColumn("program", F.lit("later")).limit(1), edges)])
    assert found.nodes.count() == 20 and found.edges.count() == 2 and found.nodes.where("program = 'later'").count() == 1
    assert "hashpartitioning(node_id" in (plan := found.nodes._jdf.queryExecution().toString()) and ", 14)" in plan


def test_dangling_edges_keep_repeats_and_nulls(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "z"), ("z", "b"), (None, "b"), ("b", "a")], "src string, dst string")
    lost = [("a", "z"), ("a", "z"), ("z", "b"), (None, "b")]
    assert sorted(map(str, map(tuple, quality.dangling_edges(nodes, edges).collect()))) == sorted(map(str, lost))
    assert quality.dangling_count(nodes, edges) == 4 and quality.dangling_count(nodes, edges.where("src = 'a' AND dst = 'b'")) == 0
