"""Search of labels against a scan, and components and degrees that follow a stream."""

from __future__ import annotations

import random
import re

from graphs import function, module

from graphline.model import PropertyGraph
from graphline.operators import structure
from graphline.operators.search import LabelIndex, highlighted
from graphline.streaming import ingest


def test_search_of_labels(spark):
    rng = random.Random(4)
    names = ["", None, "ab", "Open_File%", "İstanbul", "中文字符", "aaaa"] + ["".join(rng.choice("abAB_.*") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    nodes = spark.createDataFrame([(f"n{k}", n) for k, n in enumerate(names)], "node_id string, name string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k * 3 % 157}") for k in range(157)], "src string, dst string")
    graph = PropertyGraph.of(nodes, edges)
    index = LabelIndex.of(graph)
    shown = {f"n{k}": n or f"n{k}" for k, n in enumerate(names)}
    for text in ("aba", "ABA", "aaaa", "a.b", "_*", "", "x", "file%", "文字符", "nothing here", "n1"):
        expected = {(i, n) for i, n in shown.items() if text.lower() in n.lower()}
        assert {tuple(r) for r in index.search(text).collect()} == expected
    plan = index.candidates("aba")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+", plan)  # the files of the asked grams alone
    ids = {i for i, n in shown.items() if "ab" in n.lower()}
    assert {r["node_id"] for r in highlighted(graph, index, "ab").nodes.collect()} == ids


def test_components_and_degrees_follow_the_stream(spark, tmp_path):
    rng = random.Random(2)
    arrivals, out = tmp_path / "in", str(tmp_path / "out")
    arrivals.mkdir()
    for batch in range(3):
        # module P grows: some edges come again, some join components of before
        edges = [(f"0x{rng.randrange(30):02x}", f"0x{rng.randrange(30):02x}") for _ in range(8)] + [("0x01", "0x02")]
        module(arrivals, f"p{batch}", "P", [function(f"0x{k:02x}", f"f{k}") for k in range(10 * batch, 10 * batch + 10)], edges)
        ingest.follow(spark, str(arrivals), out, str(tmp_path / "cp"), maintain=True).awaitTermination(120)
        graph = ingest.current(spark, out)
        for _ in range(2):
            found = {r["node_id"]: (r["component"], r["in_degree"], r["out_degree"]) for r in ingest.maintained(spark, out).collect()}
            whole = structure.weak_components(graph).join(graph.degrees(), "node_id").collect()
            assert found == {r["node_id"]: (r["component"], r["in_degree"], r["out_degree"]) for r in whole}
            if batch != 1:
                break
            ingest.update(spark, out, batch)  # a batch that is run again changes nothing
