"""Column expressions, and the driver's entry points."""

from __future__ import annotations

import ast
import json
import struct
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphline.functions import labels, symbols
from graphline.sources import readers

ROOT = Path(__file__).resolve().parent.parent


def one(spark, column, **values):
    return spark.createDataFrame([values], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_labels(spark):
    told = dict(node_id="id", name="", qualified_name="q", address="a", program="P.dll")
    assert one(spark, labels.label(), **told) == "q"
    assert one(spark, labels.label(), **told | {"qualified_name": ""}) == "a"
    assert one(spark, labels.name_label(), **told | {"qualified_name": ""}) == ""
    assert one(spark, labels.display_label(), **told | {"name": "n" * 60}) == "P.dll:" + "n" * 45 + "..."
    assert one(spark, labels.is_target("p.DLL", "q"), **told) and not one(spark, labels.is_target("x", "q"), **told)
    names = {"ntdll": "NTDLL.DLL", " a.exe ": "A.EXE", "": "", "b.Dll": "B.DLL"}
    assert all(one(spark, labels.normalised_module("m"), m=k) == v for k, v in names.items())
    assert one(spark, labels.module_of_file("p"), p="/x/kernel32.dll.callgraph.json") == "KERNEL32.DLL"
    assert one(spark, labels.brief_list("l"), l=list("gfedcba")) == "a, b, c, d, e, ... (+2)" and one(spark, labels.brief_list("l"), l=["b", "a"]) == "a, b"
    assert one(spark, labels.path_text("l"), l=list("abcdefghij")) == " → ".join("abcdefgh")
    assert one(spark, labels.is_alias("m"), m="api-ms-win-x") and not one(spark, labels.is_alias("m"), m="kernel32")
    assert spark.range(1).select(labels.hex_address(F.lit(255)).alias("x")).first()["x"] == "0xFF"


def test_hub_is_a_nearest_rank(spark):
    rows = spark.createDataFrame([(str(k), float(k // 2)) for k in range(20)], "node_id string, size double")
    values = sorted(k // 2 for k in range(20))
    cutoff = values[max(0, int(0.85 * 20) - 1)]
    assert {r["node_id"]: r["hub"] for r in labels.with_hub(rows).collect()} == {str(k): k // 2 >= cutoff for k in range(20)}
    with pytest.raises(ValueError):
        labels.with_size(rows, "other")


def test_codeview(spark):
    ids = [uuid.uuid5(uuid.NAMESPACE_URL, f"build {k}") for k in range(3)]
    ages = [1, 26, 0xABCDE]
    names = ["D:\\out\\ü lib.pdb", "", "/srv/x.y.pdb"]
    rsds = [b"RSDS" + i.bytes_le + struct.pack("<I", a) + n.encode() + b"\0rest" for i, a, n in zip(ids, ages, names, strict=True)]
    nb10 = b"NB10" + struct.pack("<III", 7, 0xFEDC0001, 41) + b"old.pdb\0"
    found = [r["codeview"] for r in symbols.parse_codeview(spark.createDataFrame([(bytearray(r),) for r in [*rsds, nb10]], "record binary").coalesce(1)).collect()]
    for row, i, a, n in zip(found, ids, ages, names, strict=False):
        assert (row["signature"], row["guid"], row["age"], row["pdb_path"]) == ("RSDS", str(i).upper(), a, n)
        assert row["symbol_server_path"] == f"{i.hex.upper()}{a:X}" and row["timestamp"] is None
    assert (found[3]["signature"], found[3]["timestamp"], found[3]["age"], found[3]["pdb_path"]) == ("NB10", 0xFEDC0001, 41, "old.pdb")
    with pytest.raises(Exception, match="unsupported CodeView"):
        symbols.parse_codeview(spark.createDataFrame([(bytearray(b"NB09"),)], "record binary")).collect()
    assert [one(spark, symbols.compressed_name("n"), n=n) for n in ("lib.v2.pdb", "README", "a.b")] == ["lib.v2.pd_", "README_", "a.b_"]
    assert [r["x"] for r in spark.createDataFrame([(bytearray(b"MSCF"),), (bytearray(b"MSC"),), (None,)], "c binary").coalesce(1).select(symbols.is_cabinet("c").alias("x")).collect()] == [True, False, False]
    assert spark.range(1).select(symbols.file_version(F.lit(0x00030007), F.lit(0xFFFF0000)).alias("v")).first()["v"] == "3.7.65535.0"


def test_signatures(spark, tmp_path):
    view = lambda path, identifier: {"codeview": {"signature": "RSDS", "pdb_path": path, "symbol_server_path": identifier, "guid": "G", "age": 1}}
    for name, entry in (("a.dll", view("C:\\x\\ntdll.pdb", "AAA111")), ("b.dll", view("ntdll.pdb", "AAA111")), ("c.dll", view("beta.pdb", "BBB")), ("d.dll", {"codeview": {"signature": "NB10", "pdb_path": "old.pdb"}})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"path": f"C:\\{name}", "debug": [entry]}))
    (tmp_path / "e.dll.json").write_text("{")
    meta = readers.metadata(spark, str(tmp_path))
    assert meta.count() == 4
    found = {(r["pdb_name"], r["identifier"]): len(r["sources"]) for r in symbols.gather_signatures(meta).collect()}
    assert found == {("ntdll.pdb", "AAA111"): 2, ("beta.pdb", "BBB"): 1}
    assert symbols.gather_signatures(meta, max_unique=1).count() == 1
    assert [r["pdb_name"] for r in symbols.gather_signatures(meta, pdb_filter=["beta.pdb"]).collect()] == ["beta.pdb"]
    assert {r["program"]: r["pdb_guid"] for r in readers.modules(meta).collect()} == {"A.DLL": "G", "B.DLL": "G", "C.DLL": "G", "D.DLL": None}
    binaries = spark.createDataFrame([("c:\\A.dll",), ("C:\\zzz.dll",)], "binary string")
    assert [r["binary"] for r in readers.metadata_of_binary(meta, binaries).collect()] == ["c:\\A.dll"]
    assert [r["module"] for r in readers.batch_plan(meta, ["c:\\a", "c:\\b"], limit=1).collect()] == ["A.DLL"]


def test_nothing_imports_llm():
    for path in [*(ROOT / "graphline").rglob("*.py")]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("graphline.llm", "corpus_pipeline")) for n in names), path


def test_entry_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "graphline", tmp_path / "graphline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') and k[2].isdigit() for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["0", "True"], said.stderr
