"""The command line and the writers behind it."""

from __future__ import annotations

import csv
import hashlib
import json

import pytest
from graphs import three_modules, unified

from graphline import cli
from graphline.operators import cover
from graphline.plans import build
from graphline.sources import readers, sinks


def parts(folder, kind="part-*"):
    return "".join(p.read_text() for p in sorted(folder.glob(kind)))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    return folder, three_modules(folder), unified(folder)


def test_commands(spark, files, tmp_path, capsys):
    folder, modules, sample = files
    assert cli.main(["cover", *modules, "--program-hint", "", "--target", "ZwSealCrate", "--target", "nobody"], spark) == 0
    out = capsys.readouterr().out
    assert "PackCrate" in out and "1 names not found" in out
    assert cli.main(["validate", sample], spark) == 0 and "valid" in capsys.readouterr().out
    assert cli.main(["audit", str(folder), "--output", str(tmp_path / "report")], spark) == 0
    assert "empty" in capsys.readouterr().out and len(json.loads(parts(tmp_path / "report"))) == 4
    assert cli.main(["summary", sample, "--metric", "pagerank", "--top", "3"], spark) == 0 and "NtOpenDoor" in capsys.readouterr().out
    assert cli.main(["explore", sample, "--focus", "SYSCALL:NtOpenDoor", "--start", "SHELF.DLL!OpenShelf"], spark) == 0
    assert "3 hops" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_aggregate_and_csv(spark, files, tmp_path):
    _, modules, sample = files
    assert cli.main(["aggregate", *modules, sample, "--output", str(tmp_path / "all")], spark) == 0
    graph = readers.load_graph(spark, str(tmp_path / "all"))
    assert graph.counts().first().asDict() == {"node_count": 16, "edge_count": 12}
    report = cover.coverage_report(graph, program_hint=None, listed=False)
    sinks.write_csv(sinks.coverage_csv(report), str(tmp_path / "csv"))
    rows = [line for text in sorted((tmp_path / "csv").glob("*.csv")) for line in csv.DictReader(text.read_text().splitlines())]
    assert len(rows) == report.count() and set(rows[0]) == {"label", "program", "coverage"} and {r["label"] for r in rows} >= {"OpenShelf", "WeighCrate"}
    sinks.write_tables(graph, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/nodes")).count() == 16
    nodes, title = sinks.plot_data(graph, max_labels=3)
    assert title == "16 nodes, 12 edges" and nodes.where("label IS NOT NULL").count() == 0


def test_collectors_and_mergers(spark, files, tmp_path):
    """A collector and a merger of one's own, and those that come with the library."""
    folder, modules, _ = files

    class Named:
        def collect(self, config):
            return [p for p in modules if config in p]

    class Counted:
        def merge(self, paths, output):
            return f"{output}:{len(paths)}"

    assert build.build_unified_graph("crate", Named(), Counted(), "out") == "out:1"
    made = build.build_unified_graph(str(folder), build.FolderCollector(spark, modules=["SHELF.DLL", "NTDLL.DLL"]), build.ComposeMerger(spark), str(tmp_path / "made"))
    assert {r["program"] for r in readers.load_graph(spark, made).programs().collect()} == {"SHELF.DLL", "NTDLL.DLL"}
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "shelf.dll.json").write_text(json.dumps({"exports": [{"name": "OpenShelf"}], "imports": [{"module": "ntdll.dll", "functions": [{"name": "NtOpenDoor"}]}]}))
    (tmp_path / "meta" / "ntdll.dll.json").write_text(json.dumps({"exports": [{"name": "NtOpenDoor"}]}))
    made = build.build_unified_graph(str(folder), build.FolderCollector(spark, modules=["SHELF.DLL", "NTDLL.DLL"]), build.UnifyMerger(spark, str(tmp_path / "meta")), str(tmp_path / "unified"))
    assert {r["node_id"] for r in readers.load_graph(spark, made).nodes.collect()} == {"SHELF.DLL!OpenShelf", "SHELF.DLL!NtOpenDoor", "NTDLL.DLL!NtOpenDoor", "SYSCALL:NtOpenDoor"}


def binary(machine, version=None):
    head = b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\0\0" + machine.to_bytes(2, "little") + (3).to_bytes(2, "little") + bytes(32) + (4660).to_bytes(4, "little") + bytes(48) + (2).to_bytes(2, "little") + bytes(10)
    return head + (b"" if version is None else b"\xbd\x04\xef\xfe\0\0\1\0" + b"".join((version[k] << 16 | version[k + 1]).to_bytes(4, "little") for k in (0, 2)))


def test_inventory(spark, tmp_path, capsys):
    folder = tmp_path / "bin"
    folder.mkdir()
    contents = {"a.dll": binary(0x8664, (10, 0, 22621, 4391)), "b.exe": binary(0x14C, (65535, 1, 0, 7)), "c.sys": binary(0xAA64), "short.dll": b"MZ", "text.txt": b"PE\0\0 but no binary"}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    rows = {r["path"].rpartition("/")[2]: r for r in readers.inventory(spark, str(folder)).collect()}
    assert {n: (r["machine"], r["sections"], r["entry_point"], r["subsystem"], r["file_version"]) for n, r in rows.items()} == {
        "a.dll": ("0x8664", 3, "0x1234", 2, "10.0.22621.4391"), "b.exe": ("0x14c", 3, "0x1234", 2, "65535.1.0.7"), "c.sys": ("0xaa64", 3, "0x1234", 2, None), "short.dll": (None, None, None, None, None),
    }
    assert {r["path"].rpartition("/")[2]: r["sha256"] for r in readers.digests(spark, str(folder)).collect()} == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    assert readers.inventory(spark, str(folder), 2).count() == 2
    assert cli.main(["inventory", str(folder), "--output", str(tmp_path / "csv")], spark) == 0
    out = capsys.readouterr().out
    assert "5 files, 4 binaries" in out and "short.dll" in out
    assert sum(len(p.read_text().splitlines()) - 1 for p in (tmp_path / "csv").glob("*.csv")) == 4
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "a.json").write_text(json.dumps({"path": "C:/bin/a.dll", "exports": [{"name": "x"}], "imports": [{"module": "m", "functions": [{"name": "p"}, {"name": "q"}]}, {"module": "n"}], "debug": [{"codeview": {"signature": "RSDS", "guid": "G", "age": 3, "pdb_path": "a.pdb"}}]}))
    (tmp_path / "meta" / "b.json").write_text("{}")
    assert cli.main(["inventory-csv", str(tmp_path / "meta"), str(tmp_path / "meta.csv"), "--relative-to", "C:/bin"], spark) == 0
    told = {r["module"].split(".")[0]: r for text in sorted((tmp_path / "meta.csv").glob("*.csv")) for r in csv.DictReader(text.read_text().splitlines())}
    assert (told["A"]["path"], told["A"]["exports"], told["A"]["import_modules"], told["A"]["imports"], told["A"]["guid"]) == ("a.dll", "1", "2", "2", "G") and told["B"]["imports"] == "0"


def test_largest_files(spark, files):
    folder, *_ = files
    sizes = {p.name: p.stat().st_size for p in folder.glob("*.json")}
    found = [r["path"].rpartition("/")[2] for r in readers.largest_files(spark, str(folder), 2).collect()]
    assert found == sorted(sizes, key=lambda n: (-sizes[n], n))[:2]
