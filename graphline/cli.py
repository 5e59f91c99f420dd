"""Command line: python -m graphline.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphline.functions import symbols
from graphline.functions.labels import PROGRAM_HINT, TARGET_PREFIXES, brief_list
from graphline.operators import centrality, cover, quality
from graphline.operators.explore import explore
from graphline.operators.structure import top_k_subgraph
from graphline.operators.unify import unify
from graphline.sources import readers, sinks


def _targets(p: argparse.ArgumentParser) -> None:
    p.add_argument("inputs", nargs="+")
    p.add_argument("--prefix", action="append")
    p.add_argument("--program-hint", default=PROGRAM_HINT, help="'' for none")
    p.add_argument("--candidate-program", action="append")
    p.add_argument("--top", type=int, default=15)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphline")
    sub = p.add_subparsers(dest="command", required=True)
    _targets(sub.add_parser("report", help="unreferenced targets, orphans and coverage"))
    plan = sub.add_parser("cover", help="a small set of candidates that reaches all targets")
    _targets(plan)
    plan.add_argument("--target", action="append")
    v = sub.add_parser("validate", help="duplicate ids, dangling edges, share of syscalls; exit code 1 if something is wrong")
    v.add_argument("input")
    v.add_argument("--metadata")
    v.add_argument("--ratio", type=float, default=0.8)
    a = sub.add_parser("audit", help="status of every graph file below a folder")
    a.add_argument("folder")
    a.add_argument("--output")
    a.add_argument("--format", default="json")
    u = sub.add_parser("unify", help="resolve imports across modules")
    u.add_argument("folder")
    u.add_argument("metadata")
    u.add_argument("output")
    u.add_argument("--module", action="append")
    u.add_argument("--limit", type=int)
    u.add_argument("--include-internal", action="store_true")
    g = sub.add_parser("aggregate", help="merge graphs into one document")
    g.add_argument("inputs", nargs="+")
    g.add_argument("--output", required=True)
    g.add_argument("--format", choices=["json", "graphml", "parquet"], default="json")
    s = sub.add_parser("summary", help="nodes of the highest centrality")
    s.add_argument("inputs", nargs="+")
    s.add_argument("--metric", default="degree")
    s.add_argument("--top", type=int, default=10)
    e = sub.add_parser("explore", help="callers of a function and the path to it")
    e.add_argument("inputs", nargs="+")
    e.add_argument("--focus", required=True)
    e.add_argument("--start")
    e.add_argument("--depth", type=int, default=3)
    e.add_argument("--limit", type=int, default=500)
    e.add_argument("--external-only", action="store_true")
    d = sub.add_parser("plot-data", help="nodes with size, colour and label")
    d.add_argument("inputs", nargs="+")
    d.add_argument("--max-nodes", type=int, default=200)
    f = sub.add_parser("symbols", help="the symbol files that the metadata names")
    f.add_argument("metadata")
    f.add_argument("--pdb", action="append")
    f.add_argument("--limit", type=int)
    i = sub.add_parser("inventory", help="binaries below a folder, with digests, versions and headers")
    i.add_argument("folder")
    i.add_argument("--output", help="a CSV folder")
    i.add_argument("--limit", type=int)
    c = sub.add_parser("inventory-csv", help="a CSV of what the metadata says of each module")
    c.add_argument("metadata")
    c.add_argument("output")
    c.add_argument("--relative-to")
    b = sub.add_parser("batch", help="binaries still to be exported")
    b.add_argument("metadata")
    b.add_argument("--include", action="append", default=[])
    b.add_argument("--outputs", help="folder of graph files that exist already")
    b.add_argument("--limit", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphline").getOrCreate()
    return COMMANDS[args.command](spark, args) or 0


def _brief(rows, shown: int = 10) -> None:
    """The first rows, and how many more there are."""
    rows.show(shown, False)
    if (more := rows.count() - shown) > 0:
        print(f"... ({more} more)")


def _options(args) -> dict:
    return {"prefixes": tuple(args.prefix or TARGET_PREFIXES), "program_hint": args.program_hint or None}


def _report(spark, args):
    g = readers.load_graph(spark, args.inputs)
    cover.unreferenced_targets(g, **_options(args)).orderBy("node_id").show(args.top, False)
    cover.orphans(g, **_options(args), programs=args.candidate_program).show(args.top, False)
    cover.coverage_report(g, **_options(args), programs=args.candidate_program, listed=False).show(args.top, False)


def _cover(spark, args):
    found = cover.greedy_cover(readers.load_graph(spark, args.inputs), args.target, **_options(args), programs=args.candidate_program)
    found.hooks.withColumn("covered", brief_list("covered")).show(1000, False)
    _brief(found.uncovered.orderBy("node_id"), args.top)
    print(f"{found.uncovered.count()} uncovered, {found.missing.count()} names not found")


def _validate(spark, args):
    docs = readers.documents(spark, args.input)
    layers = exports = None
    if args.metadata:
        layers, exports = readers.load_graph(spark, args.input).nodes, readers.module_exports(readers.metadata(spark, args.metadata))
    wrong = quality.validate(docs, layers, exports, args.ratio)
    print("\n".join(wrong) or "valid")
    return int(bool(wrong))


def _audit(spark, args):
    report = quality.audit(readers.documents(spark, args.folder, readers.GRAPH_GLOB), args.folder)
    quality.status_counts(report).show()
    _brief(quality.flagged(report).orderBy("path"))
    if args.output:
        sinks.write_report(report, args.output, args.format)


def _unify(spark, args):
    files = [r["path"] for r in readers.list_graph_files(spark, args.folder, modules=args.module, limit=args.limit).collect()]
    meta = readers.metadata(spark, args.metadata)
    found = unify(readers.with_order(readers.documents(spark, files)), meta, args.include_internal)
    sinks.write_json(found.graph, args.output, unified=True, dlls=readers.modules(meta))
    print(f"{found.unresolved.count()} unresolved imports")


def _aggregate(spark, args):
    g = readers.load_graph(spark, args.inputs)
    {"json": sinks.write_json, "graphml": sinks.write_graphml, "parquet": sinks.write_tables}[args.format](g, args.output)


def _summary(spark, args):
    counts, rows = centrality.summary(readers.load_graph(spark, args.inputs), args.metric, args.top)
    print(counts)
    rows.show(args.top, False)


def _explore(spark, args):
    view = explore(readers.load_graph(spark, args.inputs), args.limit, args.external_only, args.focus, args.depth, args.start)
    print(view.focus_message, view.path_message, sep="\n")
    if view.paths is not None:
        view.paths.show(12, False)


def _plot_data(spark, args):
    nodes, title = sinks.plot_data(top_k_subgraph(readers.load_graph(spark, args.inputs), args.max_nodes))
    print(title)
    nodes.orderBy(F.desc("degree"), "node_id").show(args.max_nodes, False)


def _symbols(spark, args):
    symbols.fetch_plan(readers.metadata(spark, args.metadata), args.pdb, args.limit).show(1000, False)


def _inventory(spark, args):
    counts = readers.inventory_counts(spark, args.folder).first()
    rows = readers.inventory(spark, args.folder, args.limit)
    print(f"{counts['total_files']} files, {counts['pe_files']} binaries")
    if args.output:
        sinks.write_csv(rows, args.output)
    broken = rows.where("machine IS NULL").select("path").orderBy("path")
    if not broken.isEmpty():
        print("without a whole header:")
        _brief(broken)


def _inventory_csv(spark, args):
    rows = readers.inventory_summary(readers.metadata(spark, args.metadata), relative_to=args.relative_to)
    sinks.write_csv(rows, args.output)
    print(f"{rows.count()} rows")


def _batch(spark, args):
    done = readers.list_graph_files(spark, args.outputs).select("module") if args.outputs else None
    readers.batch_plan(readers.metadata(spark, args.metadata), args.include, done, args.limit).show(1000, False)


COMMANDS = {"report": _report, "cover": _cover, "validate": _validate, "audit": _audit, "unify": _unify, "aggregate": _aggregate, "summary": _summary, "explore": _explore, "plot-data": _plot_data, "symbols": _symbols, "inventory": _inventory, "inventory-csv": _inventory_csv, "batch": _batch}

if __name__ == "__main__":
    sys.exit(main())
