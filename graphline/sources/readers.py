"""Reading graph and metadata documents."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphline.functions.labels import filled, module_of_file, normalised_module
from graphline.functions.symbols import fixed_version, is_binary, pe_header
from graphline.model import PropertyGraph, merged
from graphline.plans.iterate import counted
from graphline.schema import EDGES, GRAPH_DOCUMENT, METADATA_DOCUMENT, NODES, conform
from graphline.sources.ranges import PART_BYTES, Elements, elements, is_part, size_of

GRAPH_GLOB = "*.callgraph.json"
#: What a path on the local file system may begin with, and the signs that Spark's readers take for patterns.
ROOT, GLOB_SIGNS = r"^file:/+", r"[\\*?\[\]{}]"


def plain_path(encoded: Column) -> Column:
    """The path that a percent-encoded one stands for."""
    return F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)


def resolved(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Full paths of the inputs in the order given, each once; a folder of part files is one document, any other stands for its graph files by name. An input without a file is an error."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, []
    for given in paths:
        path = hadoop.Path(given)
        store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not store.exists(path):
            raise FileNotFoundError(given)
        status = store.getFileStatus(path)
        files = [status.getPath().toString()]
        if status.isDirectory():
            inside = [(f.getPath().getName(), f) for f in store.listStatus(path)]
            if not any(is_part(name) for name, _ in inside):  # else the folder is a document of parts
                files = sorted(f.getPath().toString() for name, f in inside if f.isFile() and name.endswith(GRAPH_GLOB[1:]))
        if not files:
            raise FileNotFoundError(f"{given} has no {GRAPH_GLOB}")
        found += files
    return list(dict.fromkeys(found))


def fits(spark: SparkSession, files: Sequence[str], most: int) -> bool:
    """Whether every input is one file of at most ``most`` bytes."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    return not any(hadoop.Path(f).getFileSystem(conf).getFileStatus(hadoop.Path(f)).isDirectory() or size_of(hadoop, conf, f) > most for f in files)


def documents(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """One row per file: path, file name, stem, whether it could be parsed, and the columns of GRAPH_DOCUMENT. Never fails on bad JSON."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return documents_of(reader.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select("value", plain_path(F.col("_metadata.file_path")).alias("path")))


def documents_of(texts: DataFrame) -> DataFrame:
    """The same of a table (path, value) that holds one document per row; its other columns stay, so that it may bring ``file``, the order of the documents."""
    name = F.element_at(F.split("path", "/"), -1)
    parsed = F.from_json("value", GRAPH_DOCUMENT, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json("value")
    # JSON that begins with a brace is an object; asking for the schema of all it holds takes longer than parsing it
    is_object = whole.isNotNull() & F.col("value").rlike(r"^[ \t\r\n]*\{")
    more = [c for c in texts.columns if c not in ("path", "value")]
    rows = texts.select("path", *more, name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), is_object.alias("parsed"), F.when(is_object, parsed).alias("doc"), F.when(is_object, whole).alias("raw"))
    return rows.select("path", *more, "file_name", "stem", "parsed", "doc.*", "raw")


def kind() -> Column:
    """callgraph (functions by address), unified (nodes and edges by id), or null."""
    return F.when(F.col("functions").isNotNull(), "callgraph").when(F.col("nodes").isNotNull() & F.col("edges").isNotNull(), "unified")


def with_order(docs: DataFrame, paths: Sequence[str] | None = None) -> DataFrame:
    """``file``: the position of each document in ``paths`` (full ones), else in path order. Paths alone are numbered, from the listing that the scan has made; documents stay where they are."""
    if paths is None:
        paths = sorted(unquote(p) for p in docs.inputFiles())
    order = docs.sparkSession.createDataFrame([(k, re.sub(ROOT, "/", p)) for k, p in enumerate(paths)], "file int, given string")
    return docs.join(F.broadcast(order), F.regexp_replace("path", ROOT, "/") == F.col("given")).drop("given")  # one row per file


def truth(text: str) -> Column:
    """Booleans that may have been written as strings."""
    return F.lower(text) == "true"


def kind_of_heads() -> Column:
    """As ``kind``, from the members of a document that was scanned by ranges."""
    is_array = lambda key: F.coalesce(F.element_at("members", key) == "[", F.lit(False))
    return F.when(F.col("parsed") & is_array("functions"), "callgraph").when(F.col("parsed") & is_array("nodes") & is_array("edges"), "unified")


def members(docs: DataFrame | Elements, of_kind: str, key: str) -> DataFrame:
    """(path, file, program, pos, e) of the elements of a root array of one kind of documents; ``whole``, the element's JSON, for nodes."""
    name = F.coalesce(filled("program"), "stem").alias("program")
    if isinstance(docs, Elements):
        program = F.get_json_object(F.concat(F.lit('{"v":'), F.element_at("members", "program"), F.lit("}")), "$.v")
        heads = docs.heads.where(kind_of_heads() == of_kind).withColumn("program", program).select("file", "path", name)
        one = StructType.fromDDL(GRAPH_DOCUMENT)[key].dataType.elementType
        rows = docs.rows.where(F.col("key") == key).join(heads, "file")
        whole = [F.try_parse_json("value").alias("whole")] if key == "nodes" else []
        return rows.select("path", "file", "program", "pos", F.from_json("value", one).alias("e"), *whole)
    rows = docs.where("functions IS NOT NULL" if of_kind == "callgraph" else "functions IS NULL AND nodes IS NOT NULL")
    if key != "nodes":
        return rows.select("path", "file", name, F.posexplode(key).alias("pos", "e"))
    rows = rows.select("path", "file", name, F.posexplode(key).alias("pos", "e"), F.expr("variant_get(raw, '$.nodes', 'array<variant>')").alias("all"))
    return rows.select("path", "file", "program", "pos", "e", F.element_at("all", F.col("pos") + 1).alias("whole"))


def module_functions(docs: DataFrame | Elements) -> DataFrame:
    """Functions of module graphs with program, file and position; those without an entry point are kept, with null."""
    return _functions(members(docs, "callgraph", "functions").select("path", "file", "program", "pos", "e.*"))


def _functions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_external", truth("is_external")).withColumn("ord", order(0))


def order(phase: int, side: Column | int = 0, pos: str = "pos") -> Column:
    return F.struct(F.col("file"), F.lit(phase).alias("phase"), F.col(pos).alias("pos"), (F.lit(side) if isinstance(side, int) else side).alias("side"))


def module_edges(docs: DataFrame | Elements) -> DataFrame:
    """Call edges of module graphs: program, caller, callee, ord; those with a null end are left out."""
    return _edges(members(docs, "callgraph", "edges").select("path", "file", "program", "pos", "e.caller", "e.callee"))


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where("caller IS NOT NULL AND callee IS NOT NULL").withColumn("ord", order(1))


def module_lists(docs: DataFrame | Elements) -> tuple[DataFrame, DataFrame, int]:
    """``module_functions`` and ``module_edges``, for plans that read them more than once, and how many both are at the most: documents are parsed once, and their elements are rows of a table."""
    if isinstance(docs, Elements):
        return module_functions(docs), module_edges(docs), docs.rows.count()
    of = StructType.fromDDL(GRAPH_DOCUMENT)["functions"].dataType.elementType.names
    ends, none = ["caller", "callee"], F.lit(None).cast("string")
    part = lambda kind, e, i, held: F.struct(F.lit(kind).alias("edge"), i.alias("pos"), *[(e[c] if c in held else none).alias(c) for c in (*of, *ends)])
    functions = F.transform("functions", lambda e, i: part(False, e, i, of))
    calls = F.transform(F.coalesce("edges", F.array().cast(docs.schema["edges"].dataType)), lambda e, i: part(True, e, i, ends))
    name = F.coalesce(filled("program"), "stem").alias("program")
    # a condition on what is parsed, also the one that Spark adds to explode, would parse the text once more; documents of another kind have no functions
    rows = docs.select("path", "file", name, F.explode_outer(F.concat(functions, calls)).alias("e"))
    rows, seen = counted(rows.where("e IS NOT NULL").select("path", "file", "program", "e.*"), n=F.count(F.lit(1)))
    at = ["path", "file", "program", "pos"]
    return _functions(rows.where("NOT edge").select(*at, *of)), _edges(rows.where("edge").select(*at, *ends)), seen["n"]


def module_graph(docs: DataFrame | Elements) -> PropertyGraph:
    """Nodes program:address of module graphs; endpoints that no function declares become external nodes without a name."""
    at = lambda c: F.concat_ws(":", "program", c)
    functions, calls, n = module_lists(docs)
    functions = functions.where("entry_point IS NOT NULL").withColumn("node_id", at("entry_point")).withColumn("address", F.col("entry_point"))
    declared = conform(functions, NODES).withColumn("turn", F.col("ord.file"))
    ends = calls.select("program", "file", "pos", F.col("caller").alias("address"), F.lit(0).alias("side")).union(calls.select("program", "file", "pos", "callee", F.lit(1)))
    loose = ends.withColumn("node_id", at("address")).join(declared.select("node_id"), "node_id", "left_anti")
    loose = loose.withColumn("is_external", F.lit(True)).withColumn("ord", order(1, F.col("side"))).withColumn("turn", F.col("file"))
    nodes = merged(declared.unionByName(conform(loose, NODES).withColumn("turn", F.col("ord.file"))), ["node_id"], list(NODES), 2 * n)
    edges = calls.select(at("caller").alias("src"), at("callee").alias("dst"), F.lit(None).cast("string").alias("kind"), "ord", F.col("file").alias("turn"))
    return PropertyGraph(nodes, merged(edges, ["src", "dst"], list(EDGES), n), {})


def unified_graph(docs: DataFrame | Elements) -> PropertyGraph:
    """Nodes by id (or node_id); further keys of a node are kept in attrs; endpoints that aren't declared become nodes without attributes."""
    listed, e, n = _unified_lists(docs)
    known = ["id", "node_id", *NODES]
    rest = F.map_filter(F.expr("try_variant_get(whole, '$', 'map<string,variant>')"), lambda k, _: ~k.isin(known))
    declared = listed.select("file", "pos", "e.*", F.transform_values(rest, lambda _, v: v.cast("string")).alias("attrs"))
    declared = declared.withColumn("node_id", F.coalesce(filled("id"), filled("node_id"))).where("node_id IS NOT NULL")
    declared = declared.withColumn("is_external", truth("is_external")).withColumn("ord", order(0)).withColumn("turn", F.col("file"))
    declared = conform(declared, NODES).withColumn("turn", F.col("ord.file"))
    e = e.select("file", "pos", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.kind").where("src <> '' AND dst <> ''")
    ends = e.select("file", "pos", F.col("src").alias("node_id"), F.lit(0).alias("side")).union(e.select("file", "pos", "dst", F.lit(1)))
    loose = conform(ends.join(declared.select("node_id"), "node_id", "left_anti").withColumn("ord", order(1, F.col("side"))), NODES).withColumn("turn", F.col("ord.file"))
    edges = e.withColumn("ord", order(1)).withColumn("turn", F.col("file")).select("src", "dst", "kind", "ord", "turn")
    return PropertyGraph(merged(declared.unionByName(loose), ["node_id"], list(NODES), 2 * n), merged(edges, ["src", "dst"], list(EDGES), n), {})


def _unified_lists(docs: DataFrame | Elements) -> tuple[DataFrame, DataFrame, int]:
    """``members`` of unified documents, nodes and edges, and how many both are at the most: elements in a table, from one pass over the documents."""
    if isinstance(docs, Elements):
        return members(docs, "unified", "nodes"), members(docs, "unified", "edges"), docs.rows.count()
    fields = StructType.fromDDL(GRAPH_DOCUMENT)
    node, edge = (fields[key].dataType.elementType.simpleString() for key in ("nodes", "edges"))
    whole = F.coalesce(F.expr("try_variant_get(raw, '$.nodes', 'array<variant>')"), F.array().cast("array<variant>"))
    pairs = F.zip_with("nodes", whole, lambda e, w: F.struct(e.alias("e"), w.alias("w")))  # taken from the document once, not once for each node
    none = lambda kind: F.lit(None).cast(kind)
    nodes = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["e"].alias("node"), none(edge).alias("edge"), p["w"].alias("whole")))
    edges = F.transform(F.coalesce("edges", F.array().cast(docs.schema["edges"].dataType)), lambda e, i: F.struct(i.alias("pos"), none(node).alias("node"), e.alias("edge"), none("variant").alias("whole")))
    rows = docs.select("file", F.explode_outer(F.when(F.col("functions").isNull(), F.concat(nodes, edges))).alias("m"))
    rows, seen = counted(rows.where("m IS NOT NULL").select("file", "m.*"), n=F.count(F.lit(1)))
    return rows.where("node IS NOT NULL").select("file", "pos", F.col("node").alias("e"), "whole"), rows.where("edge IS NOT NULL").select("file", "pos", F.col("edge").alias("e")), seen["n"]


def load_graph(spark: SparkSession, paths: str | Sequence[str], part_bytes: int = PART_BYTES) -> PropertyGraph:
    """One graph from documents of either kind, composed in the order given (see ``resolved``); unreadable documents fail the load.

    Where a document is larger than ``part_bytes``, or a folder of parts, documents are scanned by byte ranges of that size, else each by one task.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    files = resolved(spark, given)
    if not fits(spark, files, part_bytes):
        docs = elements(spark, files, ("functions", "nodes", "edges"), part_bytes)
        bad = docs.heads.where(kind_of_heads().isNull()).select("path").limit(1).collect()
    else:
        docs = with_order(documents(spark, [re.sub(GLOB_SIGNS, r"\\\g<0>", f) for f in files]), files)
        bad = docs.where(~F.col("parsed") | kind().isNull()).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"not a graph document: {bad[0]['path']}")
    a, b = module_graph(docs), unified_graph(docs)
    # a graph that has been merged before is in a table, as its rows are counted there
    nodes, found = counted(a.nodes.unionByName(b.nodes).withColumn("turn", F.col("ord.file")), n=F.count(F.lit(1)))
    edges, seen = counted(a.edges.unionByName(b.edges).withColumn("turn", F.col("ord.file")), n=F.count(F.lit(1)))
    return PropertyGraph(merged(nodes, ["node_id"], list(NODES), found["n"]), merged(edges, ["src", "dst"], list(EDGES), seen["n"]), {"sources": given})


def list_graph_files(spark: SparkSession, folder: str, excluded: DataFrame | None = None, modules: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """path and module of graph files below a folder, in path order; without the excluded paths, of these modules, the first ``limit``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", GRAPH_GLOB).option("recursiveFileLookup", True).load(folder).select("path", "length")
    found = found.withColumn("module", module_of_file("path"))
    if excluded is not None:
        found = found.join(excluded.select(_bare("path").alias("bare")).distinct(), _bare("path") == F.col("bare"), "left_anti")
    if modules:
        found = found.where(F.col("module").isin([m.upper() for m in modules]))
    found = found.orderBy("path")
    return found if limit is None else found.limit(limit)


def _bare(path: str) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(path, r"^[a-z]+:/+", "/")


def largest_files(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    return list_graph_files(spark, folder).orderBy(F.desc("length"), "path").limit(k)


def excluded_paths(spark: SparkSession, report: str, data_dir: str) -> DataFrame:
    """Paths of an exclusion report (a JSON array): relative_path below ``data_dir``, else path; other entries are skipped."""
    text = spark.read.text(report, wholetext=True)
    is_array = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    rows = text.select(F.when(is_array, F.from_json("value", "array<string>")).otherwise(F.raise_error(F.lit("an exclusion report is a JSON array")).cast("array<string>")).alias("r")).select(F.explode("r").alias("one"))
    entry = rows.select(F.from_json("one", "relative_path string, path string").alias("e")).select("e.*")
    return entry.select(F.coalesce(F.concat(F.lit(data_dir.rstrip("/") + "/"), filled("relative_path")), filled("path")).alias("path")).where("path IS NOT NULL")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One row per module: module, source (file), and the columns of METADATA_DOCUMENT; of several files of a module the first by path. Bad JSON is left out."""
    rows = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", plain_path(F.col("_metadata.file_path")).alias("source"))
    rows = rows.where(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.json$", "")
    rows = rows.select(normalised_module(stem).alias("module"), "source", F.from_json("value", METADATA_DOCUMENT).alias("m"))
    first = F.row_number().over(Window.partitionBy("module").orderBy("source"))
    return rows.withColumn("rn", first).where("rn = 1").select("module", "source", "m.*")


def module_imports(meta: DataFrame) -> DataFrame:
    """module, symbol, symbol_uc, target (as named), pos."""
    i = meta.select("module", F.posexplode("imports").alias("pos", "i")).select("module", "pos", normalised_module("i.module").alias("target"), F.explode("i.functions.name").alias("symbol"))
    return i.where("symbol <> ''").select("module", "symbol", F.upper("symbol").alias("symbol_uc"), "target", "pos")


def module_exports(meta: DataFrame) -> DataFrame:
    """module, symbol, symbol_uc, pos."""
    e = meta.select("module", F.posexplode("exports").alias("pos", "e")).select("module", "pos", F.col("e.name").alias("symbol")).where("symbol <> ''")
    return e.select("module", "symbol", F.upper("symbol").alias("symbol_uc"), "pos")


def modules(meta: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """The record of each binary: program, path, sha256, file_version, pdb_guid, pdb_age (of the first RSDS entry)."""
    first = F.get(F.filter("debug", lambda d: d["codeview"]["signature"] == "RSDS"), F.lit(0))["codeview"]
    rows = meta.select(F.col("module").alias("program"), F.coalesce("path", "source").alias("path"), first["guid"].alias("pdb_guid"), first["age"].alias("pdb_age"))
    if digests is None:
        return rows.select("program", "path", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("file_version"), "pdb_guid", "pdb_age")
    d = digests.select(F.lower(_bare("path")).alias("key"), "sha256", "file_version")
    return rows.join(d, F.lower("path") == F.col("key"), "left").select("program", "path", "sha256", "file_version", "pdb_guid", "pdb_age")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256 and file_version of files below a folder; the version is null where a file has no fixed version block."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), fixed_version("content").alias("file_version"))


def inventory(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Files below a folder that begin as binaries do (MZ): path, length, sha256, file_version, and machine, sections, entry_point and subsystem of the header, null where there is none; the first ``limit`` by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(is_binary("content"))
    if limit is not None:
        rows = rows.join(F.broadcast(rows.select("path").orderBy("path").limit(limit)), "path", "left_semi")
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), fixed_version("content").alias("file_version"), pe_header("content").alias("h")).select("path", "length", "sha256", "file_version", "h.*")


def inventory_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row: total_files and pe_files below a folder; empty files are none of them, as Spark lists none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(is_binary("content")).alias("pe_files"))


def inventory_summary(meta: DataFrame, binaries: DataFrame | None = None, relative_to: str | None = None) -> DataFrame:
    """One row per module for a CSV: path (below ``relative_to``), header facts of ``binaries`` (as ``inventory`` gives them), counts of exports and imports, and the first RSDS link."""
    first = F.get(F.filter("debug", lambda d: d["codeview"]["signature"] == "RSDS"), F.lit(0))["codeview"]
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    imported = F.aggregate(F.coalesce("imports", F.array().cast(StructType.fromDDL(METADATA_DOCUMENT)["imports"].dataType)), F.lit(0), lambda n, i: n + F.greatest(F.coalesce(F.size(i["functions"]), F.lit(0)), F.lit(0)))
    rows = meta.select(F.col("module"), F.coalesce("path", "source").alias("path"), F.greatest(size("exports"), F.lit(0)).alias("exports"), F.greatest(size("imports"), F.lit(0)).alias("import_modules"), imported.alias("imports"), first["pdb_path"].alias("pdb_path"), first["guid"].alias("guid"), first["age"].alias("age"))
    facts = ["machine", "subsystem", "entry_point", "sections"]
    if binaries is None:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in facts])
    else:
        of = binaries.select(F.lower(_bare("path")).alias("key"), *[F.col(c).cast("string").alias(c) for c in facts])
        rows = rows.join(of, F.lower("path") == F.col("key"), "left").drop("key")
    base = (relative_to or "").rstrip("/") + "/"
    path = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 2**31 - 1)).otherwise(F.col("path")) if relative_to else F.col("path")
    return rows.select("module", path.alias("path"), *facts, "exports", "import_modules", "imports", "pdb_path", "guid", "age")


def metadata_of_binary(meta: DataFrame, binaries: DataFrame) -> DataFrame:
    """binary and source of its metadata: a file of the binary's name first, else an equal lower-cased path inside the document."""
    own_name = F.concat(F.element_at(F.split(F.lower("binary"), r"[/\\]"), -1), F.lit(".json"))
    by_place = binaries.join(meta.select("source"), F.element_at(F.split(F.lower("source"), "/"), -1) == own_name).withColumn("rule", F.lit(0))
    by_path = binaries.join(meta.select("source", F.lower("path").alias("key")), F.lower("binary") == F.col("key")).drop("key").withColumn("rule", F.lit(1))
    ranked = F.row_number().over(Window.partitionBy("binary").orderBy("rule", "source"))
    return by_place.unionByName(by_path).withColumn("rn", ranked).where("rn = 1").select("binary", "source")


def batch_plan(meta: DataFrame, include: Sequence[str], existing: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Binaries (module, path) named by the metadata below one of the prefixes, without existing outputs (module), in file order."""
    rows = meta.where(filled("path").isNotNull())
    if include:
        rows = rows.where(reduce(lambda a, b: a | b, [F.lower("path").startswith(p.lower()) for p in include]))
    if existing is not None:
        rows = rows.join(existing.select("module"), "module", "left_anti")
    rows = rows.orderBy("source").select("module", "path")
    return rows if limit is None else rows.limit(limit)
