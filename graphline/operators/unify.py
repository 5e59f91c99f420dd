"""Unifying module graphs: imports resolved across modules, aliases, layers and kinds of edges.

Without state: real functions take their ids first, and a
placeholder is made only for a symbol that no module defines, so the outcome
doesn't depend on the order of the files. Symbols are matched in upper case and
keep the case of their first definition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphline.functions.labels import filled, has_prefix, is_alias, normalised_module, symbol_name
from graphline.model import PropertyGraph, by_node
from graphline.operators import quality
from graphline.operators.reach import has_path
from graphline.operators.spread import FEW_ROWS
from graphline.plans.buckets import bucketed
from graphline.plans.iterate import counted, cut
from graphline.schema import EDGES, LIBRARY, NODES, SYSCALL, conform
from graphline.sources.readers import module_exports, module_imports, module_lists

DEFAULT_HOST = "KERNELBASE.DLL"
SYSCALL_MODULE, SYSCALL_PREFIXES = "NTDLL.DLL", ("Nt", "Zw")


def alias_hosts(metadata: DataFrame) -> DataFrame:
    """(module, host) of alias modules: DEFAULT_HOST if they import from it, else their last import that is no alias, else DEFAULT_HOST."""
    named = metadata.where(is_alias("module")).select("module", F.posexplode_outer("imports").alias("pos", "i")).select("module", "pos", normalised_module("i.module").alias("host"))
    real = (F.col("host") != "") & ~is_alias("host")
    found = named.groupBy("module").agg(F.max(F.when(F.col("host") == DEFAULT_HOST, F.lit(DEFAULT_HOST))).alias("default"), F.max_by(F.when(real, F.col("host")), F.when(real, F.col("pos"))).alias("last"))
    return found.select("module", F.coalesce("default", "last", F.lit(DEFAULT_HOST)).alias("host"))


def resolved(rows: DataFrame, column: str, hosts: DataFrame) -> DataFrame:
    """Alias modules in ``column`` replaced by their hosts; an alias without metadata by DEFAULT_HOST."""
    found = rows.join(hosts.select(F.col("module").alias("alias"), "host"), F.col(column) == F.col("alias"), "left")
    return found.withColumn(column, F.coalesce("host", F.when(is_alias(column), F.lit(DEFAULT_HOST)).otherwise(F.col(column)))).drop("alias", "host")


def place(of: str = "ord") -> Column:
    """An ord as one number in the same order; its side is always 0 here."""
    return F.shiftleft(F.col(f"{of}.file").cast("long"), 32) + F.shiftleft(F.col(f"{of}.phase").cast("long"), 31) + F.col(f"{of}.pos")


def ord_of(place: str) -> Column:
    """The ord that a number stands for."""
    file, phase, pos = F.shiftright(place, 32), F.shiftright(place, 31).bitwiseAND(F.lit(1)), F.col(place).bitwiseAND(F.lit((1 << 31) - 1))
    return F.when(F.col(place).isNotNull(), F.struct(file.cast("int").alias("file"), phase.cast("int").alias("phase"), pos.cast("int").alias("pos"), F.lit(0).alias("side")))


#: Kinds of edges in the order in which they are found; of several kinds of a pair the last one shows. Forwarders come from stubs, then from alias modules.
KINDS = ("direct", "import", "forwarder", "forwarder", "syscall")


#: Who asks for a symbol of a module: a stub, an alias module for its own symbol, or for that of its host.
STUB, ALIAS, HOST = 0, 1, 2


class Unified:
    """What ``unify`` found; each part is planned, and made, only when it is asked for.

    nodes; paired: (src, dst, kind, kinds, ord), with all kinds of a pair; graph: both in tables; kinds: (src, dst,
    kinds); unresolved: (module, symbol, n_refs).
    """

    def __init__(self, f: DataFrame, calls: DataFrame, exports: DataFrame, imports: DataFrame, hosts: DataFrame):
        self.f, self.calls = f, calls
        keys = ["module", "symbol_uc"]
        # a symbol is its name where there is one, so stubs are dealt by symbol_uc as f is
        self.stubs = f.where("imported AND name <> ''").select("module", "node_id", "entry_point", "place", "name", "symbol_uc")
        # dealt by what they are joined on before they are made distinct, so that they aren't dealt again
        self.imports = imports.repartition(*keys).dropDuplicates()
        self.aliased = exports.join(hosts, "module").select("module", "host", "symbol", "symbol_uc")

    @cached_property
    def asked(self) -> DataFrame:
        """(module, symbol_uc, symbol, id, made, role, asker, src, entry_point, place, name): what stubs and aliases ask for, dealt by the module that is to provide it and the symbol.

        The id is that of a defined function first, else of an imported one, else of a placeholder; symbol and id are
        null for a stub that no import names, which stays with its own module. An alias asks by itself (ALIAS) and by its host (HOST).
        """
        keys = ["module", "symbol_uc"]
        none = lambda kind: F.lit(None).cast(kind)
        stubs = self.stubs.join(by_node(self.imports), keys, "left").select(
            F.coalesce("target", "module").alias("module"), "symbol_uc", F.when(F.col("target").isNotNull(), F.col("name")).alias("wanted"), F.lit(STUB).alias("role"), F.col("module").alias("asker"), F.col("node_id").alias("src"), "entry_point", "place", "name",
        )
        of = lambda end, role: self.aliased.select(end, "symbol_uc", "symbol", F.lit(role), "module", none("string"), none("string"), none("long"), none("string"))
        own = self.f.where("leads").select(*keys, F.col("node_id").alias("own_id"))
        found = stubs.union(of("module", ALIAS)).union(of("host", HOST)).join(by_node(own), keys, "left").withColumn("symbol", F.min("wanted").over(Window.partitionBy(*keys)))
        made = F.col("own_id").isNull()
        # a stub without an import may meet others that ask for the same symbol of its module
        found = found.withColumn("symbol", F.when(F.col("wanted").isNotNull(), F.col("symbol"))).withColumn("id", F.when(F.col("wanted").isNotNull(), F.when(made, F.concat_ws("!", "module", "symbol")).otherwise(F.col("own_id"))))
        return bucketed(found.select(*keys, "symbol", "id", made.alias("made"), "role", "asker", "src", "entry_point", "place", "name"), *keys, dealt=True)

    @property
    def named(self) -> DataFrame:
        """(module, symbol_uc, symbol, id, made): ids by module and symbol."""
        return self.asked.where("id IS NOT NULL").select("module", "symbol_uc", "symbol", "id", "made").distinct()

    def _calls_out(self) -> DataFrame:
        return self.f.where((F.col("module") == SYSCALL_MODULE) & has_prefix(F.coalesce("name", F.lit("")), SYSCALL_PREFIXES, False)).withColumn("syscall", F.concat(F.lit("SYSCALL:"), "name"))

    @cached_property
    def nodes(self) -> DataFrame:
        functions = self.f.select("node_id", F.col("module").alias("program"), F.col("symbol").alias("name"), F.col("entry_point").alias("address"), F.col("imported").alias("is_external"), "calling_convention", "source", F.lit(LIBRARY).alias("layer"), ord_of("place").alias("ord"))
        made = self.named.where("made").select(F.col("id").alias("node_id"), F.col("module").alias("program"), F.col("symbol").alias("name"), F.lit(True).alias("is_external"), F.lit("SYNTHETIC").alias("source"), F.lit(LIBRARY).alias("layer"))
        syscalls = self._calls_out().select(F.col("syscall").alias("node_id"), F.lit("SYSCALL").alias("program"), "name", F.lit(True).alias("is_external"), F.lit("SYSCALL").alias("source"), F.lit(SYSCALL).alias("layer")).distinct()
        return reduce(DataFrame.unionByName, [conform(n, NODES) for n in (functions, made, syscalls)])

    @property
    def leads(self) -> DataFrame:
        """(src, dst, module, entry_point, place): where each stub leads."""
        return self.asked.where((F.col("role") == STUB) & F.col("id").isNotNull()).select("src", F.col("id").alias("dst"), F.col("asker").alias("module"), "entry_point", "place")

    @property
    def aliases(self) -> DataFrame:
        """(src, dst): from an alias module's symbol to that of its host."""
        end = lambda role, to: self.asked.where(F.col("role") == role).select("asker", "symbol_uc", F.col("id").alias(to))
        return end(ALIAS, "src").join(end(HOST, "dst"), ["asker", "symbol_uc"]).select("src", "dst")

    @cached_property
    def ends(self) -> DataFrame:
        """(module, src, dst, by_import, unled, place) of calls between functions that stay: a row for each id that the call leads to, or one with the name of an import that nothing provides."""
        keys = ["module", "entry_point"]
        # an address is that of its last function; a stub is there once for each of its targets
        stubs = self.asked.where((F.col("role") == STUB) & (F.col("entry_point") != "")).select(F.col("asker").alias("module"), "entry_point", F.col("src").alias("node_id"), "place", F.lit(True).alias("by_import"), F.col("id").alias("dst"), F.when(F.col("id").isNull(), F.col("name")).alias("unled"))
        own = self.f.where((F.col("entry_point") != "") & ~(F.col("imported") & (F.coalesce("name", F.lit("")) != ""))).select(*keys, "node_id", "place", F.lit(False), "node_id", F.lit(None).cast("string"))
        last = Window.partitionBy(*keys).orderBy(F.desc("place"), "node_id")
        at = stubs.union(own).withColumn("last", F.rank().over(last)).withColumn("nth", F.row_number().over(last)).where("last = 1")
        at = bucketed(at.select(*keys, "node_id", "by_import", "dst", "unled", (F.col("nth") == 1).alias("one")), *keys, dealt=True)
        found = self.calls.join(by_node(at.where("one").select("module", F.col("entry_point").alias("caller"), F.col("node_id").alias("src"))), ["module", "caller"])
        return cut(found.join(by_node(at.select("module", F.col("entry_point").alias("callee"), "dst", "by_import", "unled")), ["module", "callee"]).select("module", "src", "dst", "by_import", "unled", "place"))

    @property
    def ungrouped(self) -> DataFrame:
        """(src, dst) of all edges, a pair once for each call, stub or alias that makes it: what asks whether there is an edge needs no grouping by pairs."""
        if "paired" in vars(self):
            return self.paired.select("src", "dst")
        few = cut(self.aliases.union(self._calls_out().select("node_id", "syscall")))
        return self.ends.where("dst IS NOT NULL").select("src", "dst").union(self.leads.select("src", "dst")).union(few)

    @cached_property
    def paired(self) -> DataFrame:
        none = F.lit(None).cast("long").alias("place")
        # kinds are bits by their place in KINDS
        bit = lambda k: F.lit(1 << k).alias("bits")
        every = self.ends.where("dst IS NOT NULL").select("src", "dst", F.when(F.col("by_import"), 2).otherwise(1).alias("bits"), "place")
        every = every.union(self.leads.select("src", "dst", bit(2), "place")).union(self.aliases.select("src", "dst", bit(3), none)).union(self._calls_out().select("node_id", "syscall", bit(4), "place"))
        pairs = every.groupBy("src", "dst").agg(F.bit_or("bits").alias("bits"), F.min("place").alias("place"))
        held = [F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, kind) for k, kind in enumerate(KINDS)]
        return pairs.select("src", "dst", F.coalesce(*reversed(held)).alias("kind"), F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))).alias("kinds"), ord_of("place").alias("ord"))

    @property
    def edges(self) -> DataFrame:
        return conform(self.paired, EDGES)

    @property
    def kinds(self) -> DataFrame:
        return self.paired.select("src", "dst", "kinds")

    @cached_property
    def graph(self) -> PropertyGraph:
        self.paired = cut(self.paired)
        return PropertyGraph(cut(self.nodes), self.edges, {})

    @cached_property
    def unresolved(self) -> DataFrame:
        by = [F.col("asker").alias("module"), F.col("name").alias("symbol")]
        loose = self.asked.where((F.col("role") == STUB) & F.col("id").isNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("own"))
        used = self.ends.where("unled IS NOT NULL").groupBy("module", F.col("unled").alias("symbol")).agg(F.count(F.lit(1)).alias("calls"))
        return cut(loose.join(used, ["module", "symbol"], "left").select("module", "symbol", (F.col("own") + F.coalesce("calls", F.lit(0))).alias("n_refs")))


def unify(docs: DataFrame, metadata: DataFrame, include_internal: bool = False) -> Unified:
    """``docs``: module graph documents with their order; ``metadata``: one row per module."""
    exports, hosts = module_exports(metadata), cut(alias_hosts(metadata))
    imports = resolved(module_imports(metadata), "target", hosts).where("target <> ''").select("module", "symbol_uc", "target")
    functions, calls, _ = module_lists(docs)

    # functions that stay, with their ids; dealt once, by what the windows and the join share
    keys = ["module", "symbol_uc"]
    f = functions.withColumn("module", normalised_module("program")).withColumn("symbol", symbol_name()).withColumn("symbol_uc", F.upper("symbol")).withColumn("place", place())
    f = f.select(*keys, "symbol", "name", "entry_point", "calling_convention", "source", "place", F.coalesce(F.col("source") == "IMPORTED", F.lit(False)).alias("imported"))
    listed = exports.select(*keys).repartition(*keys).dropDuplicates().withColumn("exported", F.lit(True))
    f = f.join(by_node(listed), keys, "left").withColumn("exported", F.coalesce("exported", F.lit(False))).where(F.col("imported") | F.col("exported") | F.lit(include_internal))
    nth = F.row_number().over(Window.partitionBy(*keys, "symbol").orderBy("place"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("imported", "place"))
    base = F.concat_ws("!", "module", "symbol")
    f = f.withColumn("node_id", F.when(nth == 1, base).otherwise(F.concat(base, F.lit("@"), F.coalesce("entry_point", F.lit(""))))).withColumn("leads", first == 1)
    # kept dealt by module and symbol: stubs and ids are joined on them again
    f = bucketed(f.withColumn("source", F.coalesce(filled("source"), F.when(F.col("exported"), "EXPORTED"))).drop("exported"), *keys, dealt=True)
    calls = calls.select(normalised_module("program").alias("module"), "caller", "callee", place().alias("place"))
    return Unified(f, calls, exports, imports, hosts)


#: Paths that a graph of the system's modules should have: fixed values of the acceptance step.
ACCEPTANCE = (("KERNEL32.DLL!CreateFileW", "SYSCALL:NtCreateFile"), ("API-MS-WIN-CORE-FILE-L1-2-0.DLL!CreateFileW", "KERNELBASE.DLL!CreateFileW"))
VERDICTS = "check string, subject string, verdict string"


@dataclass
class Built:
    """unified; verdicts: (check, subject, verdict), verdict being ok, failed or skipped."""

    unified: Unified
    verdicts: DataFrame


def integrity(unified: Unified, listed: int = 5) -> list[tuple[str, str, str]]:
    """Dangling edges and ids that stand for several nodes, which a graph must not have, and imports that nothing provides, which it may; of these the first by name."""
    lost, twice = quality.ids_amiss(unified.nodes, unified.ungrouped)
    dangling = quality.dangling_edges(unified.nodes, unified.edges).count() if lost else 0
    loose = unified.unresolved.count()
    sample = ", ".join(f"{r['module']}!{r['symbol']}" for r in unified.unresolved.orderBy("module", "symbol").limit(listed).collect())
    return [
        ("dangling edges", str(dangling), "failed" if dangling else "ok"), ("duplicate ids", str(twice), "failed" if twice else "ok"),
        ("unresolved imports", f"{loose}: {sample}" if loose else "0", "failed" if loose else "ok"),
    ]


def acceptance(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(check, subject, verdict) of whether each pair (source, target) has a path; skipped where one of both isn't a node. ``edges`` may hold a pair more than once."""
    pairs, seen = counted(pairs.select("source", "target").distinct(), n=F.count(F.lit(1)))
    ends = pairs.select(F.col("source").alias("node_id")).union(pairs.select("target")).distinct()
    # ids are looked up among those that are asked for, not those among all
    here = cut(nodes.select("node_id").join(F.broadcast(ends) if seen["n"] <= FEW_ROWS else by_node(ends), "node_id", "left_semi").distinct())
    known = pairs.join(here.withColumnRenamed("node_id", "source"), "source", "left_semi").join(here.withColumnRenamed("node_id", "target"), "target", "left_semi")
    reachable = has_path(PropertyGraph(nodes, edges), cut(known), dealt=False)
    found = pairs.join(reachable, ["source", "target"], "left")
    verdict = F.when(F.col("reachable").isNull(), "skipped").when(F.col("reachable"), "ok").otherwise("failed")
    return found.select(F.lit("path").alias("check"), F.concat_ws(" -> ", "source", "target").alias("subject"), verdict.alias("verdict"))


def build(docs: DataFrame, metadata: DataFrame, include_internal: bool = False, pairs: DataFrame | None = None, ratio: float = 0.8) -> Built:
    """``unify``, then integrity, then acceptance: paths that should be there (ACCEPTANCE by default) and the share of system calls.

    Dangling edges and duplicate ids are errors; everything else is a verdict.
    """
    unified = unify(docs, metadata, include_internal)
    spark = docs.sparkSession
    told = integrity(unified)
    if wrong := [f"{subject} {check}" for check, subject, verdict in told[:2] if verdict == "failed"]:
        raise ValueError("; ".join(wrong))
    pairs = spark.createDataFrame(list(ACCEPTANCE), "source string, target string") if pairs is None else pairs
    row = quality.syscall_ratio(unified.nodes, module_exports(metadata), ratio).first()
    told.append(("system calls", f"{row['actual']} of {row['expected']}", "ok" if row["ok"] else "failed"))
    return Built(unified, spark.createDataFrame(told, VERDICTS).unionByName(acceptance(unified.nodes, unified.ungrouped, pairs)))
