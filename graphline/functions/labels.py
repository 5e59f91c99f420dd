"""Labels, predicates and display values as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_PREFIXES = ("Nt", "Zw")
PROGRAM_HINT = "ntdll.dll"


def filled(column: str | Column) -> Column:
    """The string, or null where it is empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != "", c)


def label(node_id: str = "node_id") -> Column:
    """Name, else qualified name, else address, else the node's id; empty strings count as missing."""
    return F.coalesce(filled("name"), filled("qualified_name"), filled("address"), F.col(node_id))


def name_label(name_attr: str = "name") -> Column:
    """The label that unreferenced targets go by: the address isn't used, nothing gives ''."""
    return F.coalesce(filled(name_attr), filled("qualified_name"), F.lit(""))


def display_label(prefix_program: bool = True) -> Column:
    """At most 48 characters (45 and an ellipsis), then ``program:`` before it."""
    text = label()
    short = F.when(F.length(text) > 48, F.concat(F.substring(text, 1, 45), F.lit("..."))).otherwise(text)
    return F.when(filled("program").isNotNull(), F.concat_ws(":", "program", short)).otherwise(short) if prefix_program else short


def normalised(prefixes: str | Sequence[str]) -> list[str]:
    return [prefixes] if isinstance(prefixes, str) else list(prefixes)


def has_prefix(text: Column, prefixes: str | Sequence[str], if_empty: bool) -> Column:
    """Whether the text begins with one of the prefixes; ``if_empty`` is the answer for no prefixes at all."""
    found = [text.startswith(p) for p in normalised(prefixes)]
    return reduce(lambda a, b: a | b, found) if found else F.lit(if_empty)


def program_ends_with(hint: str) -> Column:
    return F.coalesce(F.lower("program").endswith(hint.lower()), F.lit(False))


def is_target(program_hint: str | None = PROGRAM_HINT, prefixes: str | Sequence[str] = TARGET_PREFIXES) -> Column:
    """A label with a prefix (any label if there are none), in a program that the hint ends, if one is given."""
    named = has_prefix(label(), prefixes, if_empty=True)
    return named if program_hint is None else named & program_ends_with(program_hint)


def is_candidate(programs: Sequence[str] | None = None) -> Column:
    """source is DEFAULT, and the program is one of ``programs`` (exactly) or, without them, doesn't end in ntdll.dll."""
    where = F.col("program").isin(list(programs)) if programs else ~program_ends_with(PROGRAM_HINT)
    return F.coalesce(where & (F.col("source") == "DEFAULT"), F.lit(False))


def normalised_module(name: str | Column) -> Column:
    """Trimmed and upper-cased, with .DLL unless it ends in .dll or .exe; blank and null give ''."""
    c = F.trim(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    return F.when(c == "", "").when(c.rlike(r"(?i)\.(dll|exe)$"), F.upper(c)).otherwise(F.upper(F.concat(c, F.lit(".dll"))))


def module_of_file(path: str | Column) -> Column:
    """Module key of a graph file: its name without .callgraph.json, normalised."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return normalised_module(F.regexp_replace(name, r"\.callgraph\.json$", ""))


def symbol_name(entry: str = "entry_point") -> Column:
    """Name, else qualified name, else entry point, else sub_ and a number from the row's hash."""
    return F.coalesce(filled("name"), filled("qualified_name"), filled(entry), F.concat(F.lit("sub_"), F.pmod(F.xxhash64("name", "qualified_name", entry, "ord"), F.lit(65536)).cast("string")))


def is_alias(module: str | Column) -> Column:
    return F.upper(module).rlike("^(API|EXT)-MS-")


def hex_address(number: str | Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(number))


def brief_list(names: str | Column, most: int = 5) -> Column:
    """The first names of a sorted array, and how many more there are."""
    every = F.array_sort(names)
    more = F.size(every) - most
    head = F.array_join(F.slice(every, 1, most), ", ")
    return F.when(more > 0, F.concat(head, F.lit(", ... (+"), more.cast("string"), F.lit(")"))).otherwise(head)


def path_text(labels: str | Column, most: int = 8) -> Column:
    return F.array_join(F.slice(labels, 1, most), " → ")


def with_colour_index(nodes: DataFrame, colours: int, grey_unknown: bool = True) -> DataFrame:
    """``colour``: position of the program among the sorted distinct programs, modulo ``colours``; -1 for unknown."""
    program = F.coalesce(filled("program"), F.lit("unknown"))
    known = nodes.select(program.alias("colour_program")).distinct()
    # one row per program
    ranked = known.withColumn("colour", ((F.dense_rank().over(Window.orderBy("colour_program")) - 1) % colours).cast("int"))
    if grey_unknown:
        ranked = ranked.withColumn("colour", F.when(F.col("colour_program") == "unknown", -1).otherwise(F.col("colour")))
    return nodes.withColumn("colour_program", program).join(ranked, "colour_program").drop("colour_program")


def with_size(nodes: DataFrame, mode: str = "fixed", degree: str = "degree") -> DataFrame:
    """``size``: 22 for all (fixed), 18 to 46 by degree (degree; 28 where all are equal), or 50 + 5 * degree (plot)."""
    if mode == "fixed":
        return nodes.withColumn("size", F.lit(22.0))
    if mode == "plot":
        return nodes.withColumn("size", (50 + 5 * F.col(degree)).cast("double"))
    if mode != "degree":
        raise ValueError(f"unknown size mode: {mode}")
    ends = F.broadcast(nodes.agg(F.min(degree).alias("least"), F.max(degree).alias("most")))  # one row
    sized = F.when(F.col("most") == F.col("least"), 28.0).otherwise(18.0 + (F.col(degree) - F.col("least")) / F.nullif(F.col("most") - F.col("least"), F.lit(0)) * 28.0)
    return nodes.crossJoin(ends).withColumn("size", sized).drop("least", "most")


def with_hub(nodes: DataFrame, size: str = "size", share: float = 0.85) -> DataFrame:
    """``hub``: at least the value at rank max(0, int(share * n) - 1) of the sorted sizes.

    The rank is found in the counts by size, so the sizes of all nodes are never sorted in one place.
    """
    counts = nodes.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(size).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).crossJoin(F.broadcast(nodes.agg(F.greatest(F.lit(0), F.floor(F.count(F.lit(1)) * share) - 1).alias("rank"))))
    cutoff = ranked.where(F.col("upto") > F.col("rank")).agg(F.min(size).alias("cutoff"))
    return nodes.crossJoin(F.broadcast(cutoff)).withColumn("hub", F.col(size) >= F.col("cutoff")).drop("cutoff")
