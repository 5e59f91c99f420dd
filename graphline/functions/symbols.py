"""CodeView records, symbol signatures and file magic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _reversed_hex(data: Column, at: int, length: int) -> Column:
    """Hex of ``length`` bytes from position ``at`` (1-based), last byte first."""
    return F.concat(*[F.hex(F.substring(data, k, 1)) for k in range(at + length - 1, at - 1, -1)])


def _number(data: Column, at: int) -> Column:
    return F.conv(_reversed_hex(data, at, 4), 16, 10).cast("long")


def _text(data: Column, at: int) -> Column:
    """The NUL-terminated string that begins at ``at``."""
    return F.substring_index(F.decode(F.substring(data, at, 2**31 - 1 - at), "UTF-8"), "\0", 1)


def parse_codeview(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds ``codeview``: signature, guid, age, timestamp, pdb_path and symbol_server_path of RSDS and NB10 records.

    A record of another kind fails the job with a message, as does null.
    """
    data = F.col("record")
    guid = F.concat_ws("-", _reversed_hex(data, 5, 4), _reversed_hex(data, 9, 2), _reversed_hex(data, 11, 2), F.hex(F.substring(data, 13, 2)), F.hex(F.substring(data, 15, 6)))
    age = _number(data, 21)
    rsds = F.struct(
        F.lit("RSDS").alias("signature"), guid.alias("guid"), age.alias("age"), F.lit(None).cast("long").alias("timestamp"), _text(data, 25).alias("pdb_path"),
        F.concat(F.replace(guid, F.lit("-"), F.lit("")), F.hex(age)).alias("symbol_server_path"),
    )
    none = F.lit(None).cast("string")
    nb10 = F.struct(F.lit("NB10").alias("signature"), none.alias("guid"), _number(data, 13).alias("age"), _number(data, 9).alias("timestamp"), _text(data, 17).alias("pdb_path"), none.alias("symbol_server_path"))
    kind = F.hex(F.substring(data, 1, 4))
    found = F.when(kind == "52534453", rsds).when(kind == "4E423130", nb10).otherwise(F.raise_error(F.lit("unsupported CodeView signature")).cast(rsds_type()))
    return records.withColumn("record", F.col(column)).withColumn("codeview", found).drop(*([] if column == "record" else ["record"]))


def rsds_type() -> str:
    return "struct<signature:string,guid:string,age:bigint,timestamp:bigint,pdb_path:string,symbol_server_path:string>"


def compressed_name(name: str | Column) -> Column:
    """The last character of a three-letter extension becomes _; without an extension _ is appended."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.rlike(r"\.[^.]{3}$"), F.regexp_replace(c, r".$", "_")).otherwise(F.concat(c, F.lit("_")))


def is_cabinet(content: str | Column) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.hex(F.substring(c, 1, 4)) == "4D534346", F.lit(False))


def rsds_entries(metadata: DataFrame) -> DataFrame:
    """(pdb_name, identifier, source) of RSDS debug entries; ``metadata`` has debug and source."""
    entry = metadata.select("source", F.explode("debug").alias("d")).select("source", "d.codeview.*").where("signature = 'RSDS'")
    name = F.substring_index(F.replace(F.col("pdb_path"), F.lit("/"), F.lit("\\")), "\\", -1)
    return entry.select(name.alias("pdb_name"), F.col("symbol_server_path").alias("identifier"), "source").where("pdb_name <> '' AND identifier <> ''")


def gather_signatures(metadata: DataFrame, max_unique: int | None = None, pdb_filter: Sequence[str] | None = None) -> DataFrame:
    """Distinct (pdb_name, identifier) with the sorted files they stand in."""
    entries = rsds_entries(metadata)
    if pdb_filter is not None:
        entries = entries.where(F.lower("pdb_name").isin([p.lower() for p in pdb_filter]))
    found = entries.groupBy("pdb_name", "identifier").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return found if max_unique is None else found.orderBy("pdb_name", "identifier").limit(max_unique)


def fetch_plan(metadata: DataFrame, pdb_names: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """What a symbol download would ask for: pdb_name, identifier, compressed name and the path under a store."""
    found = gather_signatures(metadata, limit, pdb_names)
    return found.select("pdb_name", "identifier", compressed_name("pdb_name").alias("compressed"), F.concat_ws("/", "pdb_name", "identifier", "pdb_name").alias("relative_path"))


def file_version(ms: str | Column, ls: str | Column) -> Column:
    """a.b.c.d from the two version words of a binary."""
    m, n = (F.col(c) if isinstance(c, str) else c for c in (ms, ls))
    low = F.lit(0xFFFF)
    return F.concat_ws(".", F.shiftright(m, 16).bitwiseAND(low), m.bitwiseAND(low), F.shiftright(n, 16).bitwiseAND(low), n.bitwiseAND(low))


#: Bytes that a fixed version block begins with: its signature and the version of its own layout. Fixed values of the format.
VERSION_MARK = "\u00bd\u0004\u00ef\u00fe\u0000\u0000\u0001\u0000"


def fixed_version(content: str | Column) -> Column:
    """a.b.c.d of the first fixed version block in a binary, null without one."""
    c = F.col(content) if isinstance(content, str) else content
    # one character a byte, so places in the text are places in the bytes
    at = F.locate(VERSION_MARK, F.decode(c, "ISO-8859-1"))
    word = lambda skip: F.conv(F.concat(*[F.hex(F.substring(c, at + (skip + k), F.lit(1))) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    return F.when((at > 0) & (F.octet_length(c) >= at + 15), file_version(word(8), word(12)))


def is_binary(content: str | Column) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.hex(F.substring(c, 1, 2)) == "4D5A", F.lit(False))


def pe_header(content: str | Column) -> Column:
    """machine, sections, entry_point and subsystem of a binary's header; null where it isn't whole."""
    c = F.col(content) if isinstance(content, str) else content
    number = lambda at, size: F.conv(F.concat(*[F.hex(F.substring(c, at + k, F.lit(1))) for k in reversed(range(size))]), 16, 10).cast("long")
    start = number(F.lit(61), 4) + 1  # where the header begins, from 1
    begin = F.least(start, F.octet_length(c) + 1).cast("int")
    whole = (F.octet_length(c) >= 64) & (F.hex(F.substring(c, begin, F.lit(4))) == "50450000") & (F.octet_length(c) >= begin + 93)
    fields = F.struct(F.concat(F.lit("0x"), F.lower(F.hex(number(begin + 4, 2)))).alias("machine"), number(begin + 6, 2).alias("sections"), F.concat(F.lit("0x"), F.lower(F.hex(number(begin + 40, 4)))).alias("entry_point"), number(begin + 92, 2).alias("subsystem"))
    return F.when(whole, fields)
