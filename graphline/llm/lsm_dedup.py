"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

A memtable is a batch of at most as many rows as the tasks of one stage hold
together. Flushing it writes a run: one row per digest with the smallest
identifier and the number of records, sorted by digest, and a Bloom filter of the
digests (see filters.py). A level that has ``fanout`` runs is compacted into one
run of the next level, which keeps the smallest identifier of each digest. The
runs and their levels are listed in a manifest, so an index can be opened again
and go on with the next batch; a look-up reads only runs whose filter passes a key.

A digest that is shared is only a hit: the texts are compared byte for byte before
a record is dropped, and texts that differ under one digest are regrouped by the
text itself. Only texts whose digest passes the filter of shared digests move, and
equal texts of a task move once. Decisions are made on slim rows, which know the
place (block, row) of their text.

Which record stays is a matter of the identifier: ``keep="largest"`` uses the
bitwise complement of doc_id, so the smallest identifier is the largest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphline.llm.common import ascii_lower, by_key, shared_dir, shuffle_partitions, stored
from graphline.llm.filters import bloom, passing, tested
from graphline.llm.places import placed

#: Identifier of a row without doc_id; larger than any other.
NONE = 2**63 - 1
#: Rows of a memtable for each shuffle partition.
MEMTABLE = 1 << 20

RUN = "digest binary, best struct<ident:long,block:long,row:long>, records long"
MANIFEST = "level int, path string"


def key_of(digest: Column) -> Column:
    """The 64-bit key of a digest in filters."""
    return F.xxhash64(digest)


class LsmIndex:
    """Runs (RUN) by level, each with its filter.

    ``best`` is the smallest identifier, ties by the place of the row. Rows are
    given as (digest, ident, block, row). ``root`` is a folder that all nodes share.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 4):
        self.spark, self.fanout, self.version = spark, fanout, 0
        self.root = root or shared_dir(spark, "lsm")
        self.levels: list[list[str]] = [[]]
        self.runs = 0

    @staticmethod
    def open(spark: SparkSession, root: str, version: int, fanout: int = 4) -> LsmIndex:
        """The index as it was after its ``version``-th change."""
        index = LsmIndex(spark, root, fanout)
        index.version = version
        for r in sorted(spark.read.schema(MANIFEST).parquet(f"{root}/manifest-{version}").collect(), key=lambda r: r["path"]):
            while len(index.levels) <= r["level"]:
                index.levels.append([])
            index.levels[r["level"]].append(r["path"])
            index.runs = max(index.runs, int(r["path"].rpartition("-")[2]) + 1)
        return index

    def insert(self, batch: DataFrame) -> None:
        """Flush one memtable as a run of level 0, compact full levels, and write the manifest."""
        self._flush(0, batch.groupBy("digest").agg(F.min(F.struct("ident", "block", "row")).alias("best"), F.count(F.lit(1)).alias("records")))
        self.version += 1
        listed = [(k, path) for k, level in enumerate(self.levels) for path in level]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest-{self.version}")

    def _flush(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.root}/run-{self.runs:06d}"
        self.runs += 1
        rows.sortWithinPartitions("digest").write.parquet(path)
        bloom(self.run(path), key_of(F.col("digest"))).write.parquet(f"{path}.filter")
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._flush(level + 1, merged([self.run(p) for p in full]))

    def run(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(path)

    def filter(self, path: str) -> DataFrame:
        return self.spark.read.schema("filter_word long, filter_bits long").parquet(f"{path}.filter")

    def paths(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def compacted(self) -> DataFrame:
        """One run over all levels."""
        runs = [self.run(p) for p in self.paths()]
        if not runs:
            return self.spark.createDataFrame([], RUN)
        return runs[0] if len(runs) == 1 else stored(merged(runs), "compacted")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """What the index knows (RUN) of the distinct digests of ``keys``; of each run only keys that pass its filter are joined with it."""
        wanted = stored(keys.select("digest").distinct(), "keys")
        found = [self.run(p).join(passing(wanted, key_of(F.col("digest")), self.filter(p)), "digest", "left_semi") for p in self.paths()]
        return merged(found) if found else self.spark.createDataFrame([], RUN)


def merged(runs: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, runs)
    return rows.groupBy("digest").agg(F.min("best").alias("best"), F.sum("records").alias("records"))


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _ident(keep: str) -> Column:
    return F.coalesce(F.bitwise_not(F.col("doc_id")) if keep == "largest" else F.col("doc_id"), F.lit(NONE))


def _with_digest(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(block, row, doc_id, norm, digest) of rows (block, row, doc_id, text)."""
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return rows.select("block", "row", F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))


def labelled(rows: DataFrame, keep: str = "largest", memtable: int | None = None, fanout: int = 4, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Of rows (block, row, doc_id, text): block, row, doc_id, digest, best, records, kept. ``memtable``: rows of one."""
    spark = rows.sparkSession
    texts = _with_digest(rows, digest)
    total = rows.count()
    memtables = max(1, -(-total // (memtable or MEMTABLE * shuffle_partitions(spark))))
    path = shared_dir(spark, "digests")
    slim = texts.select("block", "row", "doc_id", "digest", _ident(keep).alias("ident"), F.pmod(F.xxhash64("block", "row"), F.lit(memtables)).cast("int").alias("memtable"))
    slim.write.partitionBy("memtable").parquet(path)
    slim = spark.read.schema(slim.schema).parquet(path)

    index = LsmIndex(spark, fanout=fanout)
    for k in range(memtables):  # a folder each
        index.insert(slim.where(F.col("memtable") == k))
    found = index.compacted()

    columns = ["block", "row", "doc_id", "digest", "best", "records"]
    out = by_key(slim.select("block", "row", "doc_id", "digest"), found, "digest", total).select(columns)

    by_text = _regrouped(texts, found, keep)
    if by_text is not None:
        out = out.join(by_text, ["block", "row"], "left").withColumn("best", F.coalesce("own_best", "best")).withColumn("records", F.coalesce("own_records", "records")).select(columns)
    return out.withColumn("kept", (F.col("block") == F.col("best.block")) & (F.col("row") == F.col("best.row")))


def _regrouped(texts: DataFrame, found: DataFrame, keep: str) -> DataFrame | None:
    """Byte verification: the texts of a shared digest are grouped by their bytes, and each digest must have one group.

    Where it has more, its rows are grouped again by text: (block, row, own_best,
    own_records). None if no texts differ.
    """
    shared = bloom(found.where("records > 1"), key_of(F.col("digest")))
    groups = passing(texts.select("digest", "norm"), key_of(F.col("digest")), shared).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    differ = stored(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "differing")
    if differ.isEmpty():
        return None
    again = texts.join(differ, "digest", "left_semi").select("block", "row", "digest", "norm", _ident(keep).alias("ident"))
    best = again.groupBy("digest", "norm").agg(F.min(F.struct("ident", "block", "row")).alias("own_best"), F.count(F.lit(1)).alias("own_records"))
    return again.join(best, ["digest", "norm"]).select("block", "row", "own_best", "own_records")


def dedup(docs: DataFrame, keep: str = "largest", memtable: int | None = None, fanout: int = 4, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts of any length are equal when identical after lower-casing A-Z. Null text
    counts as empty. Of rows that repeat both doc_id and text exactly one is kept.
    A null doc_id loses against any other; if all are null, keep_id is null. An
    empty table gives an empty result; other columns are ignored, whatever their
    names. ``digest`` maps the normalised text to the binary key of the index;
    right results don't depend on it. ``memtable`` is its number of rows.
    """
    rows = placed(docs.select("doc_id", "text")).select("block", "row", F.col("in_0").alias("doc_id"), F.col("in_1").alias("text"))
    best = F.col("best.ident")
    return labelled(rows, keep, memtable, fanout, digest).select(
        "doc_id",
        F.when(best != F.lit(NONE), F.bitwise_not(best) if keep == "largest" else best).alias("keep_id"),
        F.col("records").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows that ``dedup`` keeps, with all their columns, whatever their names; nulls, empty tables and repeated rows as there.

    Rows that pass a filter of the dropped places are held against them one by
    one; all others stay where they are.
    """
    rows = placed(docs)
    doc_id, text = (F.col(f"in_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    found = labelled(rows.select("block", "row", doc_id.alias("doc_id"), text.alias("text")), keep)
    dropped = stored(found.where(~F.col("kept")).select("block", "row"), "dropped")
    place = F.xxhash64("block", "row")
    told = tested(rows, place, bloom(dropped, place))
    sure, rest = told.where(~F.col("filter_hit")), told.where("filter_hit")
    stays = rest.join(dropped.hint("merge"), ["block", "row"], "left_anti")
    columns = [f"in_{k}" for k in range(len(docs.columns))]
    return sure.select(columns).union(stays.select(columns)).toDF(*docs.columns)


def new_texts(index: LsmIndex, docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of a further batch (doc_id, text) whose text no earlier batch of ``index`` has; the batch is inserted.

    Of equal texts within the batch one stays, as in ``dedup``. The index tells by
    digest; columns, nulls and empty tables as in ``keep_one``.
    """
    rows = placed(docs)
    doc_id, text = (F.col(f"in_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    texts = _with_digest(rows.select("block", "row", doc_id.alias("doc_id"), text.alias("text")), sha256)
    batch = stored(texts.select("block", "row", "digest", _ident(keep).alias("ident")), "batch")
    known = stored(index.look_up(batch).select("digest"), "known")
    index.insert(batch)
    first = batch.groupBy("digest").agg(F.min(F.struct("ident", "block", "row")).alias("best")).join(known.hint("merge"), "digest", "left_anti")
    kept = first.select("best.block", "best.row")
    columns = [f"in_{k}" for k in range(len(docs.columns))]
    return rows.join(kept.hint("merge"), ["block", "row"], "left_semi").select(columns).toDF(*docs.columns)
