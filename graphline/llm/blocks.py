"""Rows by their place in files, so that what is decided on slim tables finds its rows again without moving texts.

A block is a run of rows of one file (see places.py). A side table holds rows for blocks, as
sorted files in the shared folder; a task that scans the texts of a block reads
the rows of that block from it. So a decision or a model for the texts of a block
is joined by a range read instead of a shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.common import shared_dir, shuffle_partitions, uri
from graphline.llm.encode import tidy

#: Rows that are copied at once.
SLICE = 1024


@dataclass
class Side:
    """A side table: rows with a column ``block``, in ``shards`` groups of files, each sorted by block."""

    root: str
    shards: int

    @staticmethod
    def write(rows: DataFrame, name: str, *order: str) -> Side:
        spark = rows.sparkSession
        side = Side(uri(shared_dir(spark, name)), shuffle_partitions(spark))
        rows = rows.withColumn("shard", F.pmod(F.col("block"), F.lit(side.shards)).cast("int"))
        rows = rows.repartition(side.shards, "shard").sortWithinPartitions("shard", "block", *order)
        rows.write.option("parquet.block.size", str(4 << 20)).partitionBy("shard").parquet(side.root)
        return side

    def reader(self) -> SideReader:
        return SideReader(self)


class SideReader:
    """Reads blocks of a side table in a task; row groups of other blocks are skipped by their statistics."""

    def __init__(self, side: Side):
        self.side = side
        self.store, self.top = fs.FileSystem.from_uri(side.root)
        self.files: dict[int, list[str]] = {}

    def batches(self, block: int, *columns: str) -> Iterator[pa.RecordBatch]:
        """The rows of a block in order, in parts of bounded size."""
        shard = block % self.side.shards
        if shard not in self.files:
            found = self.store.get_file_info(fs.FileSelector(f"{self.top}/shard={shard}", allow_not_found=True))
            self.files[shard] = sorted(f.path for f in found if f.path.endswith(".parquet"))
        if self.files[shard]:
            table = ds.dataset(self.files[shard], filesystem=self.store, format="parquet")
            yield from table.to_batches(columns=list(columns), filter=ds.field("block") == block, use_threads=False, batch_readahead=1, fragment_readahead=1)

    def column(self, block: int, name: str) -> np.ndarray:
        """One column of a block; for tables of at most one row for each row of the block."""
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in self.batches(block, name)]
        return np.concatenate([np.empty(0, np.int64), *parts])


def runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) of consecutive rows of one block."""
    blocks = batch.column(column).to_numpy()
    if len(blocks):
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
            yield int(blocks[a]), batch.slice(a, b - a)


def keep(rows: DataFrame, docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of ``rows = placed(docs)`` those with a row in ``verdicts`` (block, row), under the names of ``docs``."""
    side = Side.write(verdicts.select("block", "row"), "verdicts", "row")
    columns = [f"in_{k}" for k in range(len(docs.columns))]
    at = [rows.columns.index(c) for c in columns]
    block, row = rows.columns.index("block"), rows.columns.index("row")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, good = side.reader(), None, np.empty(0, np.int64)
        for batch in parts:
            for one, part in runs(batch, block):
                if one != last:
                    last, good = one, reader.column(one, "row")
                for start in range(0, len(part), SLICE):
                    some = part.slice(start, SLICE)
                    kept = some.filter(pa.array(np.isin(some.column(row).to_numpy(), good)))
                    yield pa.RecordBatch.from_arrays([kept.column(k) for k in at], columns)

    found = rows.mapInArrow(tidy(run), rows.select(*columns).schema)
    return found.toDF(*docs.columns)
