"""Shortest-pack-first histogram packing.

1. Documents are encoded, an end id is appended, and they are cut into pieces of
   at most ``width`` ids. Pieces (not ids) go to the shared folder.
2. The histogram of piece lengths has at most ``width`` rows, whatever the input.
   Lengths are placed longest first, each into the shortest open packs that have
   room for it, as many packs at a time as there are pieces or packs of that kind.
   The outcome is a list of patterns (lengths in a pack) with counts.
3. Pieces are range-sorted by length; the rank of a piece says which slot of
   which pattern it fills, and so its sequence and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphline.llm.common import documents, shuffle_partitions, stored
from graphline.llm.encode import encoder, text_batches, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, width: int, batch_chars: int = 4 << 20) -> DataFrame:
    """Pieces of all documents: PIECES."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder("word", vocabulary)
        for batch in parts:
            texts, key = batch.column(1).to_pylist(), batch.column(0)
            for a, b in text_batches(texts, batch_chars):
                ids, sizes = codes.encode(texts[a:b])
                data = memoryview(np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")).cast("B")
                tokens = sizes + 1
                count = -(-tokens // width)
                doc = np.repeat(np.arange(b - a), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * width
                length = np.minimum(width, tokens[doc] - start)
                at = (np.cumsum(tokens) - tokens)[doc] + start
                crc = [zlib.crc32(data[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc])], names)

    rows = documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (packs, [(length, times), ...]), lengths descending within a pattern."""
    open_packs: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(width + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], width
        while left:
            while room >= length and not open_packs[room]:
                room -= 1
            if room < length:
                open_packs[width - length].append((left, [(length, 1)]))
                break
            packs, pattern = open_packs[room].pop()
            filled = min(left, packs)
            if packs > filled:
                open_packs[room].append((packs - filled, pattern))
            last = pattern[-1]
            grown = [*pattern[:-1], (length, last[1] + 1)] if last[0] == length else [*pattern, (length, 1)]
            open_packs[room - length].append((filled, grown))
            left -= filled
    return [p for packs in open_packs for p in packs]


class Slots:
    """Where the piece of a rank goes; ranks run over all pieces by ascending length."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        rows, base = [], 0
        for packs, pattern in patterns:
            offset = 0
            for length, times in pattern:
                rows.append((length, base, packs, times, offset))
                offset += length * times
            base += packs
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.base, packs, self.times, self.offset = table.T
        slots = packs * self.times
        self.first = np.cumsum(slots) - slots

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each rank."""
        row = np.searchsorted(self.first, rank, "right") - 1
        pack, nth = np.divmod(rank - self.first[row], self.times[row])
        return self.base[row] + pack, self.offset[row] + nth * self.length[row]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, width: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every sequence is padded to ``width``. Null text counts as empty and gives a
    piece of the end id alone; repeated rows are packed one by one; a null doc_id
    sorts first; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    found = stored(pieces(docs, vocabulary, end_id, width), "pieces")
    # at most ``width`` rows
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = Slots(shortest_pack_first(histogram, width))

    order = ["length", "doc_id", "start", "ids_crc32"]
    ranked = found.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId()
        for batch in parts:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))], [*batch.schema.names, "part", "nth"])
            done += n

    ranked = stored(ranked.mapInArrow(tidy(number), PIECES + ", part int, nth long"), "ranked")
    # one row per shuffle partition
    parts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.place(rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    return ranked.join(F.broadcast(base), "part").withColumn("at", placed(F.col("base") + F.col("nth"))).select(*[f.split()[0] for f in PIECES.split(", ")], "at.sequence_id", "at.offset")
