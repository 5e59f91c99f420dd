"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k holds chunk k of
every id that has one, and a bitmap that says which of them continue on level
k+1. A directory of ranks (set bits before each block of 512) turns a position
on one level into that on the next, so any token is read with at most one
directory look-up and one partial bit count per level; no block is decoded.

Segment layout, little-endian: b"DAC1", uint32 levels, uint64 ids, uint64 entries
of each level; then per level the chunks (1 byte each), and unless it is the last
level the bitmap (padded to 64 bytes) and the rank directory (uint64 per block).
A run of ids is one run of each level, so a slice is read by few ranges.

The store is a folder of plain files, in ascending doc_id order over all of them.
A file has segments, each followed by its documents (uint64 number, doc_ids as
int64, a bitmap of null ids, uint64 first positions), then a directory of its
segments and a trailer (uint64 offset and length of the directory). A table that
Spark commits names the files that count; its first row of each file is the upper
directory. So a token is found by its position, or by doc_id and place, with two
binary searches and reads of the bytes that it needs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphline.llm.common import documents, shared_dir, shuffle_partitions, uri
from graphline.llm.encode import encoder, text_batches

MAGIC, BLOCK = b"DAC1", 512
SEGMENTS = "part int, segment int, file string, offset long, documents long, docs long, tokens long, first long"
#: Stands for a null doc_id, which comes first, in directories.
NULL_ID = -(2**63)


def dac_encode(ids: np.ndarray) -> bytes:
    """A segment for unsigned ids below 2**32."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        chunks, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        last = not more.any()
        levels.append((chunks, None if last else more))
        if last:
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<IQ", len(levels), len(levels[0][0])), struct.pack(f"<{len(levels)}Q", *(len(chunks) for chunks, _ in levels))]
    for chunks, more in levels:
        out.append(chunks.tobytes())
        if more is not None:
            blocks = -(-len(more) // BLOCK)
            bits = np.zeros(blocks * BLOCK, bool)
            bits[: len(more)] = more
            counts = bits.reshape(blocks, BLOCK).sum(1)
            out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u8").tobytes()]
    return b"".join(out)


class DacSegment:
    """Random access to the ids of one segment, from its bytes or through ``read(offset, length)``."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.read = data if callable(data) else lambda at, n: data[at : at + n]
        head = self.read(0, 16)
        if head[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        count, self.n = struct.unpack("<IQ", head[4:])
        at, self.levels = 16 + 8 * count, []
        for k, entries in enumerate(struct.unpack(f"<{count}Q", self.read(16, 8 * count))):
            blocks = -(-entries // BLOCK)
            bitmap = at + entries
            ranks = bitmap + blocks * BLOCK // 8
            last = k == count - 1
            self.levels.append((at, None if last else bitmap, None if last else ranks))
            at = bitmap if last else ranks + 8 * blocks

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``, as uint32; on each level their chunks are one run."""
        start, end = max(0, start), min(end, self.n)
        out = np.zeros(max(0, end - start), np.uint32)
        at, low, high = np.arange(len(out)), start, end
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            if high <= low:
                break
            out[at] |= np.frombuffer(self.read(chunks + low, high - low), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            if bitmap is None:
                break
            block = low // BLOCK
            held = -(-high // BLOCK) - block
            bits = np.unpackbits(np.frombuffer(self.read(bitmap + block * BLOCK // 8, held * BLOCK // 8), np.uint8), bitorder="little")
            (rank,) = struct.unpack("<Q", self.read(ranks + 8 * block, 8))
            on = np.flatnonzero(bits[low - block * BLOCK : high - block * BLOCK])
            at, low = at[on], rank + int(bits[: low - block * BLOCK].sum())
            high = low + len(on)
        return out

    def all(self) -> np.ndarray:
        """Every id, as uint32."""
        return self.slice(0, self.n)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, segment_tokens: int = 1 << 20, batch_chars: int = 4 << 20) -> None:
    """Encode every whole text, however long, append ``end_id``, and write segments in ascending doc_id order.

    Null text counts as empty (the end id alone); null doc_id comes first; rows
    that repeat a doc_id are ordered by a hash of the text; an empty table writes
    no segment. A segment holds about ``segment_tokens`` ids and whole documents.
    """
    rows = documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    names = [f.split()[0] for f in SEGMENTS.split(", ")]

    def segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder("byte", vocabulary)
        store, top = fs.FileSystem.from_uri(uri(path))
        part, out, file, at, directory = TaskContext.get().partitionId(), None, "", 0, []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, file, at, held
            if out is None:  # every attempt of a task has a file of its own
                store.create_dir(f"{top}/files")
                file = f"files/{part:06d}-{uuid.uuid4().hex}.dac"
                out = store.open_output_stream(f"{top}/{file}", compression=None)
            flat, size, key = np.concatenate(ids), np.concatenate(lengths), pa.concat_arrays(keys)
            null = np.asarray(key.is_null())
            data = dac_encode(flat)
            known = key.fill_null(NULL_ID).to_numpy()
            table = struct.pack("<Q", len(size)) + known.astype("<i8").tobytes() + np.packbits(null, bitorder="little").tobytes() + (np.cumsum(size) - size).astype("<u8").tobytes()
            out.write(data)
            out.write(table)
            row = [part, len(directory), file, at, at + len(data), len(size), len(flat), int(known[0])]
            directory.append(row[3:])
            at += len(data) + len(table)
            held = 0
            for x in (ids, lengths, keys):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES, strict=True)], names)

        for batch in parts:
            texts, key = batch.column(1).to_pylist(), batch.column(0)
            for a, b in text_batches(texts, batch_chars):
                flat, size = codes.encode(texts[a:b])
                ids.append(np.insert(flat, np.cumsum(size), end_id))
                lengths.append(size + 1)
                keys.append(key.slice(a, b - a))
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            told = json.dumps(directory).encode()
            out.write(told + struct.pack("<QQ", at, len(told)))
            out.close()

    rows.mapInArrow(segments, SEGMENTS).write.parquet(f"{path}/segments")


TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def segment_table(spark: SparkSession, path: str) -> DataFrame:
    """SEGMENTS with ``base``: the ids of all segments before."""
    store = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    parts = store.groupBy("part").agg(F.sum("tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return store.join(parts, "part").select(*store.columns, (F.col("of_part") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base"))


def _documents(read: Callable[[int, int], bytes], at: int) -> tuple[int, int, int, int]:
    """Of a table of documents: their number, and where ids, nulls and positions begin."""
    (n,) = struct.unpack("<Q", read(at, 8))
    return n, at + 8, at + 8 + 8 * n, at + 8 + 8 * n + -(-n // 8)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def rows(segments: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(uri(path))
        for batch in segments:
            for row in batch.to_pylist():
                with store.open_input_file(f"{top}/{row['file']}") as file:
                    get = lambda at, n: file.read_at(n, at)  # noqa: B023, E731
                    segment = DacSegment(lambda at, n: get(row["offset"] + at, n))  # noqa: B023
                    n, ids, nulls, first = _documents(get, row["documents"])
                    starts = np.frombuffer(get(first, 8 * n), "<u8").astype(np.int64)
                    null = np.unpackbits(np.frombuffer(get(nulls, -(-n // 8)), np.uint8), bitorder="little")[:n].astype(bool)
                    known = pa.array(np.frombuffer(get(ids, 8 * n), "<i8"), mask=null)
                    data = memoryview(segment.all().astype("<u4")).cast("B")
                ends = np.append(starts[1:], len(segment))
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([known, pa.array(row["base"] + starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = segment_table(spark, path).select("file", "offset", "documents", "base")
    return table.repartition(shuffle_partitions(spark), "file", "offset").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenStore:
    """Tokens of a store by position or document; reads directories once and of segments only the bytes needed."""

    def __init__(self, path: str, upper: list[tuple[int, int, str]]):
        """``upper``: of each file the first position, the first doc_id and the name, in order."""
        self.store, self.top = fs.FileSystem.from_uri(uri(path))
        self.bases, self.firsts, self.files = ([u[k] for u in upper] for k in range(3))
        self.bytes_read = 0
        self._directory = lru_cache(64)(self._read_directory)

    @staticmethod
    def open(spark: SparkSession, path: str) -> TokenStore:
        """One row for each file reaches the driver."""
        first = segment_table(spark, path).where("segment = 0").select("base", "first", "file")
        return TokenStore(path, sorted((r["base"], r["first"], r["file"]) for r in first.collect()))

    def _read(self, n: int, at: int, length: int) -> bytes:
        self.bytes_read += length
        with self.store.open_input_file(f"{self.top}/{self.files[n]}") as file:
            return file.read_at(length, at)

    def _read_directory(self, n: int) -> list[list[int]]:
        """Of each segment of a file: offset, documents, docs, tokens, first doc_id, and the ids before it in the file."""
        with self.store.open_input_file(f"{self.top}/{self.files[n]}") as file:
            size = file.size()
        at, length = struct.unpack("<QQ", self._read(n, size - 16, 16))
        rows = json.loads(self._read(n, at, length))
        before = np.cumsum([0, *(r[3] for r in rows)]).tolist()
        return [[*r, b] for r, b in zip(rows, before, strict=False)]

    def _segment(self, n: int, offset: int) -> DacSegment:
        return DacSegment(lambda at, length: self._read(n, offset + at, length))

    def token_at(self, position: int) -> int:
        """The id at a position counted over all documents."""
        n = bisect_right(self.bases, position) - 1
        if n < 0:
            raise IndexError(position)
        directory = self._directory(n)
        row = directory[bisect_right(directory, position - self.bases[n], key=lambda r: r[5]) - 1]
        return self._segment(n, row[0])[position - self.bases[n] - row[5]]

    def tokens(self, doc_id: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``start`` to before ``end`` of a document; of rows that repeat its doc_id the first."""
        n = max(0, bisect_left(self.firsts, doc_id) - 1)
        for n in range(n, len(self.files)):  # it may begin in the next file
            if self.firsts[n] > doc_id:
                break
            directory = self._directory(n)
            for s in range(max(0, bisect_left(directory, doc_id, key=lambda r: r[4]) - 1), len(directory)):
                offset, table, docs, tokens, first, _ = directory[s]
                if first > doc_id:
                    break
                _, ids, _, starts = _documents(lambda at, length: self._read(n, at, length), table)  # noqa: B023
                k = bisect_left(range(docs), doc_id, key=lambda i: struct.unpack("<q", self._read(n, ids + 8 * i, 8))[0])  # noqa: B023
                if k < docs and struct.unpack("<q", self._read(n, ids + 8 * k, 8))[0] == doc_id:
                    (low,) = struct.unpack("<Q", self._read(n, starts + 8 * k, 8))
                    high = tokens if k == docs - 1 else struct.unpack("<Q", self._read(n, starts + 8 * (k + 1), 8))[0]
                    return self._segment(n, offset).slice(low + max(0, start), high if end is None else min(high, low + end))
        raise KeyError(doc_id)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the store to the shared folder and read it back; nulls, empty tables and repeated rows as in ``write``, other columns ignored."""
    path = shared_dir(docs.sparkSession, "tokens")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)
