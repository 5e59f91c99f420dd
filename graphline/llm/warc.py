"""WARC archives with a two-level capture index.

Archives: one gzip member per record, files in the shared folder, one per writing
task. Every attempt of a task writes a file of its own; only those named in the
capture table (written by Spark, so committed once) count.

Index: captures sorted by reversed-host URL key and page_id in range partitions.
Each partition is one file of compressed blocks of sorted lines, followed by its
block directory (first line of each block, offset, length) and a trailer. The
upper level, one row per index file, has the first line of each. A look-up
bisects the upper level, the directory of that file, and the lines of one block,
which are the only bytes of the index that it reads; then it reads the byte range
of the record from the archive.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphline.llm.blocks import Side, runs
from graphline.llm.common import by_key, shared_dir, shuffle_partitions, stored, uri
from graphline.llm.places import placed

LEAST_BYTES = 100
#: Sorts a null page_id first.
NULL_ID = -(2**63)
CAPTURES = "key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2000-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.a.example.com/x?y becomes ``com,example,a)/x?y``; no URL gives ``)``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = re.sub(r"^www\d*\.", "", parts.hostname or ""), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url or "")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or ("/" if host else "")) + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", key)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    told = urn.strip("<>").rpartition(":")[2]
    return None if told == "null" else int(told)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = re.sub(r"\s", "%20", url or "") or "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, root: str) -> DataFrame:
    """Write archives under ``root``; the capture table (CAPTURES).

    Of records with equal payloads of at least LEAST_BYTES bytes that with the
    smallest page_id is the response (all rows that repeat it are), the others
    are revisits of it; a null page_id is a revisit of any other. Null html is an
    empty payload, a null URL has the key ``)``, and a page of any length is one
    record. An empty table writes nothing; other columns are ignored. Which
    records are revisits is decided on digests alone, so pages aren't shuffled.
    """
    html = F.coalesce(F.col("in_2"), F.lit(""))
    rows = placed(pages.select(F.col("page_id").cast("long"), "url", "html"))
    rows = rows.select("block", "row", F.col("in_0").alias("page_id"), F.col("in_1").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    slim = stored(rows.where(F.octet_length("html") >= LEAST_BYTES).select("block", "row", "page_id", "digest"), "digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("records")).where("records > 1")
    again = by_key(slim, stored(first, "first"), "digest", slim.count()).where(F.col("first").isNotNull()).select("block", "row", "first")
    side = Side.write(again, "revisits", "row")

    def save(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        path, out, at = "", None, 0
        reader, last, firsts = side.reader(), None, {}
        for block, batch in (x for whole in parts for x in runs(whole, 0)):
            if block != last:
                held = [b.to_pydict() for b in reader.batches(block, "row", "first")]
                last, firsts = block, {k: v for h in held for k, v in zip(h["row"], h["first"], strict=True)}
            if out is None:
                store.create_dir(f"{top}/archives")
                path = f"archives/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{top}/{path}", compression=None)
            found = []
            for _, row, page_id, url, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = firsts.get(row)
                kind = "revisit" if one is not None and page_id != one else "response"
                data = _gzip(record(page_id, url, text.encode(), digest, kind, one))
                out.write(data)
                found.append({"key": url_key(url), "page_id": NULL_ID if page_id is None else page_id, "file": path, "offset": at, "length": len(data)})
                at += len(data)
            yield pa.RecordBatch.from_pylist(found, CAPTURE_SCHEMA)
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(save, CAPTURES), "captures")


CAPTURE_SCHEMA = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def build_index(captures: DataFrame, root: str, block_lines: int = 1000) -> list[dict]:
    """Write the index files; the upper level: file, first key, first page_id, in order. One entry per shuffle partition."""
    spark = captures.sparkSession
    rows = captures.repartitionByRange(shuffle_partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def save(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        out, path, at, held, directory = None, "", 0, [], []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join("\t".join(map(str, r)) for r in held).encode())
            out.write(data)
            directory.append([held[0][0], held[0][1], at, len(data)])
            at += len(data)
            held.clear()

        for batch in parts:
            if out is None:
                store.create_dir(f"{top}/index")
                path = f"index/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx"
                out = store.open_output_stream(f"{top}/{path}", compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == block_lines:
                    flush()
        if out is not None:
            if held:
                flush()
            told = zlib.compress(json.dumps(directory).encode())
            out.write(told + struct.pack("<QQ", at, len(told)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": path, "key": directory[0][0], "page_id": directory[0][1]}], pa.schema([("file", pa.string()), ("key", pa.string()), ("page_id", pa.int64())]))

    upper = stored(rows.mapInArrow(save, "file string, key string, page_id long"), "index")
    return sorted((r.asDict() for r in upper.collect()), key=lambda r: (r["key"], r["page_id"], r["file"]))


class Index:
    """Look-ups; keeps the directories of files and the blocks that it read last."""

    def __init__(self, root: str, upper: list[dict]):
        self.store, self.top = fs.FileSystem.from_uri(root)
        self.files = [r["file"] for r in upper]
        self.firsts = [(r["key"], r["page_id"]) for r in upper]
        self.directory = lru_cache(64)(self._directory)
        self.block = lru_cache(64)(self._block)

    def _range(self, path: str, offset: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.top}/{path}") as file:
            return file.read_at(length, offset)

    def _directory(self, n: int) -> list:
        with self.store.open_input_file(f"{self.top}/{self.files[n]}") as file:
            at, length = struct.unpack("<QQ", file.read_at(16, file.size() - 16))
            return json.loads(zlib.decompress(file.read_at(length, at)))

    def _block(self, n: int, b: int) -> list[tuple[str, int, str, int, int]]:
        _, _, offset, length = self.directory(n)[b]
        lines = zlib.decompress(self._range(self.files[n], offset, length)).decode().split("\n")
        return [(k, int(p), f, int(o), int(s)) for k, p, f, o, s in (line.split("\t") for line in lines)]

    def find(self, key: str, page_id: int) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of this key and page; they may go on over blocks and files."""
        want, found = (key, page_id), []
        n = max(0, bisect_right(self.firsts, want) - 1)
        while n > 0 and self.firsts[n] == want:  # the same capture may end the file before
            n -= 1
        for n in range(n, len(self.files)):
            if self.firsts[n] > want:
                break
            directory = self.directory(n)
            b = max(0, bisect_right(directory, want, key=lambda d: (d[0], d[1])) - 1)
            while b > 0 and (directory[b][0], directory[b][1]) == want:
                b -= 1
            for b in range(b, len(directory)):
                if (directory[b][0], directory[b][1]) > want:
                    break
                lines = self.block(n, b)
                at = bisect_right(lines, (key, page_id, "", -1, -1))
                while at < len(lines) and lines[at][:2] == want:
                    found.append(lines[at][2:])
                    at += 1
        return found


def look_up(wanted: DataFrame, root: str, upper: list[dict]) -> DataFrame:
    """Captures of distinct (url, page_id): file, offset, length. Sorted by key first, so a block is read about once."""

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["key", "page_id"])

    rows = wanted.select("url", F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_id")).mapInArrow(keys, "key string, page_id long").distinct()
    rows = rows.repartitionByRange(shuffle_partitions(wanted.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(root, upper)
        for batch in parts:
            found = [hit for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.find(k, p)]
            yield pa.RecordBatch.from_pylist([{"file": f, "offset": o, "length": n} for f, o, n in found], CAPTURE_SCHEMA.remove(0).remove(0))

    return rows.mapInArrow(search, "file string, offset long, length long")


def read(ranges: DataFrame, root: str) -> DataFrame:
    """Records of byte ranges (RECORDS). The payload of a response is held against its digest."""
    rows = ranges.repartitionByRange(shuffle_partitions(ranges.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def load(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        name, file = None, None
        for batch in parts:
            found = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    name, file = path, store.open_input_file(f"{top}/{path}")
                fields, http, payload = parse(zlib.decompress(file.read_at(length, offset), 31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path} at {offset}: the payload doesn't match its digest")
                refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                found.append({"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers})
            yield pa.RecordBatch.from_pylist(found, RECORD_SCHEMA)

    return rows.mapInArrow(load, RECORDS)


RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, index them, find each by URL and page, and read it back: RECORDS.

    One row per page; an empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    root = uri(shared_dir(spark, "warc"))
    upper = build_index(write(pages, root), root)
    return read(look_up(pages, root, upper), root)
