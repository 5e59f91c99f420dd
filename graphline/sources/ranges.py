"""Graph documents cut into byte ranges, so that one document is read by many tasks.

A range can't tell by itself whether it begins within a string. So a first pass
counts the quotes and brackets of every range: the number of quotes before a range
says whether it begins within a string, and the brackets outside of strings how
deep. With both, a second pass finds the members of the root object that begin in
a range and the elements of their arrays; each element is read whole by the range
that its separator lies in, and numbered within the range. Counts by range then
give an element its place in the array.

Bytes are looked at with NumPy, ``part_bytes`` at a time; a task holds one range
and the element that leaves it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphline.plans.iterate import cut

PART_BYTES, MOST_TASKS = 32 << 20, 100_000
#: How far back the name of a member is looked for, and by how much a task reads on for an element that leaves its range.
NAME_BYTES, MORE_BYTES = 1 << 12, 1 << 16
NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*$', re.DOTALL)
QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'
OPEN, CLOSE = np.frombuffer(b"[{", np.uint8), np.frombuffer(b"]}", np.uint8)
#: What structure is made of.
MARKS = np.zeros(256, bool)
MARKS[list(b'"[]{},:')] = True

RANGES = "file int, path string, first long, last long, size long"


@dataclass
class Elements:
    """rows: (file, key, pos, value), an element of a root array as JSON text. heads: (file, path, stem, parsed, members), members by name, with the text of those that are no containers."""

    rows: DataFrame
    heads: DataFrame


def is_part(name: str) -> bool:
    """Whether a file of a folder is a part of the document that the folder is."""
    return name.startswith("part-")


class _Joined:
    """The part files of a folder, by name, as one file."""

    def __init__(self, store, parts: list):
        self.store, self.parts, self.at, self.held = store, parts, 0, (None, None)
        self.starts = np.cumsum([0, *(p.size for p in parts)])

    def __enter__(self) -> _Joined:
        return self

    def __exit__(self, *_) -> None:
        if self.held[1] is not None:
            self.held[1].close()

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, size: int) -> bytes:
        found = []
        while size > 0 and self.at < self.starts[-1]:
            k = int(np.searchsorted(self.starts, self.at, "right")) - 1
            if self.held[0] != k:
                self.__exit__()
                self.held = (k, self.store.open_input_file(self.parts[k].path))
            self.held[1].seek(self.at - int(self.starts[k]))
            data = self.held[1].read(min(size, int(self.starts[k + 1]) - self.at))
            found.append(data)
            self.at, size = self.at + len(data), size - len(data)
        return b"".join(found)


def _opened(path: str):
    """A file, or a folder of parts, of any store that Arrow reads, for random access."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri("file://" + quote(re.sub(r"^file:/+", "/", path)) if "://" not in path.replace("file://", "") else path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return store.open_input_file(inner)
    parts = [f for f in store.get_file_info(fs.FileSelector(inner)) if is_part(f.base_name) and f.size]
    return _Joined(store, sorted(parts, key=lambda f: f.base_name))


def _quotes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are quotes that no backslash escapes. ``data`` must not begin behind a backslash."""
    found = data[at] == QUOTE
    for k in np.flatnonzero(found & (at > 0) & (data[np.maximum(at, 1) - 1] == BACKSLASH)).tolist():
        run = at[k] - 1
        while run >= 0 and data[run] == BACKSLASH:
            run -= 1
        found[k] = (at[k] - 1 - run) % 2 == 0
    return found


def _start(file, first: int) -> int:
    """``first``, or the beginning of the backslashes that lie before it."""
    while first > 0:
        back = max(0, first - 64)
        file.seek(back)
        before = file.read(first - back)
        bare = before.rstrip(b"\\")
        if bare:
            return back + len(bare)
        first = back
    return first


def _bounds(file, first: int, last: int, size: int) -> tuple[int, int]:
    """The range from ``first`` to ``last`` with both ends moved before backslashes, alike for neighbours."""
    return _start(file, first), (_start(file, last) if last < size else size)


def _marks(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the marks outside of strings, quotes left out; the depth behind each, from 0; and the number of quotes."""
    at = np.flatnonzero(MARKS[data])
    quote = _quotes(data, at)
    within = (np.cumsum(quote) - quote + inside) % 2 == 1
    at = at[~quote & ~within & (data[at] != QUOTE)]
    kind = data[at]
    depth = np.cumsum(np.isin(kind, OPEN).astype(np.int64) - np.isin(kind, CLOSE))
    return at, depth, int(quote.sum())


def _read(file, first: int, last: int) -> bytes:
    file.seek(first)
    return file.read(last - first)


def _summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quotes of each range, and the brackets that it opens for good, if it begins outside (out) or within a string (within)."""
    for part in parts:
        for row in part.itertuples():
            with _opened(row.path) as file:
                data = np.frombuffer(_read(file, *_bounds(file, row.first, row.last, row.size)), np.uint8)
            (_, out, quotes), (_, within, _) = _marks(data, False), _marks(data, True)
            yield pd.DataFrame([(row.file, row.first, quotes, int(out[-1]) if len(out) else 0, int(within[-1]) if len(within) else 0)], columns=["file", "first", "quotes", "out", "within"])


FOUND = "file int, first long, section int, at int, opener string, key string, value string"


def _separated(file, data: bytes, end: int, size: int, start: int) -> bytes:
    """The text from ``start`` of a value up to its separator, reading on behind ``end`` as far as it takes."""
    step = MORE_BYTES
    while True:
        at, deep, _ = _marks(np.frombuffer(data, np.uint8)[start:], False)
        kind = np.frombuffer(data, np.uint8)[start:][at]
        stop = np.flatnonzero(((kind == COMMA) & (deep == 0)) | (deep < 0))
        if len(stop):
            return data[start : start + int(at[stop[0]])]
        if end >= size:
            return data[start:]
        more = min(size, end + step)
        data, end, step = data + _read(file, end, more), more, step * 2


def _found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members (at -1) and elements that begin in each range. Sections are what lies between two members; section 0 goes on from the range before."""
    for part in parts:
        for row in part.itertuples():
            rows = []
            with _opened(row.path) as file:
                first, last = _bounds(file, row.first, row.last, row.size)
                data = _read(file, first, last)
                array = np.frombuffer(data, np.uint8)
                at, depth, _ = _marks(array, bool(row.inside))
                kind, depth = array[at], depth + row.depth
                before = depth - np.isin(kind, OPEN) + np.isin(kind, CLOSE)
                member = (kind == COLON) & (depth == 1)
                starts = (np.isin(kind, OPEN) & (depth == 2)) | ((kind == COMMA) & (depth == 2))
                stops = ((kind == COMMA) & (depth == 2)) | (np.isin(kind, CLOSE) & (before == 2))
                stop_at = at[stops]
                section, nth = 0, 0
                for k in np.flatnonzero(member | starts).tolist():
                    place = int(at[k])
                    if member[k]:
                        section, nth = section + 1, 0
                        back = max(0, first + place - NAME_BYTES)
                        name = NAME.search(_read(file, back, first) + data[:place] if back < first else data[back - first : place])
                        text = _scalar(file, data, last, row.size, place + 1)
                        rows.append((row.file, row.first, section, -1, None, _string(name[1]) if name else None, text))
                        continue
                    nxt = int(np.searchsorted(stop_at, place, "right"))
                    text = data[place + 1 : int(stop_at[nxt])] if nxt < len(stop_at) else _separated(file, data, last, row.size, place + 1)
                    opener = chr(kind[k]) if kind[k] != COMMA else None
                    text = text.strip()
                    if text or opener:
                        rows.append((row.file, row.first, section, nth if text else -2, opener, None, text.decode("utf-8", "replace") if text else None))
                    nth += bool(text)
            for a in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[a : a + 10_000], columns=[c.split(" ")[0] for c in FOUND.split(", ")])


def _string(raw: bytes) -> str:
    import json

    return json.loads(b'"' + raw + b'"')


def _scalar(file, data: bytes, end: int, size: int, start: int) -> str | None:
    """The text of a member's value, or null where it is a container."""
    held = data[start : start + MORE_BYTES]
    far = end
    while not held.strip() and far < size:  # blanks up to the end of the range
        more = min(size, far + MORE_BYTES)
        held, far = held + _read(file, far, more), more
    if held.strip()[:1] in (b"[", b"{", b""):
        return None
    return _separated(file, data, end, size, start).strip().decode("utf-8", "replace")


def size_of(hadoop, conf, path: str) -> int:
    """Bytes of a file, or of the parts in a folder."""
    at = hadoop.Path(path)
    store = at.getFileSystem(conf)
    status = store.getFileStatus(at)
    return sum(f.getLen() for f in store.listStatus(at) if is_part(f.getPath().getName())) if status.isDirectory() else status.getLen()


def ranges(spark: SparkSession, files: Sequence[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """(RANGES) Byte ranges of the files, numbered in the order given. The driver holds a file's path and size, executors make the ranges."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    sizes = []
    for k, path in enumerate(files):
        sizes.append((k, path, size_of(hadoop, conf, path)))
    listed = spark.createDataFrame(sizes, "file int, path string, size long")
    each = listed.select("file", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(part_bytes).cast("long"))).alias("first"))
    return each.select("file", "path", "first", F.least(F.col("first") + part_bytes, F.col("size")).alias("last"), "size")


def _started(told: DataFrame) -> DataFrame:
    """(file, first, inside, depth): how each range begins, from the summaries of those before it."""
    earlier = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    quotes = told.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    opened = quotes.withColumn("opened", F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("out")))
    return opened.withColumn("depth", F.coalesce(F.sum("opened").over(earlier), F.lit(0)))


def elements(spark: SparkSession, files: Sequence[str], keys: Sequence[str], part_bytes: int = PART_BYTES) -> Elements:
    """The elements of the root arrays ``keys`` of JSON documents, each document in as many ranges as it has ``part_bytes``.

    A document whose brackets or quotes don't close, or which is no object, counts as not parsed.
    """
    cuts = cut(ranges(spark, files, part_bytes))
    tasks = min(cuts.count(), MOST_TASKS)
    by_range: Callable[[DataFrame], DataFrame] = lambda df: df.repartition(max(1, tasks), "file", "first")
    told = cut(by_range(cuts).mapInPandas(_summaries, "file int, first long, quotes long, out long, within long"))
    begun = cut(_started(told))
    given = cuts.join(begun.select("file", "first", "inside", "depth"), ["file", "first"])
    found = cut(by_range(given).mapInPandas(_found, FOUND))

    # one row for each section of a range
    sections = found.groupBy("file", "first", "section").agg(F.max("key").alias("key"), F.max("opener").alias("opener"), F.count(F.when(F.col("at") >= 0, 1)).alias("n"))
    in_order = Window.partitionBy("file").orderBy("first", "section").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("section") > 0
    sections = sections.withColumn("member", F.sum(begins.cast("int")).over(in_order)).withColumn("key", F.last(F.when(begins, F.col("key")), ignorenulls=True).over(in_order))
    of_member = Window.partitionBy("file", "member").orderBy("first", "section").rowsBetween(Window.unboundedPreceding, -1)
    sections = sections.withColumn("base", F.coalesce(F.sum("n").over(of_member), F.lit(0))).withColumn("opener", F.max("opener").over(Window.partitionBy("file", "member")))
    sections = cut(sections)
    wanted = sections.where(F.col("key").isin(list(keys)) & (F.col("opener") == "[")).select("file", "first", "section", "key", "base")
    rows = found.where("at >= 0").drop("key").join(wanted, ["file", "first", "section"]).select("file", "key", (F.col("base") + F.col("at")).cast("int").alias("pos"), "value")

    ends = begun.groupBy("file").agg(F.sum("quotes").alias("quotes"), F.sum("opened").alias("opened"))
    scalars = found.where("at = -1").select("file", "first", "section", "value")
    each = sections.where("section > 0").join(scalars, ["file", "first", "section"]).select("file", "member", "key", F.coalesce("value", "opener").alias("value"))
    last = each.groupBy("file", "key").agg(F.max_by("value", "member").alias("value"))
    members = last.where("key IS NOT NULL").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("members"))
    name = F.element_at(F.split("path", "/"), -1)
    paths = cuts.where("first = 0").select("file", "path", "size")
    heads = paths.join(ends, "file").join(members, "file", "left").select(
        "file", "path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        ((F.col("quotes") % 2 == 0) & (F.col("opened") == 0) & F.col("members").isNotNull()).alias("parsed"), F.coalesce("members", F.create_map().cast("map<string,string>")).alias("members"),
    )
    return Elements(rows, cut(heads))
