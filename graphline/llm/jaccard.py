"""Exact join of documents by Jaccard similarity of their word shingles, as components.

Equal sets are one document, their smallest doc_id, from the start.

Candidates. Shingles are hashed to 64 bits and ordered: those that are frequent in
a bounded sample of documents last, else by hash. Any such order, applied to all
documents alike, makes the prefix filter exact: two sets with similarity of at
least t share a shingle among the first n - ceil(t n) + 1 of each. Documents that
share such a shingle form a tile; tiles with the same members are kept once.
Shingles that the sample shows to be in very many documents skip that step, which
would gather their documents in one task.

Size bands. A band holds sizes within a factor of 1 / t, so a pair that links lies
in one band or in two neighbours. A tile beyond TILE members is cut into blocks of
one band, and only blocks of neighbouring bands meet. Inside a block documents are
sorted by size and compared with those of compatible sizes alone.

Bounds. Each set has a hashed parity bitmap (bit = number of its shingles with that
hash, modulo 2) whose width follows the size of the set; the wider of two bitmaps
is folded to the width of the other. The number of differing bits is at most the
size of the symmetric difference, which bounds the overlap from above: a pair over
the bound can't link.

Verification. Pairs that pass are verified by intersecting the sorted arrays, in
rounds: first each document of a block with the smallest partner that its bitmap
suggests; where tiles have several blocks, then the same for the smallest member
of each component of a tile; then the NEAREST most promising pairs for each two components, and, where two that
had more are still apart, all pairs of documents of such components that pass the
bound.
Pairs within one component need no test, so a group of n copies costs about n
tests, and no pair of different components is left untested. A large tile of one
component and a few other documents meets these alone, not itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.common import by_key, documents, small_batches, stored
from graphline.llm.encode import text_slices, tidy
from graphline.llm.filters import bloom, passing, tested
from graphline.operators.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SIZE, PERCENT = 5, 75
TILE, BUFFER, LEADERS = 4096, 1 << 16, 64
#: Documents from which on a shingle is a tile by itself, by the estimate of the sample.
HOT_SHINGLE = 1 << 20
#: Bytes of text that a task has as Python strings at once.
BATCH = 2 << 20
#: Percent by which an estimated similarity is safely over the limit.
MARGIN = 4
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: Bits of the narrowest and the widest bitmap, and least bits for each shingle in between.
NARROW, WIDE, SPREAD = 64, 16384, 2
#: Bits of a shingle by which most are seen not to be frequent.
MARKS = 22
#: Pairs of two components that a task tests before it leaves the others to the next round.
NEAREST = 8


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of word shingles as sorted arrays of distinct 64-bit hashes; keeps the hashes of words it has seen."""

    def __init__(self, size: int = SIZE, max_words: int = 100_000):
        self.size, self.max_words, self.hashes = size, max_words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").encode().lower())  # on bytes: A-Z only
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if n < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
        if len(self.hashes) > self.max_words:
            self.hashes = _Hashes()
        each = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        out = each[: n - self.size + 1].copy()
        for k in range(1, self.size):
            out *= A
            out ^= out >> C
            out += each[k : n - self.size + 1 + k]
        out *= B
        out ^= out >> C
        return np.unique(out)


def needed(n: int, percent: int = PERCENT) -> int:
    """Smallest overlap with a set that may link to one of n elements."""
    return -(-percent * n // 100)


def bitmap(shingles: np.ndarray) -> bytes:
    width = NARROW
    while width < min(SPREAD * len(shingles), WIDE):
        width *= 2
    bits = np.bincount(((shingles * B) >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def frequent_shingles(docs: DataFrame, sample_docs: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least ``least`` sampled documents, rarest first, at most ``most``; and of how many documents about. They only order the prefix."""
    share = max(1, docs.count() // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in parts:
            for _, _, texts in text_slices(batch.column(0), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingler(t) for t in texts]).view(np.int64))], ["h"])

    counted = sample.mapInArrow(tidy(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counted.orderBy(F.desc("n"), "h").limit(most).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64), np.array([r["n"] * share for r in reversed(top)], np.int64)


def signatures(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, its prefix and its bitmap."""
    rank_of = np.argsort(frequent)
    ordered = frequent[rank_of]
    marks = np.zeros(1 << MARKS, bool)
    marks[ordered >> np.uint64(64 - MARKS)] = True

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in parts:
            ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1), BATCH):
                n, digest, prefix, maps = [], [], [], []
                for text in texts:
                    s = shingler(text)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    maps.append(bitmap(s))
                    length = len(s) - needed(len(s), percent) + 1 if len(s) else 0
                    prefix.append(first_of(s, ordered, rank_of, marks, length).view(np.int64))
                sizes = np.cumsum([0, *map(len, prefix)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*prefix, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(maps, pa.binary())], ["doc_id", "n", "digest", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, digest binary, prefix array<long>, bits binary")


def first_of(s: np.ndarray, ordered: np.ndarray, rank_of: np.ndarray, marks: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` shingles of a sorted set in the order of the prefix filter; ``marks`` has the first bits of frequent ones."""
    if not len(ordered):
        return s[:length]
    maybe = np.flatnonzero(marks[s >> np.uint64(64 - MARKS)])
    at = np.minimum(np.searchsorted(ordered, s[maybe]), len(ordered) - 1)
    same = ordered[at] == s[maybe]
    often, at = maybe[same], at[same]
    rare = np.ones(len(s), bool)
    rare[often] = False
    first = s[rare][:length]
    if len(first) == length:
        return first
    last = s[often][np.argsort(rank_of[at], kind="stable")]
    return np.concatenate([first, last[: length - len(first)]])


def tiles(table: DataFrame, hot: np.ndarray) -> DataFrame:
    """(tile, doc_id) of documents that share a prefix shingle; tiles of the same members once for each task.

    ``hot`` are shingles of very many documents: each is a tile as it is.
    """
    pairs = table.select(F.explode("prefix").alias("key"), "doc_id")
    if len(hot):
        many = F.broadcast(table.sparkSession.createDataFrame([(h,) for h in hot.view(np.int64).tolist()], "key long"))  # no more than the sample's shingles
        return _tiles(pairs.join(many, "key", "left_anti")).union(pairs.join(many, "key").select("key", "doc_id").distinct())
    return _tiles(pairs)


def _tiles(pairs: DataFrame) -> DataFrame:
    pairs = pairs.repartition("key").sortWithinPartitions("key", "doc_id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        key, members, spilled, last = None, [], False, None

        def rows(tile: int, ids: list[np.ndarray]) -> pa.RecordBatch:
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), tile)), pa.array(flat)], ["tile", "doc_id"])

        def closed() -> Iterator[pa.RecordBatch]:
            """What ends with the open run of one key, held as a list of arrays."""
            flat = np.unique(np.concatenate(members))
            if spilled:
                yield rows(key, [flat])
            elif len(flat) > 1:
                mark = xxhash.xxh3_64_intdigest(flat.tobytes())
                if mark not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(mark)
                    yield rows(np.uint64(mark).astype(np.int64), [flat])

        for batch in parts:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            # runs of one row that neither open nor close the batch can't be shared
            inner = np.ones(len(starts), bool)
            inner[1:-1] = (ends - starts)[1:-1] > 1
            for s, e in zip(starts[inner].tolist(), ends[inner].tolist(), strict=True):
                if keys[s] != key:
                    if members:
                        yield from closed()
                    key, members, spilled = keys[s], [], False
                members.append(ids[s:e])
                if sum(map(len, members)) > BUFFER:
                    # too long to hold: the run goes out under its key; the last row leads the next part
                    yield rows(key, members)
                    members, spilled = [members[-1][-1:]], True
        if members:
            yield from closed()

    return pairs.mapInArrow(tidy(run), "tile long, doc_id long").distinct()


class Bitmaps:
    """Bitmaps of the members of a tile, folded to each width that is asked for."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([8 * len(b) for b in bits])
        self.folded: dict[int, np.ndarray] = {}
        self.bits = bits

    def at(self, width: int) -> np.ndarray:
        """(members, width / 64) words; rows of narrower bitmaps are zero and not to be used."""
        if width not in self.folded:
            out = np.zeros((len(self.bits), width // 64), np.uint64)
            for w in np.unique(self.width[self.width >= width]).tolist():
                on = np.flatnonzero(self.width == w)
                rows = np.frombuffer(b"".join(self.bits[i] for i in on), np.uint64).reshape(len(on), w // width, width // 64)
                out[on] = np.bitwise_xor.reduce(rows, axis=1)
            self.folded[width] = out
        return self.folded[width]

    def differing(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differing bits of one member and others, and the width at which each was compared."""
        out, width = np.empty(len(others), np.int64), np.minimum(self.width[one], self.width[others])
        for w in np.unique(width).tolist():
            on = width == w
            words = self.at(w)
            out[on] = np.bitwise_count(words[others[on]] ^ words[one]).sum(axis=1)
        return out, width


def may_link(n: int, others: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound leaves a link possible: overlap <= (n + m - differ) / 2 and 100 * overlap >= percent * union."""
    total = n + others
    most = np.minimum((total - differ) // 2, np.minimum(n, others))
    return 100 * most >= percent * (total - most)


def similarity(n: int, others: np.ndarray, differ: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Estimated similarity from the differing bits."""
    share = np.minimum(2 * differ / width, 0.999)
    apart = -width / 2 * np.log1p(-share)
    return (n + others - apart) / np.maximum(n + others + apart, 1)


def pairs_of_tile(ids: np.ndarray, n: np.ndarray, bits: list[bytes], block: np.ndarray, label: np.ndarray, leaders: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, estimate): with ``leaders`` the smallest promising partner of members, else all pairs of different labels that pass the bound."""
    maps = Bitmaps(bits)
    crossing = len(np.unique(block)) > 1
    if leaders:
        free = np.argsort(ids)
        for _ in range(LEADERS):
            if len(free) < 2:
                return
            one, rest = free[0], free[1:]
            differ, width = maps.differing(one, rest)
            near = similarity(n[one], n[rest], differ, width)
            good = may_link(n[one], n[rest], differ, percent) & (100 * near >= percent) & (ids[rest] != ids[one])
            yield ids[rest[good]], np.full(good.sum(), ids[one]), near[good]
            # a partner that is only just similar may fail the test: look for another
            free = rest[~(good & (100 * near >= percent + MARGIN))]
        return
    order = np.argsort(n, kind="stable")
    for k, one in enumerate(order):
        # larger members up to the largest that can link
        last = np.searchsorted(n[order], 100 * n[one] // percent, "right")
        others = order[k + 1 : last]
        others = others[label[others] != label[one]]
        if crossing:
            others = others[block[others] != block[one]]
        if len(others):
            differ, width = maps.differing(one, others)
            good = may_link(n[one], n[others], differ, percent)
            others = others[good]
            if len(others):
                yield np.full(len(others), ids[one]), ids[others], similarity(n[one], n[others], differ[good], width[good])


PAIRS = "a long, b long, la long, lb long, near double, more boolean"


def tile_pairs(members: DataFrame, leaders: bool, best: bool, percent: int) -> DataFrame:
    """Candidate pairs (PAIRS) of all tiles, with ``best`` only the nearest of two labels that a task finds; ``members``: tile, i, j, doc_id, n, bits, block, label."""
    rows = members.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "doc_id").select("tile", "i", "j", "doc_id", "n", "bits", "block", "label")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[np.ndarray] = []
        open_tile = None

        def done() -> Iterator[pa.RecordBatch]:
            """The pairs of the open tile; those of many tiles are reduced before they go out."""
            table = pa.Table.from_batches(held)
            ids, n, block, label = (table.column(c).to_numpy() for c in ("doc_id", "n", "block", "label"))
            if len(ids) < 2 or not leaders and (label == label[0]).all():
                return
            of = dict(zip(ids.tolist(), label.tolist(), strict=True))
            for a, b, near in pairs_of_tile(ids, n, table.column("bits").to_pylist(), block, label, leaders, percent):
                if len(a):
                    la, lb = (np.array([of[x] for x in side.tolist()], np.int64) for side in (a, b))
                    rows = np.rec.fromarrays([a, b, la, lb, near, np.zeros(len(a), bool)], dtype=ROWS)
                    made.append(rows)
                    if sum(map(len, made)) > HELD:
                        made[:] = [reduced(np.concatenate(made), best)]
                        if len(made[0]) > HELD // 2:
                            yield batch_of(made.pop())

        for batch in parts:
            t = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((t[1:] != t[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
                if s == e:
                    continue
                if tuple(t[s]) != open_tile:
                    if held:
                        yield from done()
                    held, open_tile = [], tuple(t[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield from done()
        if made:
            yield batch_of(reduced(np.concatenate(made), best))

    return rows.mapInArrow(tidy(run), PAIRS)


ROWS = np.dtype([("a", np.int64), ("b", np.int64), ("la", np.int64), ("lb", np.int64), ("near", np.float64), ("more", np.bool_)])
#: Pairs that a task holds before it reduces them.
HELD = 1 << 18


def batch_of(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in ROWS.names], list(ROWS.names))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def reduced(rows: np.ndarray, best: bool) -> np.ndarray:
    """Distinct pairs; with ``best`` the NEAREST of each two labels, marked where there were more."""
    low, high = np.minimum(rows["a"], rows["b"]), np.maximum(rows["a"], rows["b"])
    order = np.lexsort((~rows["more"], high, low))  # of equal pairs one that is marked
    rows = rows[order[_starts(low[order], high[order])]]
    if not best:
        return rows
    low, high = np.minimum(rows["la"], rows["lb"]), np.maximum(rows["la"], rows["lb"])
    order = np.lexsort((rows["b"], rows["a"], -rows["near"], high, low))
    rows, first = rows[order], np.flatnonzero(_starts(low[order], high[order]))
    sizes = np.diff([*first, len(rows)])
    marked = np.logical_or.reduceat(rows["more"], first) | (sizes > NEAREST) if len(first) else np.empty(0, bool)
    rows["more"] = np.repeat(marked, sizes)
    return rows[np.arange(len(rows)) - np.repeat(first, sizes) < NEAREST]


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those that link, by intersecting the sorted arrays of shingles."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # only texts that pass the filter of the ids are shuffled
    ids = stored(ids, "tested")
    key = F.xxhash64("doc_id")
    texts = passing(docs.select("doc_id", "text"), key, bloom(ids, key)).join(ids.hint("merge"), "doc_id", "left_semi")

    def shingle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in parts:
            for a, b, texts in text_slices(batch.column(1), BATCH):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([shingler(t).tobytes() for t in texts], pa.binary())], ["doc_id", "s"])

    sets = stored(texts.mapInArrow(tidy(shingle), "doc_id long, s binary"), "sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))

    def test(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keep = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(test), "a long, b long")


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted arrays of distinct values that aren't empty."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = int((y[at] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, sample_docs: int = 20_000, least: int = 4, most: int = 1 << 17) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null and empty texts, and texts without words, have an empty set and link with
    nothing. Rows that repeat a doc_id are one node. A row without doc_id has its
    set size but no component. An empty table gives an empty result; other columns
    are ignored. ``sample_docs``, ``least`` and ``most`` bound the sample that
    orders the shingles; they bear on speed only.
    """
    with small_batches(docs.sparkSession):
        return _classes(documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), percent, sample_docs, least, most)


def _classes(docs: DataFrame, percent: int, sample_docs: int, least: int, most: int) -> DataFrame:
    frequent, times = frequent_shingles(docs, sample_docs, least, most)
    table = stored(signatures(docs, frequent, percent), "signatures")
    known = table.where("n > 0 AND doc_id IS NOT NULL")

    # equal sets are one node, their smallest doc_id
    first = stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("records")), "reps")
    total = table.count()
    rep = stored(by_key(known.select("doc_id", "digest"), first, "digest", total).select("doc_id", "digest", "rep", "records").distinct(), "copies")
    nodes = _nodes(known, rep.where("doc_id <> rep").select("doc_id", "digest"))
    maps = stored(nodes.select("doc_id", "n", "bits").distinct(), "bitmaps")
    held = tiles(nodes.select("doc_id", "prefix"), frequent[times > HOT_SHINGLE]).join(maps.select("doc_id", "n").distinct(), "doc_id")
    held = stored(held.select("tile", "doc_id", "n"), "members")
    rows = held.count()
    size = stored(held.groupBy("tile").agg(F.count(F.lit(1)).alias("records")).where("records > 1"), "tiles")
    held = stored(by_key(held, size, "tile", rows), "tiles")  # tile, doc_id, n, records

    # a doc_id of several sets joins their nodes
    several = rep.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    links = stored(rep.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")), "links")
    found = Found(docs, percent, maps, links)

    found.leaders(held, rows)
    reduced = held.where(F.col("records") > TILE)
    while not reduced.isEmpty():
        # of each component in a tile of several blocks the smallest member
        reduced = found.labelled(reduced).groupBy("tile", "label").agg(F.min(F.struct("doc_id", "n")).alias("m")).select("tile", "m.doc_id", "m.n")
        count = reduced.groupBy("tile").agg(F.count(F.lit(1)).alias("records")).where("records > 1")
        reduced = stored(by_key(stored(reduced, "leaders"), stored(count, "sizes"), "tile", rows), "leaders")
        if not found.leaders(reduced, rows):
            break
        reduced = reduced.where(F.col("records") > TILE)
    found.crossing(held, rows)

    # the copies of one set may be many
    of = rep.groupBy("rep").agg(F.count(F.lit(1)).alias("records")).join(found.components(), F.col("rep") == F.col("node"), "left").select("rep", "records", F.coalesce("component", "rep").alias("component"))
    ids = by_key(rep.select("doc_id", "rep"), stored(of, "components"), "rep", total).select("doc_id", "component").distinct()
    return table.select("doc_id", "n").join(ids.hint("merge"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _nodes(known: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``known`` without those of ``copies`` (doc_id, digest), of which alone the candidates are shuffled."""
    key = F.xxhash64("doc_id", "digest")
    told = tested(known, key, bloom(copies, key))
    rest = told.where("filter_hit").join(copies.hint("merge"), ["doc_id", "digest"], "left_anti")
    columns = ["doc_id", "n", "prefix", "bits"]
    return told.where(~F.col("filter_hit")).select(columns).unionByName(rest.select(columns))


class Found:
    """Links found so far, the pairs tested for them, and the components that they make."""

    def __init__(self, docs: DataFrame, percent: int, maps: DataFrame, links: DataFrame):
        self.docs, self.percent, self.maps, self.links = docs, percent, maps, links
        self.done: DataFrame | None = None
        self.label: DataFrame | None = None

    def components(self) -> DataFrame:
        if self.label is None:
            self.label = components(self.links)
        return self.label

    def labelled(self, members: DataFrame) -> DataFrame:
        """(tile, doc_id, n, label): the component of each member."""
        of = self.components()
        return members.join(of.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("tile", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))

    def _test(self, picked: DataFrame) -> bool:
        """Verify pairs that weren't tested before; whether there were any."""
        picked = picked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.done is not None:
            picked = picked.join(self.done.hint("merge"), ["a", "b"], "left_anti")
        picked = stored(picked, "pairs")
        if picked.isEmpty():
            return False
        self.done = picked if self.done is None else self.done.union(picked)
        self.links = self.links.union(stored(verified(picked, self.docs, self.percent), "links"))
        self.label = None
        return True

    def leaders(self, members: DataFrame, rows: int) -> bool:
        """Link members (tile, doc_id, n, records) with the smallest promising partners of their block; whether any pair was tested."""
        block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("records") / TILE)).cast("long")
        blocks = members.select("tile", "doc_id", "n", block.alias("i"), block.alias("j"), block.alias("block"), F.col("doc_id").alias("label"))
        pairs = tile_pairs(blocks.join(self.maps.hint("merge"), ["doc_id", "n"]), True, False, self.percent)
        sure = F.when(F.col("near") * 100 >= self.percent + MARGIN, F.col("b"))
        return self._test(pairs.groupBy("a").agg(F.array_distinct(F.array_compact(F.array(F.min("b"), F.min(sure)))).alias("b")).select("a", F.explode("b").alias("b")))

    def crossing(self, members: DataFrame, rows: int) -> None:
        """Test pairs of different components that pass the bound: of each two the nearest, and all where that leaves two apart."""
        labels = stored(self.labelled(members), "labelled")
        # tiles within one component are done with; bitmaps are fetched for the others alone
        labels = stored(_mixed(labels, rows), "mixed")
        pairs = stored(self._across(labels, rows, best=True), "nearest")
        self._test(pairs.select("a", "b"))
        # components that are still apart from one with which they had more pairs than were tested
        of = self.components()
        left, right = (of.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
        apart = pairs.where("more").select("a", "b").join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x <> y")
        apart = stored(apart.select(F.explode(F.array("x", "y")).alias("component")).distinct(), "apart")
        if apart.isEmpty():
            return
        counted = labels.groupBy("label").agg(F.count(F.lit(1)).alias("records")).join(of.hint("merge"), F.col("label") == F.col("node"), "left")
        counted = counted.select("label", "records", F.coalesce("component", "label").alias("component")).join(apart.hint("merge"), "component")
        labels = by_key(labels.drop("records"), stored(counted, "components"), "label", rows).select("tile", "doc_id", "n", F.col("component").alias("label"))
        self._test(self._across(stored(_mixed(stored(labels, "labelled"), rows), "mixed"), rows, best=False).select("a", "b"))

    def _across(self, labels: DataFrame, rows: int, best: bool) -> DataFrame:
        """Pairs (PAIRS) of different labels in tiles (tile, doc_id, n, label, records), with ``best`` the nearest of each two labels."""
        zero = F.lit(0).cast("long")
        blocks = labels.where(F.col("records") <= TILE).select("tile", "doc_id", "n", "label", zero.alias("block"), zero.alias("i"), zero.alias("j"))
        large = labels.where(F.col("records") > TILE).drop("records")
        if not large.isEmpty():
            blocks = blocks.unionByName(grid(large, rows, self.percent))
        return tile_pairs(blocks.join(self.maps.hint("merge"), ["doc_id", "n"]), False, best, self.percent)


def _mixed(labels: DataFrame, rows: int) -> DataFrame:
    """Of (tile, doc_id, n, label) the tiles of several labels, with their number of members as ``records``."""
    mixed = labels.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("records")).where("low < high").select("tile", "records")
    return by_key(labels, stored(mixed, "tiles"), "tile", rows)


def grid(members: DataFrame, rows: int, percent: int) -> DataFrame:
    """Members (tile, doc_id, n, label) of large tiles, once for each pair of blocks that they belong to: with block, i and j.

    A block is of one size band, and of the largest component of its tile or of the
    others. Blocks of neighbouring bands meet, but not two of the largest component,
    which has nothing left to test within itself.
    """
    counted = members.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("tile").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("records"))
    # a little more than the ratio of sizes that can link, so that rounding can't part two neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent * 1.0005)))
    kind = 2 * band + (F.col("label") == F.col("major")).cast("long")
    of = stored(by_key(members, stored(counted, "major"), "tile", rows).select("tile", "doc_id", "n", "label", kind.alias("kind")), "kinds")
    sizes = of.groupBy("tile", "kind").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.ceil(F.col("n") / TILE).alias("blocks")))).alias("sizes"), F.sum("n").alias("records"))  # two entries for each band
    of = by_key(of, stored(sizes, "sizes"), "tile", rows)
    block = F.shiftleft("kind", 32) + F.pmod(F.xxhash64("doc_id"), F.col("sizes")[F.col("kind")])
    # the smaller components of the band and its neighbours, and for these the largest too
    low = F.col("kind") - F.col("kind") % 2
    near = F.array(*[low + d for d in (-2, 0, 2)])
    near = F.when(F.col("kind") % 2 == 0, F.concat(near, F.array(*[low + d for d in (-1, 1, 3)]))).otherwise(near)
    blocks = lambda k: F.transform(F.sequence(F.lit(0).cast("long"), F.try_element_at("sizes", k) - 1), lambda b: F.shiftleft(k, 32) + b)
    each = F.flatten(F.transform(F.filter(near, lambda k: F.try_element_at("sizes", k).isNotNull()), blocks))
    of = of.select("tile", "doc_id", "n", "label", block.alias("block"), F.explode(each).alias("to"))
    return of.select("tile", "doc_id", "n", "label", "block", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"))
