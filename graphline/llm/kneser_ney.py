"""Interpolated modified Kneser-Ney n-gram model over characters, for perplexity filtering.

A gram is ORDER code points, the last of them predicted from those before it; a
boundary stands before each text. With invented or rare words a word model knows
next to nothing of a new document. Every code point is itself, so the tables grow
with the text.

Count tables stay sharded by gram, from the first to the last. Each task counts
the grams of its blocks (see blocks.py); the counts of trusted texts are summed
by a shuffle, and discounts, context totals and continuation counts come from
joins and aggregations. The probability of each gram that occurs in any document
is made once, order by order, by joins with the counts of its context and the
probability of its suffix. Then each block gets the rows of its own grams as a
side table, and the task that scans its texts adds up their log-probabilities.
Texts are never shuffled, and no part of the model reaches the driver.

A document is rejected if its perplexity exceeds the ``quantile`` of trusted
documents of its language, with an allowance for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from graphline.llm.blocks import Side, SideReader, keep, runs
from graphline.llm.common import attach, stored
from graphline.llm.encode import text_slices, tidy
from graphline.llm.places import placed

#: Symbols are code points or BOUNDARY, of BITS bits; a context of ORDER - 1 symbols fits a long.
BITS, ORDER, BOUNDARY = 21, 4, 0x110000
MASK = (1 << BITS) - 1
#: Characters of a batch, and positions of the window within which grams are told apart by local numbers.
BATCH, WINDOW, NARROW = 1 << 20, 1 << 20, 60_000


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols with ORDER - 1 boundaries before each text, whether each is of a text, and the number of characters of each text."""
    lead = ORDER - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gaps = "\0" * lead
    points = np.frombuffer((gaps + gaps.join(texts) if texts else "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    gap = np.repeat(np.cumsum(sizes + lead) - sizes - lead, lead) + np.tile(np.arange(lead), len(texts))
    points[gap] = BOUNDARY
    inside = np.ones(len(points), bool)
    inside[gap] = False
    return points, inside, sizes


class Window:
    """Grams of consecutive positions, packed with the numbers that their symbols have in this window alone."""

    def __init__(self, points: np.ndarray, inside: np.ndarray):
        """``points`` begin with ORDER - 1 symbols of context, for which ``inside`` doesn't hold."""
        seen = np.zeros(BOUNDARY + 1, bool)
        seen[points] = True
        self.symbols = np.flatnonzero(seen)
        self.bits = max(1, int(len(self.symbols) - 1).bit_length())
        self.local = np.full(BOUNDARY + 1, -1, np.int32)
        self.local[self.symbols] = np.arange(len(self.symbols))
        own = self.local[points].astype(np.uint64)
        packed = own[ORDER - 1 :].copy()
        for k in range(1, ORDER):
            packed |= own[ORDER - 1 - k : len(own) - k] << np.uint64(self.bits * k)
        self.packed = packed[inside[ORDER - 1 :]]

    def unpacked(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, symbol) of packed grams."""
        context = np.zeros(len(packed), np.int64)
        own = np.uint64((1 << self.bits) - 1)
        for k in range(ORDER - 1, 0, -1):
            context = context << BITS | self.symbols[((packed >> np.uint64(self.bits * k)) & own).astype(np.int64)]
        return context, self.symbols[(packed & own).astype(np.int64)].astype(np.int32)

    def known(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed grams, and whether all their symbols occur in this window."""
        packed, here = np.zeros(len(symbol), np.uint64), np.ones(len(symbol), bool)
        for k in range(ORDER):
            one = symbol if k == ORDER - 1 else (context >> BITS * (ORDER - 2 - k)) & MASK
            number = self.local[one]
            here &= number >= 0
            packed = packed << np.uint64(self.bits) | np.maximum(number, 0).astype(np.uint64)
        return packed, here


def windows(points: np.ndarray, inside: np.ndarray) -> Iterator[tuple[Window, int, int]]:
    """Windows over all positions, and which positions they cover; four local numbers of a window fit 64 bits."""
    lead, step = ORDER - 1, WINDOW
    if len(points) > NARROW and len(np.unique(points)) > 1 << 16:
        step = NARROW
    for a in range(lead, len(points), step):
        b = min(a + step, len(points))
        yield Window(points[a - lead : b], inside[a - lead : b]), a, b


GRAMS = "block long, h long, w int, c long"


def grams(rows: DataFrame, trusted: Side) -> DataFrame:
    """(block, h, w, c): the grams of each block of ``rows`` (block, doc_id, text), and how often they occur in its trusted texts."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, good = trusted.reader(), None, np.empty(0, np.int64)
        for batch in parts:
            for block, part in runs(batch, 0):
                if block != last:
                    last, good = block, reader.column(block, "doc_id")
                ours = is_in(part.column(1), good)
                for a, b, texts in text_slices(part.column(2), BATCH):
                    points, inside, sizes = symbols_of(texts)
                    of = np.repeat(ours[a:b], sizes + ORDER - 1)
                    for window, s, e in windows(points, inside):
                        if not len(window.packed):
                            continue
                        known = of[s:e][inside[s:e]]
                        every, n = np.unique(window.packed[known], return_counts=True)
                        rest = np.setdiff1d(window.packed[~known], every)
                        h, w = window.unpacked(np.concatenate([every, rest]))
                        c = np.concatenate([n, np.zeros(len(rest), np.int64)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block)), pa.array(h), pa.array(w), pa.array(c)], ["block", "h", "w", "c"])

    found = rows.select("block", "doc_id", "text").mapInArrow(tidy(count), GRAMS)
    return stored(found.groupBy("block", "h", "w").agg(F.sum("c").alias("c")), "grams")


def is_in(ids: pa.Array, good: np.ndarray) -> np.ndarray:
    return np.isin(ids.fill_null(0).to_numpy(), good) & ~np.asarray(ids.is_null())


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """What counts of one, two and more give to the lower order; one row of counts of counts reaches the driver."""
    seen = table.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = ((seen[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    # where a count of counts is missing (little text) the discount falls back to y
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    d1, d2, d3 = (min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.95, 2.95), strict=True))
    return d1, d2, d3


def probabilities(counts: DataFrame) -> DataFrame:
    """(h, w, p) of every gram of ``counts`` (h, w, c; c = 0 where trusted text lacks it).

    Lower orders count how many symbols stand before a gram in the trusted text.
    Below the lowest order every symbol of the documents is as probable as another.
    """
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("h").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("h")
        tables.append(stored(tables[-1].groupBy(suffix, "w").agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), f"order-{order}"))
    symbols = max(1, tables[-1].count())
    lower = None
    for order, table in enumerate(reversed(tables), 1):
        d1, d2, d3 = discounts(table)
        c = F.col("c")
        taken = F.when(c == 0, F.lit(0.0)).when(c == 1, F.lit(d1)).when(c == 2, F.lit(d2)).otherwise(F.lit(d3))
        # a context has one row for each symbol that follows it, so at most as many as there are symbols;
        # whole numbers are summed, whose sum doesn't depend on the order of the rows
        times = [F.sum(hit.cast("long")) for hit in (c == 1, c == 2, c > 2)]
        given = times[0] * F.lit(d1) + times[1] * F.lit(d2) + times[2] * F.lit(d3)
        context = table.groupBy("h").agg(F.sum("c").alias("total"), given.alias("given"))
        of = table.join(context.hint("merge"), "h")
        share = F.when(F.col("total") > 0, (c - taken) / F.col("total")).otherwise(F.lit(0.0))
        left = F.when(F.col("total") > 0, F.col("given") / F.col("total")).otherwise(F.lit(1.0))
        if lower is None:
            found = of.select("h", "w", (share + left / symbols).alias("p"))
        else:
            shorter = F.col("h").bitwiseAND(F.lit((1 << BITS * (order - 2)) - 1)).alias("s")
            below = lower.select(F.col("h").alias("s"), "w", F.col("p").alias("q"))
            found = of.select("h", "w", shorter, share.alias("share"), left.alias("left")).join(below.hint("merge"), ["s", "w"]).select("h", "w", (F.col("share") + F.col("left") * F.col("q")).alias("p"))
        lower = stored(found, f"p-{order}")
    return lower


def trained(rows: DataFrame, labels: DataFrame) -> tuple[Side, Side]:
    """Side tables of ``rows`` (block, doc_id, text): the trusted doc_ids (doc_id), and the grams (h, w, bits) of each block."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = Side.write(rows.select("block", "doc_id").join(good.hint("merge"), "doc_id").distinct(), "trusted", "doc_id")
    found = grams(rows, trusted)
    p = probabilities(stored(found.groupBy("h", "w").agg(F.sum("c").alias("c")), f"order-{ORDER}"))
    bits = p.select("h", "w", (-F.log2("p")).cast("float").alias("bits"))
    return trusted, Side.write(found.select("block", "h", "w").join(bits.hint("merge"), ["h", "w"]).select("block", "h", "w", "bits"), "bits", "h", "w")


class BlockModel:
    """Bits of the grams of one block after another; what fits KEPT rows is read once."""

    KEPT = 1 << 22

    def __init__(self, reader: SideReader):
        self.reader, self.block, self.parts = reader, None, None

    def _parts(self, block: int) -> Iterator[tuple[np.ndarray, ...]]:
        if self.block == block and self.parts is not None:
            yield from self.parts
            return
        self.block, self.parts, held, n = block, None, [], 0
        for batch in self.reader.batches(block, "h", "w", "bits"):
            part = tuple(batch.column(k).to_numpy() for k in range(3))
            n += len(part[0])
            held = [*held, part] if n <= self.KEPT else []
            yield part
        if n <= self.KEPT:
            self.parts = held

    def bits(self, block: int, window: Window) -> np.ndarray:
        """Bits of each position of a window."""
        every, at = np.unique(window.packed, return_inverse=True)
        out = np.full(len(every), np.nan)
        for h, w, bits in self._parts(block):
            packed, here = window.known(h, w)
            packed, bits = packed[here], bits[here]
            place = np.minimum(np.searchsorted(every, packed), len(every) - 1)
            hit = every[place] == packed
            out[place[hit]] = bits[hit]
        if np.isnan(out).any():
            raise ValueError("a block holds a gram that was not counted: its rows changed between two passes")
        return out[at]


SCORES = "block long, row long, doc_id long, lang string, n_chars long, perplexity double, trusted boolean"


def scored(rows: DataFrame, model: tuple[Side, Side]) -> DataFrame:
    """SCORES of ``rows`` (block, row, doc_id, lang, text); perplexity is null for empty or null text."""
    trusted, bits = model

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, told, last, good = trusted.reader(), BlockModel(bits.reader()), None, np.empty(0, np.int64)
        for batch in parts:
            for block, part in runs(batch, 0):
                if block != last:
                    last, good = block, reader.column(block, "doc_id")
                ours = is_in(part.column(2), good)
                for a, b, texts in text_slices(part.column(4), BATCH):
                    points, inside, sizes = symbols_of(texts)
                    each = np.zeros(len(points))
                    for window, s, e in windows(points, inside):
                        if len(window.packed):
                            each[s:e][inside[s:e]] = told.bits(block, window)
                    mean = per_sum(each, sizes + ORDER - 1) / np.maximum(sizes, 1)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).slice(a, b - a) for k in range(4)), pa.array(sizes), pa.array(np.exp2(mean), mask=sizes == 0), pa.array(ours[a:b])], NAMES)

    return rows.select("block", "row", "doc_id", "lang", "text").mapInArrow(tidy(run), SCORES)


NAMES = [f.split()[0] for f in SCORES.split(", ")]


def per_sum(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values, none of them empty. Each is of its own values alone, so equal texts get equal sums wherever they stand."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)


QUANTILE, LEAST = 0.99, 30
#: The perplexity of few characters varies more: the limit grows by SHORT / sqrt(characters).
SHORT = 2.0
#: Ranges of one doubling of the perplexity, by which the place of a quantile is found.
RANGES = 1024


def limits(known: DataFrame, quantile: float) -> DataFrame:
    """(whole, lang, n, limit) of each language of ``known`` (lang, perplexity), and of all its rows as ``whole``.

    The limit is the perplexity of rank ceil(quantile * n), exactly and whatever the
    order of the rows: counts of narrow ranges tell the range that has this rank, and
    the counted values of that range alone are put in order.
    """
    of = F.array(F.struct(F.lit(False).alias("whole"), "lang"), F.struct(F.lit(True).alias("whole"), F.lit("").alias("lang")))
    rows = known.select(F.explode(of).alias("of"), "perplexity", F.floor(F.log2("perplexity") * RANGES).alias("part")).select("of.*", "perplexity", "part").where("lang IS NOT NULL")
    group = SqlWindow.partitionBy("whole", "lang")

    def with_rank(counted: DataFrame, value: str) -> DataFrame:
        before = F.sum("c").over(group.orderBy(value).rowsBetween(SqlWindow.unboundedPreceding, -1))
        return counted.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("c")))

    parts = rows.groupBy("whole", "lang", "part").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(group))
    parts = with_rank(parts.withColumn("rank", F.greatest(F.ceil(F.lit(quantile) * F.col("n")), F.lit(1))), "part")
    near = attach(rows, parts.select("whole", "lang", "part", "n", (F.col("rank") - F.col("before")).alias("rank")), ["whole", "lang", "part"])
    near = near.where("rank IS NOT NULL").groupBy("whole", "lang", "n", "rank", "perplexity").agg(F.count(F.lit(1)).alias("c"))
    return with_rank(near, "perplexity").select("whole", "lang", "n", F.col("perplexity").alias("limit"))


def judged(table: DataFrame, quantile: float, least: int) -> DataFrame:
    """SCORES with threshold and kept. Text is not part of the table, and the limits of languages are few."""
    known = table.where(F.col("trusted") & F.col("perplexity").isNotNull())
    found = stored(limits(known, quantile), "limits")
    each = found.where(~F.col("whole") & (F.col("n") >= least)).select("lang", F.col("limit").alias("of_lang"))
    over_all = next((r["limit"] for r in found.where("whole").collect()), None)  # one row
    found = attach(table, each, ["lang"])
    limit = F.coalesce("of_lang", F.lit(over_all).cast("double")) * (1 + F.lit(SHORT) / F.sqrt(F.greatest("n_chars", F.lit(1))))
    return found.withColumn("threshold", limit).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def _judged_rows(docs: DataFrame, labels: DataFrame, quantile: float, least: int) -> tuple[DataFrame, DataFrame]:
    """The placed rows of ``docs``, and the judged table over them."""
    rows = placed(docs)
    doc_id, lang, text = (F.col(f"in_{docs.columns.index(c)}") for c in ("doc_id", "lang", "text"))
    slim = rows.select("block", "row", doc_id.cast("long").alias("doc_id"), lang.cast("string").alias("lang"), text.alias("text"))
    return rows, judged(stored(scored(slim, trained(slim, labels)), "scores"), quantile, least)


def perplexity(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, lang, n_chars, perplexity, threshold, kept.

    Null or empty text has no perplexity and is kept; a text of any length is
    scored whole. A language with fewer than ``least`` trusted documents, or null,
    has the threshold over all languages; without any trusted text every document
    is kept. Repeated rows are scored one by one, and all rows of a trusted doc_id
    are trusted; a null doc_id never is. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    _, found = _judged_rows(docs.select("doc_id", "lang", "text"), labels, quantile, least)
    return found.select("doc_id", "lang", "n_chars", "perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """The rows that ``perplexity`` keeps, with all their columns; nulls, empty tables and repeated rows as there."""
    rows, found = _judged_rows(docs, labels, quantile, least)
    return keep(rows, docs, found.where("kept"))
