"""Quality rules: simple counts of words, lines and symbols, and tokeniser fertility.

Two public vocabularies measure each text: characters per token (both), tokens
per word, the share of byte-fallback tokens and the entropy of the token
distribution (pieces). What is usual depends on the language and, above all for
entropy, on the number of tokens. So the usual range of each measure is fitted
per language (per script where the language is null) and per power of two of the
token count: median and interquartile range over all distinct texts that pass the
base rules. A text is rejected where a measure leaves the band

    median - below * scale  <=  measure  <=  median + above * scale

with scale = max(IQR / 1.349, floor). Where fewer than ``least`` texts have that
language and size, the nearest sizes are pooled until there are as many, if need be
all of the language; a language of fewer texts is judged by all texts of the
nearest sizes. Entropy is first moved by what its median over all texts
differs between the sizes. So some band judges every text, whatever the size of the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphline.llm.blocks import keep
from graphline.llm.common import attach, stored
from graphline.llm.encode import MAX_CHUNKS, encoder, per_text, text_slices, token_lengths
from graphline.llm.places import placed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Two encoders share a worker, so each remembers less.
HALF = MAX_CHUNKS // 3

#: First code point of blocks, and the script that begins there.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]


@dataclass(frozen=True)
class Band:
    """Rejects below median - below * scale and above median + above * scale (None: no bound). floor is absolute, relative a share of the median."""

    measure: str
    below: float | None
    above: float | None
    floor: float = 0.0
    relative: float = 0.0
    #: The measure grows with the token count, so texts of other sizes are moved before they are pooled.
    grows: bool = False


BANDS = (
    Band("entropy", below=4.0, above=None, floor=0.12, grows=True),
    Band("tokens_per_word", below=None, above=8.0, relative=0.03),
    Band("chars_per_token", below=10.0, above=10.0, relative=0.02),
    Band("chars_per_token_b", below=10.0, above=10.0, relative=0.02),
    Band("byte_share", below=None, above=10.0, floor=0.006),
)

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURES = "fertility_group string, fertility_size int, chars_per_token double, chars_per_token_b double, tokens_per_word double, byte_share double, entropy double, text_hash long"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if WORD.search(line)] if "\n" in text else []
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            end = 0  # positions before it are counted
            for at, window in enumerate(windows):
                if count[window] > 1:
                    repeated += at + WINDOW - max(at, end)
                    end = at + WINDOW
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def script_of(text: str) -> str:
    """The script of most letters and signs beyond ASCII punctuation; latin if there are none."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = codes[(codes > 0x40) & (codes < 0x20000)]
    if not len(codes):
        return "latin"
    at = np.searchsorted([first for first, _ in SCRIPTS], codes, "right") - 1
    return SCRIPTS[np.bincount(at).argmax()][1]


def token_measures(texts: list[str], piece_model: str, byte_model: str) -> dict[str, np.ndarray]:
    """Tokens and measures of each text; texts without tokens measure 0."""
    piece = encoder("piece", piece_model, HALF)
    ids, sizes = piece.encode(texts)
    byte_tokens = token_lengths(byte_model, texts, HALF)
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    is_byte = (ids >= 3) & (ids < 259)  # the byte pieces of the model
    owner = np.repeat(np.arange(len(texts)), sizes)
    pair, count = np.unique(owner.astype(np.int64) << 32 | ids, return_counts=True)
    of = pair >> 32
    share = count / sizes[of]
    entropy = np.bincount(of, weights=-share * np.log2(share), minlength=len(texts))
    some = np.maximum(sizes, 1)
    return {"tokens": sizes, "chars_per_token": chars / some, "chars_per_token_b": chars / np.maximum(byte_tokens, 1), "byte_share": per_text(is_byte, sizes) / some, "entropy": entropy}


def measured(docs: DataFrame, piece_model: str, byte_model: str, batch_bytes: int = 2 << 20) -> DataFrame:
    """BASE and MEASURES of each row, with its columns other than text and lang.

    ``docs`` must hold none of those names; callers select or rename first.
    """
    fields = f"{BASE}, {MEASURES}"
    names = [f.split()[0] for f in fields.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    kinds = [types[f.split()[1]] for f in fields.split(", ")]
    from pyspark.sql.types import StructType

    given = docs.columns
    carried = [c for c in given if c not in ("text", "lang")]
    schema = StructType([*(docs.schema[c] for c in carried), *StructType.fromDDL(fields).fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            langs = batch.column(given.index("lang")).to_pylist()
            for a, b, part in text_slices(batch.column(given.index("text")), batch_bytes):
                base = np.array([base_counts(t) for t in part], np.int64).reshape(-1, 5)
                m = token_measures(part, piece_model, byte_model)
                words, repeated = base[:, 0], base[:, 4]
                group = [lang if lang else "script:" + script_of(t) for t, lang in zip(part, langs[a:b], strict=True)]
                size = np.floor(np.log2(np.maximum(m["tokens"], 1))).astype(np.int32)
                per_word = m["tokens"] / np.maximum(words, 1)
                hashes = [hash_text(t) for t in part]
                columns = [*base.T, (words < 10) | (100 * repeated > 20 * words), group, size, m["chars_per_token"], m["chars_per_token_b"], per_word, m["byte_share"], m["entropy"], hashes]
                yield pa.RecordBatch.from_arrays([*(batch.column(given.index(c)).slice(a, b - a) for c in carried), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*carried, *names])

    return docs.mapInArrow(run, schema)


def hash_text(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "little", signed=True)


def pooled_sizes(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, size, fertility_size): for each size the nearest sizes that together have ``least`` texts, or all; ``cells``: keys, fertility_size, n."""
    near = cells.select(*keys, F.col("fertility_size").alias("size")).join(cells, keys) if keys else cells.select(F.col("fertility_size").alias("size")).crossJoin(cells)
    near = near.withColumn("away", F.abs(F.col("size") - F.col("fertility_size")))
    closer = Window.partitionBy(*keys, "size").orderBy("away").rangeBetween(Window.unboundedPreceding, -1)
    return near.withColumn("before", F.coalesce(F.sum("n").over(closer), F.lit(0))).where(F.col("before") < least).select(*keys, "size", "fertility_size")


#: Parts of a unit of a measure, by which the place of a quantile is found.
PARTS = 1 << 14


def exact_ranks(rows: DataFrame, keys: list[str], values: dict[str, Column], shares: tuple[float, ...]) -> DataFrame:
    """(keys, n, an array for each of ``values``): its values of rank ceil(share * n), exactly and whatever the order of the rows.

    Counts of narrow parts tell which part has a rank; the counted values of these
    parts alone are put in order.
    """
    each = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), v.cast("double").alias("value")) for name, v in values.items()])).alias("one"))
    each = each.select(*keys, "one.measure", (F.col("one.value") + 0.0).alias("value")).withColumn("part", F.floor(F.col("value") * PARTS))
    group = Window.partitionBy(*keys, "measure")
    earlier = lambda by: F.coalesce(F.sum("c").over(group.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("c"))

    parts = each.groupBy(*keys, "measure", "part").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(group)).withColumn("before", earlier("part"))
    ranks = F.array(*[F.struct(F.lit(k).alias("share"), F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).alias("rank")) for k, q in enumerate(shares)])
    parts = parts.select("*", F.explode(ranks).alias("r")).select(*keys, "measure", "part", "n", "before", "c", "r.*").where(inside)
    asked = parts.groupBy(*keys, "measure", "part", "n").agg(F.collect_list(F.struct("share", (F.col("rank") - F.col("before")).alias("rank"))).alias("ranks"))  # as many as shares
    near = attach(each, asked, [*keys, "measure", "part"]).where("ranks IS NOT NULL")
    near = near.groupBy(*keys, "measure", "part", "n", "ranks", "value").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*keys, "measure", "part")
    found = near.withColumn("before", earlier("value")).select("*", F.explode("ranks").alias("r")).select(*keys, "n", "measure", "value", "before", "c", "r.*").where(inside)
    of = lambda name: F.array(*[F.max(F.when((F.col("measure") == name) & (F.col("share") == k), F.col("value"))) for k in range(len(shares))]).alias(name)
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[of(name) for name in values])


def _pooled(good: DataFrame, moved: DataFrame, by: list[str]) -> DataFrame:
    """Texts with each pool that gathers them: the pools of a cell are few and come to its texts as one value."""
    pools = moved.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in moved.columns if c not in by])).alias("pools"))
    return attach(good, pools, by).select("*", F.explode("pools").alias("pool")).select(*good.columns, "pool.*")


def fit_bands(table: DataFrame, bands: tuple[Band, ...] = BANDS, least: int = 40) -> DataFrame:
    """One row per group and size of texts that pass the base rules: low_<measure> and high_<measure>, null where unbounded."""
    cell = ["fertility_group", "fertility_size"]
    passed = table.where(~F.col("base_failed"))
    # a text counts once in each of its groups; the measures are its own, so it doesn't matter which of its rows stays
    good = stored(passed.select("text_hash", *cell, *[b.measure for b in bands]).dropDuplicates(["text_hash", "fertility_group"]), "usual")
    # one row per group and size
    counted = good.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = stored(passed.select(*cell).distinct().join(counted, cell, "left").fillna(0, ["n"]), "cells")
    total = cells.groupBy("fertility_group").agg(F.sum("n").alias("total"))
    large = cells.join(total.where(F.col("total") >= least), "fertility_group").drop("total")
    small = cells.join(total.where(F.col("total") < least), "fertility_group").select(*cell)
    sizes = cells.groupBy("fertility_size").agg(F.sum("n").alias("n"))

    # medians over all texts by size, of the nearest size of enough texts. Entropy does not fall
    # as texts grow, and twice the tokens add one bit at most: where no size is near, both
    # limits are taken so that they reject less
    growing = [b.measure for b in bands if b.grows]
    middles = exact_ranks(good, ["fertility_size"], {m: F.col(m) for m in growing}, (0.5,)).where(F.col("n") >= max(1, least // 4))
    middles = middles.select("fertility_size", F.struct(*[F.col(m)[0].alias(m) for m in growing]).alias("usual"))
    away = F.struct(F.abs(F.col("size") - F.col("fertility_size")), "fertility_size")
    usual = sizes.select(F.col("fertility_size").alias("size")).crossJoin(middles).groupBy("size").agg(F.min_by("usual", away).alias("usual"), F.min_by("fertility_size", away).alias("of"))
    short = F.greatest(F.col("of") - F.col("size"), F.lit(0))
    usual = usual.select("size", F.struct(*[(F.col("usual")[m] - short).alias(m) for m in growing]).alias("usual"))
    usual = stored(usual, "medians")

    def quartiles(pools: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
        """Of the texts that ``pools`` gathers, by keys and size."""
        moved = pools.join(usual, "size", "left").join(usual.select(F.col("size").alias("fertility_size"), F.col("usual").alias("own")), "fertility_size", "left")
        moved = moved.select(*by, "size", *[F.coalesce(F.col("usual")[m] - F.col("own")[m], F.lit(0.0)).alias(f"move_{m}") for m in growing])
        value = {b.measure: F.col(b.measure) + F.col(f"move_{b.measure}") if b.grows else F.col(b.measure) for b in bands}
        # a row of ``moved`` for each language, size and pool: a hot size goes through no shuffle of its rows
        return exact_ranks(_pooled(good, moved, by), [*keys, "size"], value, (0.25, 0.5, 0.75)).drop("n").withColumnRenamed("size", "fertility_size")

    own = quartiles(pooled_sizes(large, ["fertility_group"], least), cell, ["fertility_group"])
    # sizes of small groups alone; no text is gathered where every group is large
    wanted = stored(small.select(F.col("fertility_size").alias("size")).distinct(), "sizes")
    fitted = own
    if not wanted.isEmpty():
        fitted = own.unionByName(small.join(quartiles(pooled_sizes(sizes, [], least).join(wanted, "size"), ["fertility_size"], []), "fertility_size"))
    bounds = []
    for b in bands:
        low, middle, high = (F.col(b.measure)[k] for k in range(3))
        scale = F.greatest((high - low) / 1.349, F.lit(b.floor), F.abs(middle) * b.relative)
        bounds.append((F.lit(None).cast("double") if b.below is None else middle - b.below * scale).alias(f"low_{b.measure}"))
        bounds.append((F.lit(None).cast("double") if b.above is None else middle + b.above * scale).alias(f"high_{b.measure}"))
    return fitted.select(*cell, *bounds)


def verdict(bands: tuple[Band, ...] = BANDS) -> Column:
    """True unless the base rules or a band reject."""
    out = [F.coalesce(F.col(b.measure) < F.col(f"low_{b.measure}"), F.lit(False)) | F.coalesce(F.col(b.measure) > F.col(f"high_{b.measure}"), F.lit(False)) for b in bands]
    return ~F.col("base_failed") & ~reduce(lambda x, y: x | y, out)


def judged(rows: DataFrame, piece_model: str, byte_model: str) -> DataFrame:
    """Rows (text, lang, ...) without those two, with BASE, MEASURES, bounds and ``kept``, over a slim table in the shared folder."""
    table = stored(measured(rows, piece_model, byte_model), "fertility")
    # the bands have one row per language and size
    return attach(table, fit_bands(table), ["fertility_group", "fertility_size"]).withColumn("kept", verdict())


def quality(docs: DataFrame, piece_model: str, byte_model: str) -> DataFrame:
    """One row per input row: doc_id, BASE, kept and the measures.

    Null text has no words and fails the base rules, as an empty one does; texts of
    any length are measured whole. Equal texts of one language get equal verdicts,
    and every repeated row its own. A null language is judged by script. An empty
    table gives an empty result; columns other than doc_id, text and lang are
    ignored. ``byte_model`` is read by the library that its suffix names (see
    encode.token_lengths).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    found = judged(rows, piece_model, byte_model)
    columns = [f.split()[0] for f in BASE.split(", ")]
    return found.select("doc_id", *columns, "kept", *[b.measure for b in BANDS])


def keep_good(docs: DataFrame, piece_model: str, byte_model: str) -> DataFrame:
    """The rows that ``quality`` keeps, with all their columns, whatever their names; nulls, empty tables and repeated rows as there."""
    rows = placed(docs)
    text, lang = (F.col(f"in_{docs.columns.index(c)}") for c in ("text", "lang"))
    slim = rows.select("block", "row", text.alias("text"), lang.cast("string").alias("lang"))
    return keep(rows, docs, judged(slim, piece_model, byte_model).where("kept"))
