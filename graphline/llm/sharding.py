"""Sharding by sampled splitters.

1. Every row gets a slim record (doc_id, size, crc32, hash, row number) in the shared folder.
2. A size-weighted sample of keys: a row is drawn with a probability in
   proportion to its size (a hash of the row decides, so a retry draws the same).
3. Quantiles of the weighted sample are the boundaries of key ranges; a key that
   fills several quantiles is dealt over them by row number. A key is a doc_id and
   a hash of the text, so only rows that are equal in both share one, and it
   doesn't matter which of them goes where: places don't depend on the files.
4. The exact size of each range is summed; ranges over twice the mean are
   subdivided with splitters of a sample of their own.
5. Running sums, first over the ranges, then within each, place every record on
   the byte axis; the axis is cut into equal shards at record boundaries.

Only samples and one row per range reach the driver, both bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphline.llm.common import documents, stored

OVERHEAD = 8
#: 2**53: hashes are compared as doubles without loss below it.
UNIT = 1 << 53


def shard(docs: DataFrame, shards: int = 24, range_bytes: int = 4 << 20, max_ranges: int = 8192, per_range: int = 24, rounds: int = 3) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the sizes of the shards differ by less than the largest record.
    Rows stand by doc_id, then by a hash of the text, on every layout of the files.
    Null text counts as empty; null doc_id sorts first; repeated rows are placed
    one by one, very long texts by their size alone; an empty table gives an empty result; other columns are ignored.
    ``range_bytes`` is the size that ranges aim at, at most ``max_ranges`` of them;
    the driver holds ``per_range`` sampled keys for each.
    """
    rows = documents(docs, "doc_id", "text")
    slim = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length("text") + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("rid"),
    )
    slim = stored(slim, "slim")
    n, total = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = int(min(max_ranges, max(8 * shards, total // range_bytes)))

    keyed = slim.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    cuts = _splitters(keyed, total, ranges, per_range)
    for _ in range(rounds):
        sizes = _with_range(keyed, cuts).groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * total / ranges).collect()
        fresh = _subdivided(keyed, cuts, {r["range"]: r["bytes"] for r in sizes}, total / ranges, per_range)
        if len(fresh) == len(cuts):
            break
        cuts = fresh
    placed = stored(_with_range(keyed, cuts), "ranges")

    per = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy("key", "hash", "rid")
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    line = (
        placed.withColumn("own_bytes", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumn("own_row", F.row_number().over(inside) - 1)
        # one row per range, at most max_ranges and what subdivision adds
        .join(F.broadcast(base), "range")
        .withColumn("middle", F.col("bytes_before") + F.col("own_bytes") + F.expr("size div 2"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(total))).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("own_row"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    line = stored(line, "placed")
    first = line.groupBy("shard").agg(F.min("row").alias("first"))
    return line.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _sample(keyed: DataFrame, bytes_per_key: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn in proportion to size, sorted, and the bytes that each stands for."""
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(float(bytes_per_key)))
    drawn = F.pmod(F.xxhash64("key", "rid"), F.lit(UNIT)) / F.lit(float(UNIT)) < chance
    got = keyed.where(drawn).select("key", "hash", F.greatest("size", F.lit(float(bytes_per_key))).cast("double").alias("weight")).toPandas()
    keys = _joined(got["key"].to_numpy(np.int64), got["hash"].to_numpy(np.int64))
    order = np.argsort(keys, kind="stable")
    return keys[order], got["weight"].to_numpy(float)[order]


def _joined(key: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Pairs of longs as strings of 16 bytes that sort as the pairs do."""
    pairs = np.empty((len(key), 2), ">u8")
    pairs[:, 0], pairs[:, 1] = key.view(np.uint64) ^ np.uint64(1 << 63), tail.view(np.uint64) ^ np.uint64(1 << 63)
    return pairs.view("S16").reshape(-1)


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    if not len(keys) or parts < 2:
        return np.empty(0, "S16")
    share = np.cumsum(weights) / weights.sum()
    return keys[np.minimum(np.searchsorted(share, np.arange(1, parts) / parts), len(keys) - 1)]


def _splitters(keyed: DataFrame, total: int, ranges: int, per_range: int) -> np.ndarray:
    return _quantiles(*_sample(keyed, total / (ranges * per_range)), ranges)


def _subdivided(keyed: DataFrame, cuts: np.ndarray, overfull: dict[int, int], mean: float, per_range: int) -> np.ndarray:
    """The splitters and, within each overfull range of more than one key, further ones."""
    cuts_in = []
    if overfull:
        again = _with_range(keyed, cuts).where(F.col("range").isin(list(overfull)))
        keys, weights = _sample(again, mean / (2 * per_range))
        at = np.searchsorted(cuts, keys, "right")
        for r, size in overfull.items():
            new = _quantiles(keys[at == r], weights[at == r], int(np.ceil(size / mean)))
            cuts_in.append(new)
    return np.sort(np.concatenate([cuts, *cuts_in])) if cuts_in else cuts


def _with_range(keyed: DataFrame, cuts: np.ndarray) -> DataFrame:
    def place(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, tail, rid in parts:
            k = _joined(key.to_numpy(np.int64), tail.to_numpy(np.int64))
            low, high = np.searchsorted(cuts, k, "left"), np.searchsorted(cuts, k, "right")
            # a key that is several splitters is dealt over the ranges between them
            spread = np.where(high - low > 1, low + 1 + rid.to_numpy(np.int64) % np.maximum(high - low, 1), high)
            yield pd.Series(spread.astype(np.int32))

    return keyed.withColumn("range", F.pandas_udf(place, "int")("key", "hash", "rid"))
