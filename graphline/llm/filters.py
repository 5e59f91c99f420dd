"""Bloom filters as small tables, in DataFrame operations only.

A filter has WORDS words of 64 bits; a key sets four bits of one word. However
many keys it holds it has at most WORDS rows, which is what makes its broadcast
safe: rows are tested where they are read. A filter that holds very many keys
lets more rows pass, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18


def _word(key: Column) -> Column:
    return F.pmod(key, F.lit(WORDS))


def _mask(key: Column) -> Column:
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, at).bitwiseAND(F.lit(63)).cast("int"))
    return bit(18).bitwiseOR(bit(26)).bitwiseOR(bit(34)).bitwiseOR(bit(42))


def bloom(rows: DataFrame, key: Column) -> DataFrame:
    """The filter (filter_word, filter_bits) of a 64-bit hash ``key`` of ``rows``."""
    keys = rows.select(key.alias("key"))
    return keys.groupBy(_word(F.col("key")).alias("filter_word")).agg(F.bit_or(_mask(F.col("key"))).alias("filter_bits"))


def tested(rows: DataFrame, key: Column, words: DataFrame) -> DataFrame:
    """``rows`` with ``filter_hit``: false only where the key isn't one of the filter's."""
    found = rows.withColumn("filter_key", key).withColumn("filter_word", _word(F.col("filter_key")))
    found = found.join(F.broadcast(words), "filter_word", "left")  # at most WORDS rows
    mask = _mask(F.col("filter_key"))
    hit = F.coalesce(F.col("filter_bits").bitwiseAND(mask) == mask, F.lit(False))
    return found.withColumn("filter_hit", hit).drop("filter_key", "filter_word", "filter_bits")


def passing(rows: DataFrame, key: Column, words: DataFrame) -> DataFrame:
    """The rows that the filter lets pass."""
    return tested(rows, key, words).where("filter_hit").drop("filter_hit")
