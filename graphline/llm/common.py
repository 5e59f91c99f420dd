"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphline.plans.iterate import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/graphline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage, and a lost executor costs only the tasks that it ran.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Rows of the queries run inside go to Python in batches of about ``size``: Spark's 64 MB are held by the executor and by the worker, for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash; null text is empty."""
    picked = [F.coalesce(F.col("text"), F.lit("")).alias("text") if c == "text" else F.col(c) for c in columns]
    return docs.select(*picked)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uri(path: str) -> str:
    """``path`` with a scheme, as pyarrow.fs wants it."""
    return path if "://" in path else "file://" + path


def attach(rows: DataFrame, small: DataFrame, keys: list[str], most_rows: int = 100_000, most_bytes: int = 8 << 20, salts: int = 64) -> DataFrame:
    """``rows`` left join ``small`` on ``keys``, of which ``small`` has each once.

    ``small`` is measured: up to ``most_rows`` rows with ``most_bytes`` of text in
    the keys it is broadcast. Beyond that it is repeated for each of ``salts``
    salts, over which the rows of a hot key are spread. Both give the same rows.
    """
    small = stored(small, "small")
    text = [F.octet_length(F.col(k).cast("string")) for k in keys]
    size = small.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(f"b{i}") for i, t in enumerate(text)]).first()
    if size["n"] <= most_rows and sum(size[1:]) <= most_bytes:
        return rows.join(F.broadcast(small), keys, "left")
    each = small.withColumn("attach_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    return rows.withColumn("attach_salt", salt).join(each.hint("merge"), [*keys, "attach_salt"], "left").drop("attach_salt")


#: No more than HOT keys can have as many rows as the total divided by HOT.
HOT, HOT_ROWS = 4096, 4096


def by_key(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` inner join ``found``, which has each ``key`` once and in ``records`` how many of the ``total`` rows have it.

    The keys of many rows are at most HOT, so they are broadcast to their rows; a
    shuffle would bring all rows of such a key to one task. The others are shuffled.
    """
    hot = F.col("records") >= max(HOT_ROWS, total // HOT)
    many = rows.join(F.broadcast(found.where(hot)), key)
    few = rows.join(F.broadcast(found.where(hot).select(key)), key, "left_anti").join(found.where(~hot).hint("merge"), key)
    return many.unionByName(few)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers has a vocabulary; every node has it installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
