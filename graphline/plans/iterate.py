"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a session that is one process gets a temporary one, and any other an error.

    Only there are driver and executors one process and its folders shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, *folders: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: the plan ends there, and losing an executor loses no result.

    ``folders`` are columns by whose values the files are kept apart, so that a condition on them reads those files alone.
    """
    path = f"{shared_folder(df.sparkSession)}/graphline/iterate-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*folders) if folders else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` as ``cut`` gives it, and aggregates of its rows that are taken while they are written: a loop asks them instead of reading the table again."""
    seen = Observation()
    table = cut(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return table, seen.get
