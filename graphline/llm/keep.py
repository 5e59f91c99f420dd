"""Keeping one row of each class of similar documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.blocks import keep
from graphline.llm.common import stored
from graphline.llm.places import placed


def smallest_of_each(docs: DataFrame, classes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each class the row of the smallest doc_id, and the rows without doc_id, with all their columns, whatever their names.

    ``classes`` gives (doc_id, component_id) for a table (doc_id, text). It is given
    a number for each row that is doc_id or, where several rows have that doc_id, a
    64-bit hash of doc_id and text: different texts are judged apart, and of rows
    that repeat both one stays. Texts aren't shuffled for the decision.
    """
    rows = placed(docs)
    doc_id, text = (F.col(f"in_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    plain = rows.select("block", "row", doc_id.cast("long").alias("doc_id"), text.alias("text"))
    twice = stored(plain.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("twice")), "repeated")
    number = F.col("doc_id")
    if not twice.isEmpty():
        plain = plain.join(twice, "doc_id", "left")
        number = F.when(F.col("twice"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    plain = plain.select("block", "row", "doc_id", number.alias("number"), "text")
    slim = stored(plain.select("block", "row", "doc_id", "number"), "numbered")
    found = classes(plain.select(F.col("number").alias("doc_id"), "text"))
    of = found.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("number"), "component_id").distinct()
    first = slim.join(of, "number").groupBy("component_id").agg(F.min(F.struct("doc_id", "block", "row")).alias("kept"))
    kept = first.select("kept.block", "kept.row").unionByName(slim.where(F.col("doc_id").isNull()).select("block", "row"))
    return keep(rows, docs, kept)
