"""Searching the labels of a large graph by their trigrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphline.functions.labels import label
from graphline.model import PropertyGraph
from graphline.plans.buckets import bucketed
from graphline.plans.iterate import cut

GRAM, PARTS = 3, 64


def _grams(text: Column) -> Column:
    """Distinct runs of GRAM characters; none in shorter texts."""
    last = F.length(text) - (GRAM - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(GRAM)))
    return F.array_distinct(F.when(last >= 1, every).otherwise(F.array().cast("array<string>")))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


@dataclass
class LabelIndex:
    """postings: (gram, node_id), files kept apart by ``part``, a hash of the gram; labels: (node_id, label), dealt by node."""

    postings: DataFrame
    labels: DataFrame

    @staticmethod
    def of(graph: PropertyGraph) -> LabelIndex:
        """An index of all labels, without regard to case."""
        labels = bucketed(graph.nodes.select("node_id", label().alias("label")), "node_id")
        rows = labels.select("node_id", F.explode(_grams(F.lower("label"))).alias("gram")).withColumn("part", _part(F.col("gram")))
        # a frequent gram is spread over tasks and files by its nodes
        spread = rows.repartition("part", F.pmod(F.xxhash64("node_id"), F.lit(4)))
        return LabelIndex(cut(spread.select("gram", "node_id", "part"), "part"), labels)

    def candidates(self, text: str) -> DataFrame | None:
        """node_id of labels that hold all grams of the text, read from the files of these grams alone; None for a text shorter than a gram."""
        small = text.lower()
        grams = sorted({small[k : k + GRAM] for k in range(len(small) - GRAM + 1)})
        if not grams:
            return None
        spark = self.labels.sparkSession
        parts = sorted({r["p"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_part(F.col("g")).alias("p")).collect()})  # as many as grams
        found = self.postings.where(F.col("part").isin(parts) & F.col("gram").isin(grams))
        return found.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("node_id")

    def search(self, text: str) -> DataFrame:
        """(node_id, label) of the labels that hold the text, whatever the case; an empty text is in all. Candidates are verified; a text shorter than a gram is looked for in all labels."""
        found = self.candidates(text)
        rows = self.labels if found is None else self.labels.join(found, "node_id")
        return rows.where(F.lower("label").contains(text.lower()))


def highlighted(graph: PropertyGraph, index: LabelIndex, text: str) -> PropertyGraph:
    """The nodes whose label holds the text, and the edges between them."""
    return graph.induced(index.search(text))
