"""A corpus pipeline: quality rules, perplexity filter, exact dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``, whatever further columns these have; the last returns the
pieces of packed sequences. An empty table goes through every stage as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphline.llm import fertility, jaccard, kneser_ney, lsm_dedup, packing
from graphline.llm.common import read_table, stored, tokenizer_path
from graphline.llm.keep import smallest_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep.

    Null and empty texts have no words and go. Equal texts of a language share
    their verdict, repeated rows included; a null language is judged by script.
    Whole texts count, however long.
    """
    return fertility.keep_good(docs, tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.tiktoken"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language.

    Null and empty texts stay, as do all where no trusted text is left; repeated
    rows are judged one by one, and a null language by the limit over all.
    """
    return kneser_ney.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id.

    Null text equals empty text, a null doc_id loses against any other, and of
    rows that repeat doc_id and text one stays.
    """
    return lsm_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id.

    Null, empty and wordless texts are near to nothing and stay, as do rows without
    doc_id. Different texts of one doc_id are judged apart; of rows that repeat
    both one stays.
    """
    return smallest_of_each(docs, jaccard.near_duplicates)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 4096 tokens.

    Null and empty texts are the end id alone; every row is packed, repeated ones
    and those without doc_id too; a text longer than a sequence is cut into pieces.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pack_sequences", pack_sequences),
]

#: Tokenisers, language models and near-duplicates aren't SQL: the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
