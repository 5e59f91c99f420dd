"""The pipeline against decisions made by hand on what each stage was given."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from llm_cases import base_counts, components, frame, lower
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphline.llm import common, fertility, kneser_ney


def test_pipeline(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(spark).select(columns).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()] if name != "quality_rules" else None
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "pack_sequences":
            assert docs.columns == columns
            kept[name] = sorted(str(r["doc_id"]) for r in rows)
        if name == "quality_rules":
            told = fertility.quality(before, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")).where("kept").collect()
            assert kept[name] == sorted(str(r["doc_id"]) for r in told)
            counts = [base_counts(r["text"]) for r in rows]
            assert all(n >= 10 and 100 * repeated <= 20 * n for n, _, _, _, repeated in counts) and len(rows) >= 80
        elif name == "quality_classifier":
            assert kept[name] == sorted(str(r["doc_id"]) for r in kneser_ney.perplexity(before, labels).where("kept").collect())
        elif name == "exact_dedup":
            groups: dict[str, list] = {}
            for i, t, _ in given:
                groups.setdefault(lower(t), []).append(i)
            assert kept[name] == sorted(str(max((i for i in ids if i is not None), default=None)) for ids in groups.values())
        elif name == "near_dedup":
            label = components(given)
            assert kept[name] == sorted(str(i) for i, *_ in given if i is None or label[i] == i)
            assert sum(60 <= i < 86 for i, *_ in given if i is not None) > sum(60 <= int(i) < 86 for i in kept[name] if i != "None")
        else:
            ids = {i: len(e.ids) + 1 for (i, *_), e in zip(given, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([t for _, t, _ in given], add_special_tokens=False), strict=True)}
            found: dict = {}
            for r in rows:
                found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
            assert found == ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_near_dedup_of_a_repeated_id(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, text("a"), "en"), (1, text("b"), "en"), (2, text("c"), "en"), (3, text("b") + " more", "en"), (None, text("d"), "en")]
    found = corpus_pipeline.near_dedup(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in found) == sorted((str(i), t) for i, t, _ in rows if i != 3)


def test_further_columns_stay(spark, tmp_path):
    """Columns named as the ones that the stages use themselves come through every stage but the last."""
    names = ["block", "row", "in_0", "number", "component_id", "fertility_size"]
    given = frame(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.stored(given, "given")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == given.columns
        for r in docs.where("doc_id IS NOT NULL").collect():
            assert [r[n] for n in names] == [f"{n}-{r['doc_id']}" for n in names]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count() > 40


def test_empty_corpus(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
