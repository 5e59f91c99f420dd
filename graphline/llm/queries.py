"""The queries of this package: (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphline.llm import bpe, centroids, conversation_repair, fertility, jaccard, kneser_ney, lsm_dedup, packing, secret_tags, sharding, token_counts, token_store, warc
from graphline.llm.common import read_table, tokenizer_path


def op1_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op9_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op11_secret_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_tags.report(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(read_table(spark, sf_dir, "conversations")))


def op13_elkan_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_directly_addressable_codes": op1_directly_addressable_codes,
    "op2_fertility_rules": op2_fertility_rules,
    "op3_sampled_splitters": op3_sampled_splitters,
    "op4_token_counts": op4_token_counts,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_shortest_pack_first": op6_shortest_pack_first,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_warc_capture_index": op8_warc_capture_index,
    "op9_pair_index_bpe": op9_pair_index_bpe,
    "op10_lsm_dedup": op10_lsm_dedup,
    "op11_secret_tags": op11_secret_tags,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_elkan_centroids": op13_elkan_centroids,
}

OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""



def _centroids_sql(rounds: int = 3) -> str:
    """Lloyd's rounds as a chain of tables, every distance calculated."""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h
  FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) AS INTEGER) - 1 AS c, v FROM (SELECT h, v FROM kept ORDER BY h, v LIMIT 16))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT k.n, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)]), 'c': c.c}}) AS best
  FROM (SELECT *, row_number() OVER () AS n FROM kept) k, c{r} c GROUP BY k.n)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
  SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS d(i) GROUP BY best.c, i))""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{r} GROUP BY c) w ON o.c = w.c)")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.best.c AS cluster, CAST(a.best.d AS BIGINT) AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.c
"""


ORACLE_SQL: dict[str, str] = {"op13_elkan_centroids": _centroids_sql(), "op8_warc_capture_index": OP8_SQL, "op10_lsm_dedup": OP10_SQL}
