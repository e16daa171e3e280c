"""Registered queries of this subpackage; each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, licenses, lm, mtree, neardup, negatives, packing, pii, quality, secrets, warc, zonemaps


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_elias_fano_trie(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score_table(spark, sf)


def op2_quality_trees(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify_table(spark, sf)


def op3_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal_data(spark.read.parquet(f"{sf}/documents.parquet"))


def op4_warc_members(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.archive_pages(spark, spark.read.parquet(f"{sf}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
     k AS (SELECT digest, max(page_id) AS kept FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN n >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND kept <> page_id THEN kept END AS refers_to
FROM d LEFT JOIN k ON k.digest = d.digest AND d.n >= 1000
"""


def op5_block_max_wand(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op6_license_bands(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))


def op7_dart_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.classes(spark.read.parquet(f"{sf}/documents.parquet"))


def op8_window_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_report(spark.read.parquet(f"{sf}/documents.parquet"))


def op9_mtree_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return mtree.search_table(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer_path())


def op11_fagin_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.mine_table(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
           FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_offset_masks(spark: SparkSession, sf: str) -> DataFrame:
    return chat.format_table(spark.read.parquet(f"{sf}/conversations.parquet"), tokenizer_path())


def op13_zone_maps(spark: SparkSession, sf: str) -> DataFrame:
    return zonemaps.cluster_table(spark.read.parquet(f"{sf}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_elias_fano_trie, op2_quality_trees, op3_weak_supervision, op4_warc_members, op5_block_max_wand, op6_license_bands, op7_dart_minhash,
        op8_window_entropy, op9_mtree_top_k, op10_best_fit_packing, op11_fagin_threshold, op12_offset_masks, op13_zone_maps)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_members": OP4_SQL, "op9_mtree_top_k": OP9_SQL, "op11_fagin_threshold": OP11_SQL, "op12_offset_masks": chat.SQL,
            "op13_zone_maps": zonemaps.kmeans_sql()}
