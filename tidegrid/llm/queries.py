"""Queries opN_<name> over the whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import langid, quality
from tidegrid.llm.bpe import encode_documents
from tidegrid.llm.common import read_table
from tidegrid.llm.embeddings import embedding_components
from tidegrid.llm.licenses import scan_documents
from tidegrid.llm.mixing import mix_documents
from tidegrid.llm.sharding import shard_documents
from tidegrid.llm.simhash import simhash_components
from tidegrid.llm.sketches import fingerprint_documents
from tidegrid.llm.warc import archive_pages


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), byte_bpe_path(), with_ids=False)


def op4_warc_dictionary_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn_from_documents(docs))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"))


def op7_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_bpe_encode_decode": op3_bpe_encode_decode,
        "op4_warc_dictionary_writer": op4_warc_dictionary_writer,
        "op5_language_id": op5_language_id,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_sampled_splitter_sharding": op7_sampled_splitter_sharding,
        "op8_source_mixing": op8_source_mixing,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op10_license_scan": op10_license_scan,
    }


OP4_SQL = """WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT *, sha1(body) AS hex, octet_length(body) AS n, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) % 32 + 1 AS INT), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d"""

OP6_SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
links AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN links USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are held against plain versions in the tests."""
    return {"op4_warc_dictionary_writer": OP4_SQL, "op6_embedding_near_dedup": OP6_SQL}
