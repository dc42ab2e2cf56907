"""The driver's queries for the corpus operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe, fingerprints, html_text, language_id, packing, pii, sharding, simhash_dedup, substring_dedup, vptree
from lodestone.llm.common import read_table


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest_query(read_table(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_query(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_query(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(read_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.dedup_query(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_vptree,
        op2_packing,
        op3_substring_dedup,
        op4_fingerprints,
        op5_simhash_dedup,
        op6_language_id,
        op7_byte_bpe,
        op8_pii,
        op9_sharding,
        op10_html_text,
    )
    return {f.__name__: f for f in found}


#: The contract of substring dedup, window by window.
SUBSTRING_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM docs)
),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
late AS (SELECT doc_id, s FROM windows JOIN firsts USING (h) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM late, range(0, 50) AS r(k)),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
kept AS (
  SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS text
  FROM placed p LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The other results hold hashes, checksums or model outputs that SQL lacks; ``tests/llm`` has brute-force versions."""
    return {"op3_substring_dedup": SUBSTRING_DEDUP_SQL}
