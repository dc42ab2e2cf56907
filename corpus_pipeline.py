"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage's
result as Parquet to the shared folder and reads it again, so a lost executor costs one stage's tasks at most.

Every stage but the last returns the columns that it was given, extra ones included, and gives an empty table for an
empty one. Null and empty texts go in the first stage (they have no language); where later stages are called on their
own, empty texts are equal texts to near_duplicates and stay as they are elsewhere. Rows without a doc_id are never dropped as near-duplicates and neither serve as nor lose
repeated passages. Rows that share a doc_id stay or go together; repeated rows with a doc_id of their own are
near-duplicates, of which the smallest doc_id stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language_id, packing, pii, simhash_dedup, substring_dedup
from lodestone.llm.common import read_table, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; text without letters or like no learned language goes."""
    return language_id.keep_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each near-duplicate group: SimHash, BK-tree per shard, links verified on shingle sets, components."""
    return simhash_dedup.keep_one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document with a smaller doc_id has."""
    return substring_dedup.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by tags."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: SQL has neither the tokenizer nor the fingerprints; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
