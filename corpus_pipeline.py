"""A corpus pipeline: language, quality, near duplicates, secrets, packing; each stage is written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``docs``. Cases (nulls, empty and long texts, ties, repeated rows, empty tables, extra columns) are those of
the operators that the stages call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import language_id, minhash, packing, quality, secrets
from stowage.llm.common import documents, materialize, ship
from stowage.llm.tokens import default_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every learned language, go."""
    ship(spark)
    return language_id.identified(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.passing(docs, "v1")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more; the smallest doc_id of a group stays."""
    ship(spark)
    return minhash.deduplicated(docs, w=5, per_cent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    ship(spark)
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: The stages aren't expressible in SQL (tokenization, a learned language model, sketches); tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
