"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitplanes, bpe, cross_polytope, language_id, merkle, minhash, packing, quality, secrets, sharding, tiff, token_counts, vector_codes
from .common import documents, materialize
from .tokens import default_path


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 16)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), default_path("word_bpe_49k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest_documents(documents(spark, sf_dir), default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of the policy rejects, and what it alone, from the stored ledger."""
    return quality.ablations(quality.stored_ledger(documents(spark, sf_dir)), "v1")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir), w=3, per_cent=85)


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest_of(materialize(tiff.store_texts(documents(spark, sf_dir)), "media"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(documents(spark, sf_dir))


def op10_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(embeddings(spark, sf_dir))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.linked(embeddings(spark, sf_dir), 0.9)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash": op6_minhash,
    "op7_tiff": op7_tiff,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_bit_planes": op10_bit_planes,
    "op11_vector_codes": op11_vector_codes,
    "op12_cross_polytope": op12_cross_polytope,
    "op13_merkle": op13_merkle,
    "quality_ablations": quality_ablations,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": quality.SQL,
    "op6_minhash": minhash.SQL,
    "op11_vector_codes": vector_codes.sql(),
    "op12_cross_polytope": cross_polytope.SQL,
    "op13_merkle": merkle.sql(),
    "quality_ablations": quality.ABLATION_SQL,
}
