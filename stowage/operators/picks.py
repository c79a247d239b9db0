"""Ranked choices that stand alone, and orders with their limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_layers(manifests: DataFrame) -> DataFrame:
    """(name, role, digest, size): of every manifest the first layer whose media type ends in image.model, and in image.projector."""
    layers = manifests.select("name", F.posexplode("layers").alias("at", "layer"))
    media = F.col("layer.mediaType")
    role = F.when(media.endswith("image.model"), "model").when(media.endswith("image.projector"), "projector")
    return layers.withColumn("role", role).filter("role IS NOT NULL").groupBy("name", "role").agg(F.min_by("layer", "at").alias("layer")).select("name", "role", "layer.digest", "layer.size")


def store_models(manifests: DataFrame) -> DataFrame:
    """(display_name, rel_path, size) of a store's manifests: the projector's name has a suffix, a digest's colon becomes a dash in its path."""
    rows = first_layers(manifests)
    shown = F.when(F.col("role") == "projector", F.concat("name", F.lit("+projector"))).otherwise(F.col("name"))
    return rows.select(shown.alias("display_name"), F.concat(F.lit("blobs/"), F.replace("digest", F.lit(":"), F.lit("-"))).alias("rel_path"), "size")


def header_pick(fields: DataFrame, architecture: str, suffix: str) -> DataFrame:
    """Of header fields (file, name, value), <architecture><suffix>, else the first by name of <word><suffix> without another dot."""
    exact = F.col("name") == f"{architecture}{suffix}"
    word = F.col("name").endswith(suffix) & ~F.expr(f"left(name, length(name) - {len(suffix)})").contains(".")
    return fields.filter(exact | word).groupBy("file").agg(F.min_by("value", F.struct(~exact, "name")).alias("value"))


def scan_order(scan: DataFrame) -> DataFrame:
    rank = F.when(F.col("kind") == "ollama", 1).when(F.col("kind") == "hf_hub", 2).otherwise(0)
    return scan.orderBy(rank, F.lower("display_name"), "rel_path")


def trash_order(trash: DataFrame) -> DataFrame:
    """By path, component by component: a, a/b, a-b."""
    return trash.orderBy(F.split("rel_path", "/"), "root_id")


def tail(journal: DataFrame, limit: int = 50) -> DataFrame:
    """The last entries (seq, ts, line), oldest first."""
    return journal.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def backup_preview(mods: DataFrame, members: DataFrame) -> DataFrame:
    """What a backup of ``members`` (key) holds, the largest first."""
    return mods.join(members.select("key"), "key", "left_semi").select("key", "display_name", "size").orderBy(F.desc("size"), "display_name", "key")


def verify_list(checked: DataFrame, status: str) -> DataFrame:
    """Files that a verification found to be ``status``, by path."""
    return checked.filter(F.col("status") == status).select("root_id", "rel_path").orderBy(F.split("rel_path", "/"), "root_id")


def ambiguous(matches: DataFrame, limit: int = 10) -> DataFrame:
    """What a query that should match once names: the first matches by key."""
    return matches.orderBy("key").limit(limit)


def distinct_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values of ``key``, each where it comes first."""
    return rows.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)
