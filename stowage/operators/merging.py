"""The merge of files to contents in two steps, so that a changed root touches its own contents only.

A partial is what one root knows of a content: its first size and name and its first meta, by position. Contents are the
firsts of their partials by root. Both are kept by a bucket of the key's hash; after a change of some roots, only the keys
that these roots know otherwise than before are merged again, from the buckets that they are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import stem
from .catalog import content_key

BUCKETS = 64


def bucket(key: str = "key", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def partials(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(root_id, key, ord, size, display_name, meta_ord, meta, bucket): a row for each root and content."""
    keyed = files.withColumns({"key": content_key(F.col("sha256"), F.col("fingerprint"), F.col("root_id"), F.col("rel_path")), "shown": F.coalesce("name", stem(F.col("rel_path")))})
    with_meta = F.when(F.col("meta").isNotNull(), F.col("ord"))
    rows = keyed.groupBy("root_id", "key").agg(
        F.min("ord").alias("ord"), F.min_by("size", "ord").alias("size"), F.min_by("shown", "ord").alias("display_name"), F.min(with_meta).alias("meta_ord"), F.min_by("meta", with_meta).alias("meta")
    )
    return rows.withColumn("bucket", bucket(buckets=buckets))


def merged(parts: DataFrame) -> DataFrame:
    """(key, size, display_name, meta, bucket) of partials: what ``catalog.models`` makes of their files."""
    at = F.struct("root_id", "ord")
    has_meta = F.when(F.col("meta_ord").isNotNull(), F.struct("root_id", "meta_ord"))
    return parts.groupBy("key", "bucket").agg(F.min_by("size", at).alias("size"), F.min_by("display_name", at).alias("display_name"), F.min_by("meta", has_meta).alias("meta")).select("key", "size", "display_name", "meta", "bucket")


def changed_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, bucket) of the contents that the partials of some roots differ in."""
    told = lambda d: d.select("key", "bucket", F.xxhash64("root_id", "ord", "size", "display_name", "meta_ord", F.to_json("meta")).alias("print"), F.sha2(F.to_json(F.struct("root_id", "ord", "size", "display_name", "meta_ord", "meta")), 256).alias("sha"))
    one, other = told(before), told(after)
    same = ["key", "bucket", "print", "sha"]
    return one.join(other, same, "left_anti").unionByName(other.join(one, same, "left_anti")).select("key", "bucket").distinct()


def merged_again(contents: DataFrame, parts: DataFrame, touched: DataFrame, buckets: list[int]) -> DataFrame:
    """The contents of ``buckets`` (all that ``touched`` has keys in) after the partials of the touched keys have changed to ``parts``."""
    inside = F.col("bucket").isin(buckets)
    fresh = merged(parts.filter(inside).join(touched.select("key"), "key", "left_semi"))
    return contents.filter(inside).join(touched.select("key"), "key", "left_anti").select(*fresh.columns).unionByName(fresh)
