"""Catalog files: manifests, inventory, provenance, journal and hub listings, read and written."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .scratch import on_storage
from .state import CARRIED


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Files of all readable manifests under ``path``: root_id, kind, ord and the columns of a file; a broken manifest is left out."""
    raw = spark.read.schema(schema.MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    each = raw.filter("root.id IS NOT NULL").select(F.col("root.id").alias("root_id"), F.col("root.kind").alias("kind"), F.posexplode("files").alias("ord", "f"))
    return each.select("root_id", "kind", "f.*", F.col("ord").cast("long").alias("ord"))


def carried(spark: SparkSession, roots: Sequence[dict[str, str]]) -> DataFrame:
    """Files of the manifests that owned roots carry themselves, under the roots' own ids; a root without one has no rows."""
    out = None
    for r in roots:
        path = f"{r['path'].rstrip('/')}/{CARRIED}"
        fs, make = on_storage(path)
        if r["kind"] in ("shelf", "removable") and fs.exists(make(path)):
            rows = manifests(spark, path).withColumns({"root_id": F.lit(r["root_id"]), "kind": F.lit(r["kind"])})
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField("root_id", T.StringType()), T.StructField("kind", T.StringType()), *schema.FILE.fields, T.StructField("ord", T.LongType())]))


def manifest_roots(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schema.MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.filter("root.id IS NOT NULL").select(F.col("root.id").alias("root_id"), "root.kind", "root.path", "root.label").orderBy("root_id")


def inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, locations) of a merged inventory."""
    raw = spark.read.schema(schema.INVENTORY).option("multiLine", True).json(path).select(F.explode("models").alias("key", "m"))
    return raw.select("key", "m.size", "m.display_name", "m.meta"), raw.select("key", F.posexplode("m.locations").alias("ord", "l")).select("key", "l.*", F.col("ord").cast("long").alias("ord"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), schema.PROVENANCE))).alias("sha256", "p")).select("sha256", "p.*")


def upsert_provenance(known: DataFrame, new: DataFrame) -> DataFrame:
    """The latest record of each hash."""
    both = known.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    rest = [c for c in known.columns if c != "sha256"]
    return both.groupBy("sha256").agg(F.max_by(F.struct(*rest), F.struct("fresh", "fetched_unix")).alias("p")).select("sha256", "p.*")


def journal_lines(lines: DataFrame) -> DataFrame:
    """(ts, line) of text lines (value): split at the first tab; without one the time is empty; blank lines go."""
    parts = F.split("value", "\t", 2)
    tabbed = F.col("value").contains("\t")
    return lines.filter(F.trim("value") != "").select(*[c for c in lines.columns if c != "value"], F.when(tabbed, parts[0]).otherwise("").alias("ts"), F.when(tabbed, parts[1]).otherwise(F.col("value")).alias("line"))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ts, line): entries in the order of their appending; seq is the time of the append, the file within it and the place in that. No journal is an empty one."""
    fs, make = on_storage(path)
    if not fs.exists(make(path)):
        return spark.createDataFrame([], "seq struct<at: long, file: string, block: long, row: long>, ts string, line string")
    m = F.col("_metadata")
    own = F.regexp_extract(m["file_path"], r"/entries-(\d{20})[^/]*(?:/[^/]*)?$", 1).try_cast("long")
    at = F.coalesce(own, F.unix_micros(m["file_modification_time"]) * 1000)
    seq = F.struct(at.alias("at"), m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    return journal_lines(spark.read.option("recursiveFileLookup", True).text(path).withColumn("seq", seq))


def append_journal(entries: DataFrame, path: str) -> None:
    """Append (ts, line) in their order: a file for each partition, in a folder that is put in place when all of them are written.

    The folder's name has the time of the append, so that later ones sort behind it; files sort by their partition's number.
    """
    fs, make = on_storage(path)
    part = f"{path.rstrip('/')}/_{uuid.uuid4().hex}"
    entries.select(F.concat_ws("\t", "ts", "line").alias("value")).write.text(part)
    for status in fs.globStatus(make(f"{part}/_*")) or []:
        fs.delete(status.getPath(), True)
    fs.rename(make(part), make(f"{path.rstrip('/')}/entries-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"))


def hub_listing(spark: SparkSession, path: str, gguf_only: bool = True) -> DataFrame:
    """(ord, filename, size) of a saved hub answer."""
    raw = spark.read.schema("siblings array<struct<rfilename string, size long>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("siblings").alias("ord", "s")).select(F.col("ord").cast("long").alias("ord"), F.col("s.rfilename").alias("filename"), "s.size")
    return rows.filter(F.lower("filename").endswith(".gguf")) if gguf_only else rows


def store_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(name, layers) of the manifests of an ollama store, from the last four parts of their paths."""
    raw = spark.read.schema("layers array<struct<mediaType string, digest string, size long>>").option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    p = F.split(F.input_file_name(), "/")
    space, model, tag = (F.element_at(p, i) for i in (-3, -2, -1))
    name = F.concat(F.when(space == "library", F.lit("")).otherwise(F.concat(space, F.lit("/"))), model, F.lit(":"), tag)
    return raw.filter("layers IS NOT NULL").select(name.alias("name"), "layers")


def save_files(files: DataFrame, path: str) -> None:
    """The catalog's files, a folder for each root, so that one root is replaced or dropped without touching others."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root_id").parquet(path)


def save_export(rows: DataFrame, path: str) -> None:
    """Rows (key, json) as lines of JSON, whole or not at all; what was there before stays beside it as .bak."""
    fs, make = on_storage(path)
    part, before = f"{path}.{uuid.uuid4().hex[:8]}.tmp", f"{path}.bak"
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(part)
    if fs.exists(make(path)):
        fs.delete(make(before), True)
        fs.rename(make(path), make(before))
    fs.rename(make(part), make(path))


def without_root(rows: DataFrame, root_id: str) -> DataFrame:
    return rows.filter(F.col("root_id") != root_id)
