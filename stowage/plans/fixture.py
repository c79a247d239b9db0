"""A catalog derived from the test tables, for the queries: documents are files, sources are roots, labels say what is readable."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle as b
from ..operators import catalog as c
from ..sources.scratch import materialize

KINDS = ("shelf", "ollama", "hf_hub", "removable")
NOW = 1_720_000_000
NAMES = ("m-00001-of-00003.gguf", "m-00002-of-00003.gguf", "m-00003-of-00003.gguf", "mmproj-F16.gguf", "other-Q4.gguf", "emb/model.safetensors", "emb/sub/config.json", "notes-Q8.gguf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(index, options):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left")
    d = F.col("doc_id")
    docs = docs.select(
        d,
        "lang",
        F.col("source").alias("root_id"),
        F.sha2("text", 256).alias("h"),
        F.octet_length("text").cast("long").alias("size"),
        F.substring("source", 4, 10).cast("int").alias("s"),
        F.floor(d / 160).alias("g"),
        (F.floor(d / 20) % 8).alias("slot"),
        "toxic",
        "quality",
    )
    name, kind = pick(F.col("slot"), NAMES), pick(F.col("s") % 4, KINDS)
    folder = F.concat("lang", F.lit("/g"), F.col("g").cast("string"), F.lit("/"), name)
    hub = F.concat(F.lit("models--org--"), "lang", F.lit("/snapshots/r"), F.col("g").cast("string"), F.lit("/"), name)
    path = F.when(kind == "ollama", F.concat(F.lit("blobs/sha256-"), F.substring("h", 1, 12))).when(kind == "hf_hub", hub).otherwise(folder)
    shown = F.when(kind == "ollama", F.concat(F.lit("fam"), F.col("g").cast("string"), F.lit(":"), "lang", F.when(F.col("slot") == 3, "+projector").otherwise(""))).when(kind == "hf_hub", F.concat(F.lit("org/"), "lang"))
    u64 = lambda x: x.cast("decimal(20,0)")
    fp = F.struct(F.col("size"), (F.lit(1_700_000_000) + d).alias("mtime_s"), F.lit(0).cast("long").alias("mtime_nsec"), u64(F.col("s") % 3).alias("dev"), u64(d + 1).alias("ino"))
    meta = F.struct(
        pick(d % 3, ("llama", "qwen", "bert")).alias("architecture"), F.when(d % 2 == 0, pick(F.floor(d / 2) % 2, ("7B", "13B"))).alias("size_label"), F.when(d % 5 == 0, F.lit("Q4_K_M")).alias("quantization")
    )
    return docs.select(
        "root_id",
        d.alias("ord"),
        kind.alias("kind"),
        path.alias("rel_path"),
        "size",
        F.when(d % 49 != 0, fp).alias("fingerprint"),
        F.when(d % 7 != 0, F.col("h")).alias("sha256"),
        shown.alias("name"),
        F.when((d % 4 != 3) & ~F.col("slot").isin(3, 6), meta).alias("meta"),
        F.lit(c.READER_VERSION).alias("meta_reader"),
        (F.coalesce("toxic", F.lit(0)) != 1).alias("accessible"),
        F.when(F.col("quality") == 1, F.lit(1_700_000_000) + d * 10_000).alias("verified_unix"),
    )


@dataclass
class Catalog:
    """The tables of one catalog. Root liveness is read once, so that all operators agree on it."""

    files: DataFrame
    roots: DataFrame
    models: DataFrame
    locations: DataFrame
    stated: DataFrame

    @classmethod
    def of(cls, files: DataFrame, roots: DataFrame) -> Catalog:
        locations = c.locations(files.drop("kind"), roots)
        return cls(files, roots, c.models(files), locations, c.with_state(locations, roots))

    @cached_property
    def bundles(self) -> b.Bundles:
        return b.bundles(self.models, self.locations).written()

    def settled(self) -> Catalog:
        """The same catalog with its tables written once, for queries that come back to them."""
        stated = materialize(self.stated, "stated")
        return Catalog(self.files, materialize(self.roots, "roots"), materialize(self.models, "models"), stated.drop("state"), stated)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.substring("source", 4, 10).cast("int")
    return table(spark, sf_dir, "documents").select("source", s.alias("s")).distinct().select(F.col("source").alias("root_id"), pick(F.col("s") % 4, KINDS).alias("kind"), (F.col("s") % 5 != 0).alias("online"), F.when(F.col("s") % 2 == 0, F.concat(F.lit("disk "), "source")).alias("label"), F.concat(F.lit("/mnt/"), "source").alias("path"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.of(files(spark, sf_dir), roots(spark, sf_dir))


def large_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Contents are parts, locations are line items: many locations a content."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    root = F.concat(F.lit("sup"), F.col("l_suppkey").cast("string"))
    kind = pick(F.col("l_suppkey") % 4, KINDS)
    stated = li.select(
        F.concat(F.lit("sha256:"), F.col("l_partkey").cast("string")).alias("key"),
        root.alias("root_id"),
        kind.alias("kind"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("rel_path"),
        F.lit(True).alias("accessible"),
        (F.col("l_suppkey") % 7).alias("dev"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ino"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_suppkey") % 5 == 0, "Offline").otherwise("Present").alias("state"),
    )
    mods = part.select(
        F.concat(F.lit("sha256:"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_name").alias("display_name"),
        F.struct(F.col("p_brand").alias("architecture"), F.col("p_type").alias("size_label"), F.lit(None).cast("string").alias("quantization")).alias("meta"),
    )
    roots_ = stated.select("root_id", "kind", (F.col("state") != "Offline").alias("online")).distinct()
    return Catalog(stated, roots_, mods, stated.drop("state"), stated)
