"""Schemas of the catalog tables."""

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)  # devices and inodes are unsigned 64-bit numbers

FINGERPRINT = T.StructType(
    [T.StructField("size", T.LongType()), T.StructField("mtime_s", T.LongType()), T.StructField("mtime_nsec", T.LongType()), T.StructField("dev", U64), T.StructField("ino", U64)]
)
META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("architecture", "name", "quantization", "size_label")]
    + [T.StructField(n, T.LongType()) for n in ("context_length", "block_count", "embedding_length", "head_count", "head_count_kv", "head_dim")]
)
ROOT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "kind", "path", "label")])
FILE = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("fingerprint", FINGERPRINT),
        T.StructField("sha256", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("meta", META),
        T.StructField("meta_reader", T.IntegerType()),
        T.StructField("accessible", T.BooleanType()),
        T.StructField("verified_unix", T.LongType()),
    ]
)
MANIFEST = T.StructType(
    [T.StructField("schema_version", T.IntegerType()), T.StructField("root", ROOT), T.StructField("generated_unix", T.LongType()), T.StructField("files", T.ArrayType(FILE))]
)
LOCATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("root_id", "kind", "rel_path")] + [T.StructField("accessible", T.BooleanType()), T.StructField("dev", U64), T.StructField("ino", U64)]
)
MODEL = T.StructType([T.StructField("size", T.LongType()), T.StructField("display_name", T.StringType()), T.StructField("meta", META), T.StructField("locations", T.ArrayType(LOCATION))])
INVENTORY = T.StructType(
    [T.StructField("schema_version", T.IntegerType()), T.StructField("generated_unix", T.LongType()), T.StructField("roots", T.ArrayType(ROOT)), T.StructField("models", T.MapType(T.StringType(), MODEL))]
)
PROVENANCE = T.StructType([T.StructField(n, T.StringType()) for n in ("tool", "repo", "filename", "revision", "etag")] + [T.StructField("fetched_unix", T.LongType())])
