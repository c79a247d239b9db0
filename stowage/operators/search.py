"""An index for searching contents by a part of a name or path, or by the beginning of a hash.

Every text (a name, a path) is a unit; its grams of one, two and three characters point to it. A query is looked up by its own
grams of three (a shorter query is a gram itself): the units that have all of them are candidates, and their texts, with
``contains``, decide. Grams and texts lie in buckets by hash, as folders, so a look-up reads the buckets of its grams and
candidates; hashes lie in the order of their keys, so a prefix is a range. A folder is written once; a changed catalog gets a new one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 64


def bucket_of(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def grams(text: Column) -> Column:
    """The distinct grams of up to GRAM characters."""
    n = F.length(text)
    of = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(size) for size in range(1, GRAM + 1)]))


def texts_of(mods: DataFrame, locs: DataFrame) -> DataFrame:
    """(key, text): what a search for contents looks at, in lower case."""
    names = mods.select("key", F.lower("display_name").alias("text"))
    return names.unionByName(locs.select("key", F.lower("rel_path").alias("text"))).filter("text IS NOT NULL").distinct()


def build(texts: DataFrame, keys: DataFrame, path: str, buckets: int = BUCKETS) -> SearchIndex:
    """Write the index of ``texts`` (key, text) and ``keys`` (key) to the folder ``path``."""
    units = texts.select(F.xxhash64("key", "text").alias("unit"), "key", "text")
    placed = units.withColumn("bucket", bucket_of(F.col("unit"), buckets))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/texts")
    postings = units.select("unit", F.explode(grams(F.col("text"))).alias("gram")).withColumn("bucket", bucket_of(F.col("gram"), buckets))
    # A frequent gram is in as many ranges as it needs; within a bucket, files are sorted, so that a gram is found by its range.
    postings.repartitionByRange("bucket", "gram", "unit").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/keys")
    return SearchIndex(texts.sparkSession, path, buckets)


@dataclass
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def table(self, name: str) -> DataFrame:
        schema = {"texts": "unit long, key string, text string, bucket int", "postings": "unit long, gram string, bucket int", "keys": "key string"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def containing(self, query: str) -> DataFrame:
        """(key): contents with a text that contains the query, in lower case."""
        if not query:
            return self.table("texts").select("key").distinct()
        wanted = sorted({query[i : i + GRAM] for i in range(max(1, len(query) - GRAM + 1))})
        places = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(bucket_of(F.col("gram"), self.buckets)).distinct().collect()]  # as long as the query
        hits = self.table("postings").filter(F.col("bucket").isin(places) & F.col("gram").isin(wanted))
        found = hits.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(wanted))  # units of equal number are told apart by their texts
        candidates = found.select("unit", bucket_of(F.col("unit"), self.buckets).alias("bucket"))
        return self.table("texts").join(candidates, ["bucket", "unit"], "left_semi").filter(F.col("text").contains(query)).select("key").distinct()

    def beginning(self, prefix: str) -> DataFrame:
        """(key): contents whose hash begins with the prefix."""
        first = f"sha256:{prefix}"
        return self.table("keys").filter((F.col("key") >= first) & F.col("key").startswith(first))

    def find(self, query: str) -> DataFrame:
        """(key): what ``catalog.find`` finds."""
        q = query.lower()
        if not q:
            return self.table("keys")
        return self.containing(q).unionByName(self.beginning(q)).distinct()
