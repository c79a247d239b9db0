"""The search index against a scan."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stowage.operators import catalog, search

from .conftest import rows


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abAB-_/%. éÉ", k=r.randrange(n)))
    given = [(f"sha256:{r.randrange(16**6):06x}" if i % 4 else f"unknown:r:{i}", word(12), [word(25) for _ in range(r.randrange(3))]) for i in range(150)]
    mods = spark.createDataFrame([(k, n) for k, n, _ in given], "key string, display_name string").dropDuplicates(["key"])
    locs = spark.createDataFrame([(k, p) for k, _, ps in given for p in ps], "key string, rel_path string")
    mods = mods.cache()
    index = search.build(search.texts_of(mods, locs), mods, str(tmp_path / "i"), buckets=8)
    pieces = [p for _, n, ps in given for p in [n, *ps]]
    queries = ["", "a", "éa", "%", "nothing at all", "AB", *(given[i][0][7:10] for i in (1, 2, 3))]
    queries += [t[a : a + r.randrange(1, 9)] for t in r.sample(pieces, 12) if t for a in [r.randrange(len(t))]]
    for q in queries:
        assert rows(index.find(q)) == rows(catalog.find(mods, locs, q).select("key").distinct()), q


def test_a_look_up_reads_the_buckets_of_its_grams(spark, tmp_path):
    mods = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.format_string("model-%05d", "id").alias("display_name")).select(F.concat(F.lit("sha256:"), "h").alias("key"), "display_name")
    locs = mods.select("key", F.concat(F.lit("shelf/"), "display_name").alias("rel_path"))
    index = search.build(search.texts_of(mods, locs), mods, str(tmp_path / "i"), buckets=32)
    assert index.find("l-0123").count() == 10
    plan = index.containing("l-0123")._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "FileScan" in line]
    assert all("PartitionFilters: [bucket" in line and "PushedFilters: [In(gram" in line for line in lines if "gram" in line.split("PartitionFilters")[0])
    assert any("text" in line.split("PartitionFilters")[0] and "dynamicpruning" in line for line in lines)  # texts of the candidates' buckets alone
    first = mods.first()["key"]
    scan = index.beginning(first[7:15])
    assert rows(scan) == [(first,)] and "GreaterThanOrEqual(key" in scan._jdf.queryExecution().executedPlan().toString()
