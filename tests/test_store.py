"""Versions of a catalog and the incremental merge."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import catalog, merging
from stowage.sources import documents, versions
from stowage.sources.state import Locked, writer
from stowage.store import Store

from .conftest import rows
from .test_catalog import FILES, files, fp, roots


def test_a_reader_sees_whole_commits(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "v"))
    assert v.table("t") is None and v.commit()["number"] == 0
    one = v.put({"t": {"a": spark.range(3), "b": spark.range(10, 12)}})
    before = v.table("t")
    two = v.put({"t": {"b": spark.range(20, 21)}}, one)
    assert rows(before) == [(0,), (1,), (10,), (11,), (2,)] and rows(v.table("t")) == [(0,), (1,), (2,), (20,)]
    assert one["tables"]["t"]["shares"]["a"] == two["tables"]["t"]["shares"]["a"]
    with pytest.raises(versions.Conflict):
        v.put({"t": {"a": spark.range(1)}}, one)
    three = v.put({"t": {"a": None}})
    assert rows(v.table("t")) == [(20,)] and rows(v.table("t", v.commit(1))) == [(0,), (1,), (10,), (11,), (2,)]
    assert v.vacuum(keep=1) == 2 and v.numbers() == [three["number"]] and rows(v.table("t")) == [(20,)]


def test_a_failed_write_leaves_no_trace(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "v"))
    v.put({"t": {"a": spark.range(3)}, "u": {"a": spark.range(1)}})
    kept = {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "v") for f in fs}
    with pytest.raises(Exception, match="no more"):
        v.put({"t": {"a": spark.range(5)}, "u": {"a": spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no more"))).otherwise(F.col("id")).cast("long").alias("id"))}})
    assert {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "v") for f in fs} == kept and rows(v.table("t")) == [(0,), (1,), (2,)]


def some_files(r: random.Random, root: str, n: int) -> list[tuple]:
    meta = lambda: None if r.random() < 0.5 else tuple([r.choice("xyz")] + [None] * 9)
    return [(root, i, f"{r.choice('ab')}/f{i}", r.randrange(1, 4), fp(r.randrange(1, 4), 1, r.randrange(1, 30)) if r.random() < 0.8 else None, f"h{r.randrange(25)}" if r.random() < 0.7 else None, r.choice([None, "n1", "n2"]), meta(), 1, True, None) for i in range(n)]


def test_incremental_merges_equal_full_ones(spark, tmp_path):
    r = random.Random(6)
    known = {f"r{i}": some_files(r, f"r{i}", 25) for i in range(4)}
    store = Store(spark, str(tmp_path / "s"), str(tmp_path / "lock"), buckets=16)
    registered = roots(spark, *((k, "shelf", True) for k in known))
    frame = lambda given: spark.createDataFrame(given, FILES)
    store.save(frame([f for fs in known.values() for f in fs]), registered)
    for step in range(4):
        before = store.versions.commit()
        if step == 0:  # one file more: one content at most is merged again
            known["r2"] = [*known["r2"], ("r2", 99, "new/f", 7, fp(7, 9, 9), "brandnew", None, None, 1, True, None)]
            change = {"r2": frame(known["r2"])}
        elif step == 1:
            known["r1"], known["r4"] = some_files(r, "r1", 20), some_files(r, "r4", 5)
            change = {k: frame(known[k]) for k in ("r1", "r4")}
        elif step == 2:
            del known["r0"]
            change = {"r0": None}
        else:
            change = {"r3": frame(known["r3"])}
        after = store.update(change)
        every = frame([f for fs in known.values() for f in fs])
        assert rows(store.contents().select("key", "size", "display_name", "meta")) == rows(catalog.models(every))
        assert rows(store.load().files.select("root_id", "rel_path", "sha256")) == rows(every.select("root_id", "rel_path", "sha256"))
        same = {b for b, f in after["tables"]["contents"]["shares"].items() if before["tables"]["contents"]["shares"].get(b) == f}
        assert len(same) >= 14 if step == 0 else same == set(after["tables"]["contents"]["shares"]) if step == 3 else True
    plan = merging.merged_again(store.contents(), store.versions.table("partials"), spark.createDataFrame([("k", 3)], "key string, bucket int"), [3])
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in text.split("\n") if "PartitionFilters" in line]
    assert len(filters) == 2 and all("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)


def test_refresh_commits_what_is_there(spark, tmp_path):
    put = lambda name, data: (os.makedirs((tmp_path / name).parent, exist_ok=True), (tmp_path / name).write_bytes(data))
    for name, data in (("shelf/a/m.gguf", b"one"), ("shelf/b.gguf", b"two"), ("drive/a/m.gguf", b"one")):
        put(name, data)
    known = [{"root_id": "s", "kind": "shelf", "path": str(tmp_path / "shelf")}, {"root_id": "d", "kind": "removable", "path": str(tmp_path / "drive")}]
    store, journal = Store(spark, str(tmp_path / "store"), str(tmp_path / "lock")), str(tmp_path / "journal")
    store.refresh(known, str(tmp_path / "state"), journal)
    assert store.contents().count() == 2 and store.load().status()["headline"].first()["backed_up"] == 1
    assert {r["line"] for r in documents.journal(spark, journal).collect()} == {"hashed a/m.gguf in 0s", "hashed b.gguf in 0s"}
    put("shelf/b.gguf", b"three")
    os.rename(tmp_path / "drive", tmp_path / "away")
    before = store.versions.commit()
    after = store.refresh(known, str(tmp_path / "state"), journal)
    assert after["tables"]["files"]["shares"]["d"] == before["tables"]["files"]["shares"]["d"]
    got = {(r["root_id"], r["rel_path"]): r["sha256"] for r in store.load().files.collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("s", "a/m.gguf"): sha(b"one"), ("s", "b.gguf"): sha(b"three"), ("d", "a/m.gguf"): sha(b"one")}
    assert documents.journal(spark, journal).count() == 4 and not store.load().roots.filter("root_id = 'd'").first()["online"]
    with pytest.raises(versions.Conflict):
        store.update({"s": None}, based_on=before)


def test_provenance_is_kept_by_prefix(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), str(tmp_path / "lock"))
    told = lambda *given: spark.createDataFrame(given, "sha256 string, tool string, fetched_unix long")
    one = store.record(told(("aa", "t1", 5), ("b1", "t1", 5)))
    two = store.record(told(("aa", "t2", 9), ("ab", "t3", 1)))
    assert rows(store.provenance()) == [("aa", "t2", 9), ("ab", "t3", 1), ("b1", "t1", 5)]
    assert one["tables"]["provenance"]["shares"]["b"] == two["tables"]["provenance"]["shares"]["b"]


def test_one_writer_at_a_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), str(tmp_path / "lock"))
    assert store.load() is None
    with writer(str(tmp_path / "lock")), pytest.raises(Locked):
        store.save(files(spark), roots(spark))
    store.save(files(spark, ("r", "a.gguf", 3, fp(3, 1, 1), "x", True)), roots(spark, ("r", "shelf", True)))
    assert store.load().status()["headline"].first()["contents"] == 1 and store.contents().count() == 1
