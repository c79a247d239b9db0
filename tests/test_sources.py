"""Stores on disk: scanning, headers, hashes, catalog files and streams."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import subprocess
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stowage.operators import picks
from stowage.operators.health import hub_health
from stowage.sources import documents, headers, scanner, state, walk
from stowage.streaming import hashing, journal

from .conftest import rows


def put(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def header(pairs, version=3):
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    out = struct.pack("<IIQQ", headers.MAGIC, version, 0, len(pairs))
    for key, kind, value in pairs:
        out += text(key) + struct.pack("<I", kind)
        if kind == headers.STRING:
            out += text(value)
        elif kind == headers.ARRAY:
            inner, items = value
            out += struct.pack("<IQ", inner, len(items)) + b"".join(text(i) if inner == headers.STRING else struct.pack("<" + headers.SCALARS[inner], i) for i in items)
        else:
            out += struct.pack("<" + headers.SCALARS[kind], value)
    return out


def test_shelf(spark, tmp_path):
    for f in ("a.gguf", "sub/B.GGUF", "sub/no.txt", ".hidden/x.gguf", "emb/model.safetensors", "emb/tok.json", "emb/deep/c.json"):
        put(tmp_path / f)
    os.symlink("/nowhere", tmp_path / "emb/dead.bin")
    got = {r["rel_path"]: r["accessible"] for r in scanner.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.gguf": True, "sub/B.GGUF": True, "emb/model.safetensors": True, "emb/tok.json": True, "emb/deep/c.json": True, "emb/dead.bin": False}


def test_a_shelf_that_holds_weights_itself(spark, tmp_path):
    for f in ("model.safetensors", "tokenizer.json", "sub/deep/c.json", ".git/x"):
        put(tmp_path / f)
    assert {r["rel_path"] for r in scanner.scan(spark, str(tmp_path)).collect()} == {"model.safetensors", "tokenizer.json", "sub/deep/c.json"}


def test_deep_shelves(spark, tmp_path):
    for f in ("a/b/c/d/m.gguf", "a/x.gguf", "a/b/emb/w.bin", "a/b/emb/s/t.json", "top.gguf", "a/no.json", ".a/b/n.gguf"):
        put(tmp_path / f)
    rows_of = lambda depth: sorted(r["rel_path"] for r in scanner.scan(spark, str(tmp_path), depth=depth).collect())
    assert rows_of(16) == ["a/b/c/d/m.gguf", "a/b/emb/s/t.json", "a/b/emb/w.bin", "a/x.gguf", "top.gguf"]
    assert rows_of(3) == ["a/b/emb/s/t.json", "a/b/emb/w.bin", "a/x.gguf", "top.gguf"] and rows_of(1) == ["a/x.gguf", "top.gguf"]


def test_inventory(spark, tmp_path):
    places = [{"root_id": "r", "kind": "shelf", "rel_path": f"a{i}.gguf", "accessible": i == 0, "dev": 1, "ino": i} for i in range(2)]
    models = {"sha256:aa": {"size": 3, "display_name": "n", "meta": {"architecture": "llama"}, "locations": places}, "sha256:bb": {"size": 4, "display_name": "m", "locations": []}}
    put(tmp_path / "i.json", json.dumps({"schema_version": 1, "generated_unix": 1, "roots": [], "models": models}, indent=1).encode())
    mods, locs = documents.inventory(spark, str(tmp_path / "i.json"))
    assert rows(mods.select("key", "size", "meta.architecture")) == [("sha256:aa", 3, "llama"), ("sha256:bb", 4, None)]
    assert rows(locs.select("key", "ord", "rel_path", "accessible")) == [("sha256:aa", 0, "a0.gguf", True), ("sha256:aa", 1, "a1.gguf", False)]


def test_one_root_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "files")
    documents.save_files(spark.createDataFrame([("a", "x"), ("b", "y")], "root_id string, rel_path string"), path)
    documents.save_files(spark.createDataFrame([("a", "z")], "root_id string, rel_path string"), path)
    saved = spark.read.parquet(path)
    assert rows(saved.select("root_id", "rel_path")) == [("a", "z"), ("b", "y")]
    assert rows(documents.without_root(saved, "a").select("rel_path")) == [("y",)]


def test_incremental_refresh_of_arriving_scans(spark, tmp_path):
    from .test_catalog import files, fp

    known = files(spark, ("r", "same", 1, fp(1, 1, 1), "cafe", True), ("r", "new", 1, fp(1, 1, 2), "beef", True))
    scan = files(spark, ("r", "same", 1, fp(1, 1, 1), None, True), ("r", "new", 1, fp(1, 1, 2, 9), None, True))
    stored = []
    for i in range(2):
        scan.filter(F.col("ord") == i).write.mode("append").parquet(str(tmp_path / "scans"))
        stream = journal.scan_stream(spark, str(tmp_path / "scans"), scan.schema)
        journal.refresh_stream(stream, lambda: known, lambda df, n: stored.extend(rows(df.select("rel_path", "sha256"))), str(tmp_path / "c")).awaitTermination()
    assert stored == [("same", "cafe"), ("new", None)]  # a restart goes on behind what it has seen


def test_the_journal_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "j")
    assert documents.journal(spark, path).count() == 0
    for i in range(4):
        documents.append_journal(spark.createDataFrame([(f"2024-01-0{i + 1}", f"entry {i}.{k}") for k in range(3)], "ts string, line string"), path)
    got = [r["line"] for r in documents.journal(spark, path).orderBy("seq").collect()]
    assert got == [f"entry {i}.{k}" for i in range(4) for k in range(3)]
    assert [r["line"] for r in picks.tail(documents.journal(spark, path), 4).collect()] == got[-4:]


def test_exports_are_whole(spark, tmp_path):
    path = str(tmp_path / "inventory")
    for n in (1, 2):
        documents.save_export(spark.createDataFrame([("k", n)], "key string, n long"), path)
    assert [r["n"] for r in spark.read.json(path).collect()] == [2] and [r["n"] for r in spark.read.json(f"{path}.bak").collect()] == [1]
    assert sorted(os.listdir(tmp_path)) == ["inventory", "inventory.bak"]


def test_config(tmp_path):
    path = str(tmp_path / "c/config.json")
    assert state.read_config(path) == state.Config()
    config = state.Config(shelves=["/a"], discover=False)
    state.save_config(config, path)
    assert state.read_config(path) == config and os.stat(path).st_mode & 0o777 == 0o600
    put(path, b"{broken")
    assert state.config_or_defaults(path) == state.Config()
    with pytest.raises(ValueError):
        state.save_config(config, path)
    state.save_text(path, "new", keep=True)
    assert open(path).read() == "new" and open(f"{path}.bak").read() == "{broken"


def test_roots_keep_their_identity(tmp_path):
    drive, config = tmp_path / "drive", state.Config(shelves=[str(tmp_path / "models")])
    drive.mkdir()
    first = state.register_root(config, str(drive), "Archive")
    assert state.marker(str(drive)) == first["id"] and first["id"].startswith("ext-")
    with pytest.raises(ValueError):
        state.register_root(config, str(drive))
    assert state.register_root(state.Config(roots=[]), str(drive))["id"] == first["id"]
    put(tmp_path / "store/manifests/x")
    os.makedirs(tmp_path / "hf/hub")
    found = state.discover_roots(config, {"OLLAMA_MODELS": str(tmp_path / "store"), "HF_HOME": str(tmp_path / "hf"), "HOME": str(tmp_path)})
    assert [(r["kind"], r["label"]) for r in found] == [("shelf", None), ("ollama", None), ("hf_hub", None), ("removable", "Archive")]
    assert found[0]["root_id"].startswith("shelf-") and found[2]["root_id"].startswith("hf-hub-")


def test_one_writer(tmp_path):
    with state.writer(str(tmp_path)):
        with pytest.raises(state.Locked, match=str(os.getpid())):
            with state.writer(str(tmp_path)):
                pass
    with state.writer(str(tmp_path)):
        pass


def test_hub_and_its_health(spark, tmp_path):
    repo = tmp_path / "models--org--Untidy"
    for b in ("used", "orphan", "dl.incomplete"):
        put(repo / "blobs" / b)
    os.makedirs(repo / "snapshots/rev1")
    os.symlink("../../blobs/used", repo / "snapshots/rev1/model.gguf")
    os.symlink("../../blobs/pruned", repo / "snapshots/rev1/gone.gguf")
    put(repo / "refs/main", b"rev1\n")
    put(repo / "refs/old", b"rev0gone")
    put(tmp_path / "models--org--Hollow/refs/main", b"rev0")
    assert {r["name"] for r in scanner.scan(spark, str(tmp_path), "hf_hub").collect()} == {"org/Untidy"}
    put(repo / "snapshots/rev1/config.json", b"in place, not a link")
    os.symlink("../../blobs/dl.incomplete", repo / "snapshots/rev1/half.gguf")
    assert sorted(r["kind"] for r in hub_health(scanner.scan(spark, str(tmp_path), "links", 3)).collect()) == ["dangling_ref", "dangling_snapshot_link", "incomplete_download", "orphan_blob", "pruned_husk"]


def test_store(spark, tmp_path):
    layers = [{"mediaType": "application/vnd.ollama.image.model", "digest": "sha256:aa", "size": 3}, {"mediaType": "application/vnd.ollama.image.projector", "digest": "sha256:bb", "size": 4}]
    put(tmp_path / "manifests/host/library/vision/latest", json.dumps({"layers": layers}).encode())
    put(tmp_path / "manifests/host/me/other/1b", b"{broken")
    put(tmp_path / "blobs/sha256-aa", b"abc")
    got = rows(scanner.scan(spark, str(tmp_path), "ollama").select("rel_path", "name", "size", "accessible"))
    assert got == [("blobs/sha256-aa", "vision:latest", 3, True), ("blobs/sha256-bb", "vision:latest+projector", 0, False)]
    assert rows(documents.store_manifests(spark, str(tmp_path / "manifests")).select("name")) == [("vision:latest",)]


def test_headers(spark, tmp_path):
    arch = ("general.architecture", 8, "llama")
    put(tmp_path / "a.gguf", header([arch, ("general.name", 8, "Tiny"), ("tokens", 9, (8, ["a", "b", "c"])), ("llama.context_length", 4, 2048), ("general.file_type", 4, 17), ("llama.embedding_length", 4, 4096), ("llama.attention.head_count", 4, 32)]))
    put(tmp_path / "b.gguf", header([arch, ("llama.attention.head_count_kv", 9, (4, [8, 4])), ("general.file_type", 4, 999), ("llama.vision.block_count", 4, 5)]))
    put(tmp_path / "c.gguf", b"none")
    paths = spark.createDataFrame([(str(tmp_path / f),) for f in ("a.gguf", "b.gguf", "c.gguf")], "path string")
    got = {os.path.basename(r["path"]): r.asDict() for r in headers.model_meta(paths).collect()}
    assert set(got) == {"a.gguf", "b.gguf"}
    a, b = got["a.gguf"], got["b.gguf"]
    assert (a["name"], a["context_length"], a["quantization"], a["head_dim"]) == ("Tiny", 2048, "Q5_K_M", 128)
    assert (b["quantization"], b["head_count_kv"], b["block_count"], b["head_dim"]) == ("type 999", None, None, None)


def test_hashes(spark, tmp_path):
    put(tmp_path / "f", b"data")
    got = {os.path.basename(r[0]): r[1] for r in headers.hash_files(spark.createDataFrame([(str(tmp_path / n),) for n in ("f", "gone")], "path string")).collect()}
    assert got == {"f": hashlib.sha256(b"data").hexdigest(), "gone": None}


def test_weights_meta(tmp_path):
    put(tmp_path / "config.json", b'{"model_type": "bert", "max_position_embeddings": 512}')
    assert headers.weights_meta(str(tmp_path / "model.safetensors")) == {"architecture": "bert", "name": None, "context_length": 512}
    put(tmp_path / "sub/config.json", b"{}")
    assert headers.weights_meta(str(tmp_path / "sub/w.bin")) is None


def test_manifests(spark, tmp_path):
    good = {"schema_version": 1, "root": {"id": "r", "kind": "shelf", "path": "/r"}, "generated_unix": 1, "files": [{"rel_path": "m.gguf", "size": 3, "accessible": True}]}
    put(tmp_path / "r.json", json.dumps(good).encode())
    put(tmp_path / "bad.json", b"{nope")
    assert rows(documents.manifests(spark, str(tmp_path)).select("root_id", "rel_path", "size", "sha256")) == [("r", "m.gguf", 3, None)]


def test_a_long_append_has_many_files_in_order(spark, tmp_path):
    path = str(tmp_path / "j")
    for go in range(2):
        lines = spark.range(3000).repartition(6).select(F.lit("2024-01-01 00:00:00").alias("ts"), F.format_string(f"{go} %06d", "id").alias("line")).repartitionByRange(5, "line").sortWithinPartitions("line")
        documents.append_journal(lines, path)
    assert [len([f for f in os.listdir(tmp_path / "j" / d) if f.startswith("part-")]) for d in sorted(os.listdir(path)) if d.startswith("entries")] == [5, 5]
    assert not [d for d in os.listdir(path) if d.startswith("_")]
    assert [r["line"] for r in documents.journal(spark, path).orderBy("seq").collect()] == [f"{go} {i:06d}" for go in range(2) for i in range(3000)]


def test_journal(spark, tmp_path):
    documents.append_journal(spark.createDataFrame([("2024-01-01 00:00:00", "backup a"), ("2024-01-01 00:00:01", "backup b")], "ts string, line string"), str(tmp_path / "j"))
    put(tmp_path / "j/more.txt", b"no tab\n\n")
    want = [("", "no tab"), ("2024-01-01 00:00:00", "backup a"), ("2024-01-01 00:00:01", "backup b")]
    assert rows(documents.journal(spark, str(tmp_path / "j")).select("ts", "line")) == want
    stream = journal.journal_stream(spark, str(tmp_path / "j")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert rows(spark.table("lines")) == want


def test_provenance(spark, tmp_path):
    put(tmp_path / "p.json", json.dumps({"aa": {"tool": "t", "repo": "o/n", "filename": "f", "fetched_unix": 5}}).encode())
    known = documents.provenance(spark, str(tmp_path / "p.json"))
    new = known.withColumns({"repo": F.lit("o/new"), "fetched_unix": F.lit(9).cast("long")})
    assert rows(documents.upsert_provenance(known, new).select("sha256", "repo")) == [("aa", "o/new")]


def test_hub_listing(spark, tmp_path):
    put(tmp_path / "l.json", json.dumps({"siblings": [{"rfilename": "a.gguf", "size": 1}, {"rfilename": "b.txt"}]}).encode())
    assert rows(documents.hub_listing(spark, str(tmp_path / "l.json"))) == [(0, "a.gguf", 1)]


def worklist(spark, folder, n, size=100):
    for i in range(n):
        put(folder / f"r{i % 2}" / f"f{i:03d}", bytes([i % 251]) * (size + i))
    found = []
    for r in ("r0", "r1"):
        rows_ = scanner.scan(spark, str(folder / r), "trash").withColumns({"root_id": F.lit(r), "path": F.concat(F.lit(f"{folder / r}/"), "rel_path")})
        found.append(rows_)
    todo = found[0].unionByName(found[1]).select("root_id", "rel_path", "path", "size", "fingerprint")
    todo.write.mode("overwrite").parquet(str(folder / ".todo"))
    return spark.read.parquet(str(folder / ".todo"))


def test_readers_get_equal_bytes(spark, tmp_path):
    files = spark.createDataFrame([(r, f"{r}{i}", int(1.35**i) + 1) for r in ("a", "b") for i in range(30)], "root_id string, path string, size long")
    for bounded in (True, False):
        dealt = headers.dealt_by_bytes(files, 3, bounded)
        tasks = rows(dealt.withColumn("task", F.spark_partition_id()).groupBy("root_id", "task").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
        assert len(tasks) == 6 and len({t for _, t, _, _ in tasks}) == 6 and {n for *_, n in tasks} == {10}
        assert max(b for *_, b, _ in tasks) < 1.6 * min(b for *_, b, _ in tasks)
    assert headers.dealt_by_bytes(files.limit(0), 3).count() == 0


def test_a_file_that_changes_while_it_is_read_keeps_no_hash(spark, tmp_path):
    put(tmp_path / "f", b"x" * 1000)
    told = []

    def meddle(event, done, total):
        told.append((event, done, total))
        if event == "progress" and done == 400:
            with open(tmp_path / "f", "ab") as f:
                f.write(b"more")

    path, sha, error, gone, done, _ = headers.read_whole(str(tmp_path / "f"), None, meddle, 100, 200)
    assert (sha, error, gone, done) == (None, headers.CHANGED, False, 1004) and told[-1][0] == "failed"
    told.clear()
    row = headers.read_whole(str(tmp_path / "f"), None, lambda *x: told.append(x), 100, 200)
    assert row[1] == hashlib.sha256(b"x" * 1000 + b"more").hexdigest() and [d for e, d, _ in told if e == "progress"] == [200, 400, 600, 800, 1000]
    s = headers.identity(os.stat(tmp_path / "f"))
    assert headers.read_whole(str(tmp_path / "f"), s)[2] is None and headers.read_whole(str(tmp_path / "f"), (s[0], s[1] - 1, *s[2:]))[2] == headers.CHANGED
    stale = spark.createDataFrame([(str(tmp_path / "f"), (1, 2, 3, 4, 5))], f"path string, fingerprint {scanner.FINGERPRINT.replace('decimal(20,0)', 'long')}")
    assert [(r["sha256"], r["error"]) for r in headers.hash_files(stale).collect()] == [(None, headers.CHANGED)]


def test_units_of_a_worklist(spark, tmp_path):
    todo = worklist(spark, tmp_path / "d", 70)
    hashing.write_units(todo, str(tmp_path / "u"), files=16)
    sizes = rows(spark.read.parquet(str(tmp_path / "u")).groupBy("unit").count())
    assert [n for _, n in sizes] == [1, 16, 16, 16, 16, 5]
    hashing.write_units(todo, str(tmp_path / "v"), files=16, size=600)
    assert max(n for _, n in rows(spark.read.parquet(str(tmp_path / "v")).groupBy("unit").count())) <= 6


def test_hashing_goes_on_after_a_lost_run(spark, tmp_path, monkeypatch):
    todo = worklist(spark, tmp_path / "d", 60)
    state, told = str(tmp_path / "state"), str(tmp_path / "told")
    work = str(tmp_path / "work")
    hashing.write_units(todo, work, files=16)
    real = hashing.hash_files
    calls = []

    def dies(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the driver is lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(hashing, "hash_files", dies)
    with pytest.raises(Exception, match="the driver is lost"):
        hashing.hash_stream(spark, work, state, progress=told).awaitTermination()
    half = {r["path"] for r in hashing.hashed(spark, state).collect()}
    assert 17 <= len(half) < 60
    monkeypatch.setattr(hashing, "hash_files", real)
    hashing.hash_stream(spark, work, state, progress=told).awaitTermination()
    want = {(r["root_id"], r["rel_path"]): hashlib.sha256(open(r["path"], "rb").read()).hexdigest() for r in todo.collect()}
    assert {(r["root_id"], r["rel_path"]): r["sha256"] for r in hashing.hashed(spark, state).collect()} == want
    starts = [r["path"] for r in headers.reading_progress(spark, told).filter("event = 'start'").collect()]
    assert len(starts) == 60 == len(set(starts))
    # Another run over what is known reads nothing; one after a change and a loss reads just these.
    put(tmp_path / "d/r0/f000", b"changed")
    os.remove(tmp_path / "d/r1/f001")
    again = worklist_of(spark, todo)
    done = {r["rel_path"]: r for r in hashing.hash_durably(again, state, progress=told).collect()}
    assert done["f000"]["sha256"] == hashlib.sha256(b"changed").hexdigest() and len(done) == 60
    starts = [r["path"] for r in headers.reading_progress(spark, told).filter("event = 'start'").collect()]
    assert len(starts) == 61
    lines = rows(hashing.log_lines(hashing.hashed(spark, state)).select("line"))
    assert ("hashed f000 in 0s",) in lines and len(lines) == 60


def many_roots(spark, folder, roots, n):
    """A worklist of ``n`` files in each root, listed as a scan would."""
    found = []
    for i in range(roots * n):
        path = folder / f"r{i % roots}/f{i:04d}"
        put(path, b"%d" % i * (i % 7))
        s = headers.identity(os.stat(path))
        found.append((f"r{i % roots}", path.name, str(path), s[0], tuple(Decimal(x) if k > 2 else x for k, x in enumerate(s))))
    return spark.createDataFrame(found, hashing.WORK)


def test_a_wave_takes_units_of_all_roots(spark, tmp_path, monkeypatch):
    """Micro-batches grow with a root's files, not with all files; a reader has about a unit, and a root no more readers than it may."""
    todo = many_roots(spark, tmp_path / "d", 6, 50)
    work, real, calls = str(tmp_path / "work"), hashing.hash_files, []
    hashing.write_units(todo, work, files=8, readers=2)
    units = spark.read.parquet(work)
    assert units.count() == 300 and units.select("unit").distinct().count() == 39 and units.groupBy("unit").agg(F.countDistinct("wave").alias("n")).filter("n > 1").count() == 0
    held = units.groupBy("wave", "task").agg(F.countDistinct("root_id").alias("roots"), F.count(F.lit(1)).alias("n"))
    assert held.filter("roots > 1").count() == 0 and held.agg(F.max("n")).first()[0] <= 12
    assert units.groupBy("wave", "root_id").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0] == 2
    # Long files: a root has no second unit in a wave once it has so many bytes.
    hashing.write_units(todo.withColumn("size", F.lit(100).cast("long")), str(tmp_path / "long"), files=8, size=800, readers=4)
    assert spark.read.parquet(str(tmp_path / "long")).groupBy("wave", "root_id").count().agg(F.max("count")).first()[0] <= 16
    monkeypatch.setattr(hashing, "hash_files", lambda *a, **k: calls.append(1) or real(*a, **k))
    done = hashing.hash_durably(todo, str(tmp_path / "state"), readers=2, files=8)
    want = {(r["root_id"], r["rel_path"]): hashlib.sha256(open(r["path"], "rb").read()).hexdigest() for r in todo.collect()}
    assert {(r["root_id"], r["rel_path"]): r["sha256"] for r in done.collect()} == want and done.count() == 300
    assert len(calls) <= 6


def test_what_readers_of_a_lost_wave_have_read_is_kept(spark, tmp_path, monkeypatch):
    todo = many_roots(spark, tmp_path / "d", 6, 40)
    work, state, told, real = str(tmp_path / "work"), str(tmp_path / "state"), str(tmp_path / "told"), hashing.hash_files
    hashing.write_units(todo, work, files=16, readers=2)
    os.remove(tmp_path / "d/r0/f0006")
    last = spark.read.parquet(work).orderBy(F.desc("task"), F.desc("wave")).first()

    def dies(*args, **kwargs):
        out = real(*args, **kwargs)
        return out.withColumn("error", F.when(F.col("path") == last["path"], F.raise_error(F.lit("a reader is lost"))).otherwise(F.col("error")))

    monkeypatch.setattr(hashing, "hash_files", dies)
    with pytest.raises(Exception, match="a reader is lost"):
        hashing.hash_stream(spark, work, state, told).awaitTermination()
    monkeypatch.setattr(hashing, "hash_files", real)
    half = {r["path"] for r in hashing.hashed(spark, state).filter("sha256 IS NOT NULL").collect()}
    whole = spark.read.parquet(work).filter(F.col("wave") == last["wave"])
    kept = {r["path"] for r in whole.collect()} & half
    assert kept and last["path"] not in half
    hashing.hash_stream(spark, work, state, told).awaitTermination()
    done = hashing.hashed(spark, state).collect()
    assert len(done) == 240 and [r["path"] for r in done if r["sha256"] is None] == [str(tmp_path / "d/r0/f0006")]
    starts = [r["path"] for r in headers.reading_progress(spark, told).filter("event = 'start'").collect()]
    assert {p for p in starts if starts.count(p) > 1}.isdisjoint(half)
    # A worklist that was written before the state knew its files reads none of them again.
    hashing.hash_stream(spark, work, state, told, "again-").awaitTermination()
    assert len(headers.reading_progress(spark, told).filter("event = 'start'").collect()) == len(starts)


def worklist_of(spark, todo):
    """The worklist as a scan finds it now; f001 is still listed though it is gone."""
    now = []
    for r in todo.collect():
        d = r.asDict(recursive=True)
        if r["rel_path"] == "f000":
            s = os.stat(r["path"])
            d |= {"size": s.st_size, "fingerprint": dict(zip(("size", "mtime_s", "mtime_nsec", "dev", "ino"), (Decimal(x) if i > 2 else x for i, x in enumerate(headers.identity(s))), strict=True))}
        now.append(d)
    return spark.createDataFrame(now, todo.schema)


def test_bytes_rise_while_a_long_file_is_read(spark, tmp_path):
    """What the readers tell is there before the job ends; a file that can't be read is a row with its error."""
    put(tmp_path / "long", b"\0" * (200 << 20))
    files = spark.createDataFrame([(str(tmp_path / "long"),), (str(tmp_path / "none"),)], "path string")
    got = {os.path.basename(r["path"]): r for r in headers.hash_files(files, progress=str(tmp_path / "told")).collect()}
    assert got["none"]["gone"] and got["none"]["error"] and got["long"]["bytes"] == 200 << 20
    told = rows(headers.reading_progress(spark, str(tmp_path / "told")).filter("path LIKE '%long'").select("done", "event"))
    assert sorted(told) == [(0, "start"), (64 << 20, "progress"), (128 << 20, "progress"), (192 << 20, "progress"), (200 << 20, "done")]
    assert headers.reading_progress(spark, str(tmp_path / "nothing")).count() == 0


def test_an_adaptive_walk_finds_what_a_scan_finds(spark, tmp_path):
    for f in ("top.gguf", "a/b/c/d/e/m.gguf", "a/x.gguf", "a/no.json", ".a/n.gguf", "a/emb/w.bin", "a/emb/s/t.json", "a/emb/s/.h/u.json", "wide/.keep", *(f"wide/{i}/m{k}.gguf" for i in range(30) for k in range(4))):
        put(tmp_path / "s" / f)
    os.symlink("/nowhere", tmp_path / "s/a/emb/dead.bin")
    os.symlink(tmp_path / "s/a/x.gguf", tmp_path / "s/link.gguf")
    for f in ("models--o--n/snapshots/r1/w.safetensors", "models--o--n/snapshots/r1/t/tok.json", "models--o--n/snapshots/r2/q.gguf", "models--o--n/snapshots/r2/readme.md", "models--o--n/refs/main", "models--p--q--r/snapshots/z/m.gguf", "datasets--x/snapshots/r/w.bin"):
        put(tmp_path / "h" / f)
    for f in ("a/m.gguf", ".c/x.json", "deep/1/2/3/n"):
        put(tmp_path / "t" / f)
    os.symlink(tmp_path / "h", tmp_path / "t/linked")
    columns = ["rel_path", "size", "fingerprint", "name", "accessible"]
    for kind, place in (("shelf", "s"), ("hf_hub", "h"), ("trash", "t")):
        for depth in (16, 2):
            want = rows(scanner.scan(spark, str(tmp_path / place), kind, depth).select(*columns))
            assert want
            for entries in (20_000, 7):
                assert rows(walk.walk_store(spark, str(tmp_path / place), kind, depth, entries).select(*columns)) == want
    assert walk.walk_store(spark, str(tmp_path / "none")).count() == 0


def test_a_wide_folder_is_dealt_to_many_tasks(spark, tmp_path):
    for i in range(2000):
        put(tmp_path / f"1/2/{i}/m.gguf")
    seen = []
    real = walk.one_round
    try:
        walk.one_round = lambda frontier, root, parts, entries: seen.append(parts) or real(frontier, root, parts, entries)
        assert walk.walk_store(spark, str(tmp_path), entries=100).count() == 2000
    finally:
        walk.one_round = real
    assert seen[0] == 1 and max(seen) >= 30


def test_a_walk_stops_and_goes_on(tmp_path):
    for i in range(50):
        put(tmp_path / f"d{i % 5}/f{i}.gguf")
    files_, todo = set(), [("gguf", "", 16)]
    for _ in range(100):
        if not todo:
            break
        out = list(walk.walk(str(tmp_path), todo, 3))
        files_ |= {r[3] for r in out if r[3]}
        todo = [r[:3] for r in out if r[3] is None]
    assert len(files_) == 50


def test_probes_of_the_machine(tmp_path):
    put(tmp_path / "bin/hf")
    os.chmod(tmp_path / "bin/hf", 0o755)
    assert state.owner_tools(path=str(tmp_path / "bin")) == {"ollama": False, "hf": True, "huggingface-cli": False}
    told = lambda out: lambda *a, **k: subprocess.CompletedProcess(a, 0, out, "")

    def missing(*a, **k):
        raise FileNotFoundError

    folder = str(tmp_path / "units")
    assert state.timer_state("verify.timer", folder, told("enabled\n")) == "active" and state.timer_state("verify.timer", folder, missing) == "no scheduler"
    assert state.timer_state("verify.timer", folder, told("disabled\n")) == "not installed"
    put(tmp_path / "units/verify.timer")
    assert state.timer_state("verify.timer", folder, told("disabled\n")) == "not enabled"
