"""The commands, end to end over files on disk."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from stowage import api
from stowage.sources import documents, headers
from stowage.sources.state import CARRIED, TRASH

from .conftest import rows
from .test_catalog import FILES
from .test_sources import header, put


@pytest.fixture
def engine(spark, tmp_path):
    for root, name, data in (("shelf", "a/big-Q4.gguf", b"one"), ("shelf", "a/mmproj-F16.gguf", b"two"), ("shelf", "a/big-Q8.gguf", b"three"), ("drive", "a/big-Q4.gguf", b"one"), ("shelf", "copy.gguf", b"one")):
        os.makedirs((tmp_path / root / name).parent, exist_ok=True)
        (tmp_path / root / name).write_bytes(data)
    known = [{"root_id": "shelf", "kind": "shelf", "path": str(tmp_path / "shelf")}, {"root_id": "drive", "kind": "removable", "path": str(tmp_path / "drive")}, {"root_id": "gone", "kind": "removable", "path": str(tmp_path / "none")}]
    roots = api.register(spark, known)
    files = api.refresh(api.scan_roots(spark, known), spark.createDataFrame([], FILES), roots)
    files.write.parquet(str(tmp_path / "files"))
    return api.Engine(spark.read.parquet(str(tmp_path / "files")), roots), tmp_path, known


def test_commands(spark, engine):
    e, path, known = engine
    head = e.status()["headline"].first()
    assert (head["contents"], head["hashed"], head["backed_up"], head["dup_groups"]) == (3, 3, 1, 1)
    assert [r["reclaimable"] for r in e.dups().collect()] == [6]
    assert {r["action"] for r in e.dedup().collect()} == {"survivor", "link"}
    plan = rows(e.delete(["big-q8"]).select("rel_path", "action", "detail"))
    assert plan == [("", "keep", "big-Q4"), ("a/big-Q8.gguf", "trash", None)]
    with pytest.raises(api.Ambiguous) as several:
        e.delete(["big"])
    assert len(several.value.matches) == 2
    assert dict(rows(e.backup("drive").groupBy("status").count())) == {"copy": 2, "skipped_already": 1}
    assert e.restore(["big-q4"]).filter("status = 'already on shelf'").count() >= 1
    (path / "shelf/copy.gguf").write_bytes(b"ONE")
    (path / "shelf/a/big-Q8.gguf").unlink()
    checked = e.verify(777, repair=True)
    assert dict(rows(checked["files"].filter("status <> 'ok'").select("rel_path", "status"))) == {"copy.gguf": "mismatched", "a/big-Q8.gguf": "missing"}
    assert rows(checked["repair"].select("rel_path", "status", "source_root")) == [("a/big-Q8.gguf", "unrepairable", None), ("copy.gguf", "repair", "drive")]


    assert {(r["rel_path"], r["root_id"]) for r in checked["written"].filter("verified_unix = 777").collect()} == {("a/big-Q4.gguf", "drive"), ("a/big-Q4.gguf", "shelf"), ("a/mmproj-F16.gguf", "shelf")}
    assert rows(checked["offline"]) == [("gone",)] and rows(checked["mismatched"]) == [("shelf", "copy.gguf")]
    assert checked["files"].count() == 5 and e.verify(777, "drive")["files"].count() == 1
    with pytest.raises(ValueError, match="names no root"):
        e.verify(777, "nothing")


def test_every_command_as_json(spark, engine):
    import json

    e, path, known = engine
    provenance = spark.createDataFrame([], "sha256 string, repo string")
    given = [e.status(), e.dups(), e.report(), e.doctor(1_800_000_000), e.where("copy", provenance), e.impact("shelf"), e.dedup(), e.inventory(), e.delete_preview(["big-q8"]), e.backup("drive"), api.trash_scan(spark, known)]
    for found in given:
        lines = api.as_json(found).collect()
        parts = found if isinstance(found, dict) else {"": found}
        for name, rows_ in parts.items():
            got = [json.loads(r["json"]) for r in lines if r["part"] == name]
            assert len(got) == rows_.count() and all(set(g) == set(rows_.columns) for g in got)


def test_refresh_walks_once_and_tells_errors(spark, engine):
    e, path, known = engine
    walks = path / ".walks"

    def counted(batches):
        with open(walks, "a", encoding="utf-8") as f:
            f.write("walk\n")
        yield from batches

    os.makedirs(path / "shelf/b")
    for name in ("b/new.gguf", "b/lost.gguf", "b/other.gguf"):
        (path / "shelf" / name).write_bytes(name.encode())
    scan = api.scan_roots(spark, known).coalesce(1)
    watched = scan.mapInArrow(counted, scan.schema)
    real = api.materialize

    def meddle(df, name):
        out = real(df, name)
        if name == "scan":  # between the scan and the reading
            os.remove(path / "shelf/b/lost.gguf")
            (path / "shelf/b/other.gguf").write_bytes(b"another length")
        return out

    api.materialize = meddle
    try:
        done = api.refresh_all(watched, e.files, e.roots, readers=2, state=str(path / ".state"))
    finally:
        api.materialize = real
    got = {r["rel_path"]: r["sha256"] for r in done.files.filter("root_id = 'shelf'").collect()}
    assert walks.read_text() == "walk\n"
    assert got["b/new.gguf"] == hashlib.sha256(b"b/new.gguf").hexdigest() and got["b/lost.gguf"] is None and got["b/other.gguf"] is None
    errors = {r["rel_path"]: r["error"] for r in done.errors.collect()}
    assert set(errors) == {"b/lost.gguf", "b/other.gguf"} and errors["b/other.gguf"] == headers.CHANGED and "No such file" in errors["b/lost.gguf"]
    lines = {r["line"] for r in done.log_lines().collect()}
    assert "hashed b/new.gguf in 0s" in lines and f"hash FAILED b/other.gguf: {headers.CHANGED}" in lines


def test_more_commands(spark, engine):
    e, path, known = engine
    with pytest.raises(api.Ambiguous) as many:
        e.delete(["a/"])
    assert many.value.count == len(many.value.matches) == 3
    assert [r["size"] for r in e.backup_preview(["big"]).collect()] == [5, 3, 3]
    assert {r["status"] for r in e.demote(["big-q4"], "gone").collect()} == {"target offline"}
    preview = e.delete_preview(["big-q4"])
    assert preview["unreachable"].count() == 0 and preview["plan"].filter("action = 'trash'").count() == 3
    assert [r["key"] for r in e.cold_storage("Q8").collect()] and e.cold_storage("none").count() == 0
    os.link(path / "shelf/copy.gguf", path / "shelf/linked.gguf")
    files = api.refresh(api.scan_roots(spark, known), e.files, e.roots)
    files.write.parquet(str(path / "again"))
    again = api.Engine(spark.read.parquet(str(path / "again")), e.roots)
    assert again.files.count() == 6 and again.scan().count() == 5
    done = again.scrub(api.scan_roots(spark, known), 888)
    assert done["written"].filter("verified_unix = 888").count() == 6 and done["counters"].first()["status"] == "ok"


def test_a_drive_from_elsewhere_brings_its_hashes(spark, tmp_path, monkeypatch):
    """Only what is there with just that size is believed, and only where nothing better is known."""
    import json

    put(tmp_path / "drive/m.gguf", b"one")
    put(tmp_path / "drive/n.gguf", b"two")
    known = [{"root_id": "drive", "kind": "removable", "path": str(tmp_path / "drive")}]
    s = os.stat(tmp_path / "drive/m.gguf")
    print_of = lambda s: {"size": s.st_size, "mtime_s": s.st_mtime_ns // 10**9, "mtime_nsec": s.st_mtime_ns % 10**9, "dev": s.st_dev, "ino": s.st_ino}
    told = [{"rel_path": "m.gguf", "size": 3, "accessible": True, "sha256": "told", "fingerprint": print_of(s), "verified_unix": 4}, {"rel_path": "n.gguf", "size": 9, "accessible": True, "sha256": "lie", "fingerprint": print_of(os.stat(tmp_path / "drive/n.gguf"))}, {"rel_path": "../up", "size": 3, "accessible": True, "sha256": "up"}]
    put(tmp_path / "drive" / CARRIED, json.dumps({"schema_version": 1, "root": {"id": "other", "kind": "removable", "path": "/x"}, "generated_unix": 1, "files": told}).encode())
    roots = api.register(spark, known)
    files = api.refresh(api.scan_roots(spark, known), spark.createDataFrame([], FILES), roots, documents.carried(spark, known))
    got = {r["rel_path"]: (r["sha256"], r["verified_unix"]) for r in files.collect()}
    assert got == {"m.gguf": ("told", 4), "n.gguf": (hashlib.sha256(b"two").hexdigest(), None)}
    assert documents.carried(spark, [{"root_id": "x", "kind": "shelf", "path": str(tmp_path / "none")}]).count() == 0


def test_doctor_looks_at_stores_itself(spark, engine):
    import json

    e, path, _ = engine
    hub, store = path / "hub", path / "store"
    put(hub / "models--o--n/refs/main", b"gone")
    put(hub / "models--o--n/blobs/abc", b"x")
    put(hub / "models--o--n/snapshots/r1/config.json", b"in place")
    os.symlink("../../blobs/none", hub / "models--o--n/snapshots/r1/m.gguf")
    layers = [{"mediaType": "application/vnd.ollama.image.model", "digest": "sha256:aa", "size": 3}, {"mediaType": "x", "digest": "sha256:bb", "size": 4}]
    put(store / "manifests/host/library/v/1b", json.dumps({"layers": layers}).encode())
    put(store / "blobs/sha256-aa", b"abc")
    found = e.doctor(10**9, [{"kind": "hf_hub", "path": str(hub)}, {"kind": "ollama", "path": str(store)}], timer="inactive")
    assert sorted(r["kind"] for r in found.collect()) == ["dangling_ref", "dangling_snapshot_link", "missing_ollama_blob", "orphan_blob", "scrub_timer_off", "stale_verification"]


def test_trash_on_disk(spark, tmp_path):
    for f in ("a/m.gguf", "a/n.bin", ".cfg/x.json"):
        put(tmp_path / "s" / TRASH / f)
    put(tmp_path / "else/o.gguf")
    os.symlink(tmp_path / "else", tmp_path / "s" / TRASH / "linked")
    got = api.trash_scan(spark, [{"root_id": "s", "kind": "shelf", "path": str(tmp_path / "s")}, {"root_id": "o", "kind": "ollama", "path": str(tmp_path / "s")}])
    assert rows(got.select("root_id", "rel_path")) == [("s", ".cfg/x.json"), ("s", "a/m.gguf"), ("s", "a/n.bin")]
    put(tmp_path / "t" / TRASH / "old.gguf", b"0" * 2048)
    os.utime(tmp_path / "t" / TRASH / "old.gguf", (1_700_000_000, 1_700_000_000))
    os.symlink(tmp_path / "else/o.gguf", tmp_path / "t" / TRASH / "link.gguf")
    listed = api.trash_list(api.trash_scan(spark, [{"root_id": "t", "kind": "removable", "path": str(tmp_path / "t"), "label": "Vault"}]), now=1_700_000_000 + 3 * 86400)
    shown = [tuple(r) for r in listed.select("rel_path", "root_label", "root_path", "size", "trashed_unix", "shown_size", "age").collect()]
    own = os.lstat(tmp_path / "t" / TRASH / "link.gguf")
    assert shown[1][:5] == ("old.gguf", "Vault", str(tmp_path / "t"), 2048, 1_700_000_000) and shown[1][5].startswith("2") and shown[1][6].startswith("3")
    assert shown[0][:1] + shown[0][3:5] == ("link.gguf", own.st_size, int(own.st_mtime))


def test_from_headers_to_usage(spark, tmp_path):
    for name, arch, label in (("a.gguf", "llama", "7B"), ("b.gguf", "llama", "7B"), ("c.gguf", "qwen", "1B")):
        put(tmp_path / name, header([("general.architecture", 8, arch), ("general.size_label", 8, label), ("pad", 8, name * 10)]))
    known = [{"root_id": "shelf", "kind": "shelf", "path": str(tmp_path)}]
    roots = api.register(spark, known)
    api.refresh(api.scan_roots(spark, known), spark.createDataFrame([], FILES), roots).write.parquet(str(tmp_path / ".files"))
    usage = api.Engine(spark.read.parquet(str(tmp_path / ".files")), roots).report().collect()
    assert {(r["family"], r["contents"]) for r in usage} == {("llama 7B", 2), ("qwen 1B", 1)}


def test_refresh_hashes_only_what_changed(spark, engine, monkeypatch):
    e, path, known = engine
    (path / "shelf/new.gguf").write_bytes(b"new")
    asked = []
    real = headers.hash_files
    monkeypatch.setattr(headers, "hash_files", lambda df, *a: (asked.append(sorted(os.path.basename(r["path"]) for r in df.collect())), real(df, *a))[1])
    again = api.refresh(api.scan_roots(spark, known), e.files, e.roots)
    assert again.filter(F.col("sha256").isNull()).count() == 0 and asked == [["new.gguf"]]
    offline = e.roots.withColumn("online", F.lit(False))
    assert api.refresh(api.scan_roots(spark, known[:0]), e.files, offline).count() == e.files.count()


def test_refresh_reads_headers(spark, tmp_path):
    def write(name, arch, length):
        put(tmp_path / name, header([("general.architecture", 8, arch), (f"{arch}.context_length", 4, length)]))

    write("a.gguf", "llama", 2048)
    write("stale.gguf", "qwen", 64)
    write("unread.gguf", "bert", 32)
    put(tmp_path / "broken.gguf", b"none")
    put(tmp_path / "emb/config.json", b'{"model_type": "gte", "max_position_embeddings": 512}')
    put(tmp_path / "emb/model.safetensors", b"w")
    known = [{"root_id": "shelf", "kind": "shelf", "path": str(tmp_path)}]
    roots = api.register(spark, known)

    def state(files):
        return {r["rel_path"]: (r["meta"] and (r["meta"]["architecture"], r["meta"]["context_length"]), r["meta_reader"]) for r in files.collect()}

    first = api.refresh(api.scan_roots(spark, known), spark.createDataFrame([], FILES), roots).cache()
    whole = {"a.gguf": (("llama", 2048), 1), "stale.gguf": (("qwen", 64), 1), "unread.gguf": (("bert", 32), 1), "broken.gguf": (None, 1), "emb/config.json": (None, 1), "emb/model.safetensors": (("gte", 512), 1)}
    assert state(first) == whole
    write("a.gguf", "llama", 4096 * 16)
    older = F.col("meta").withField("architecture", F.lit("old"))
    before = first.withColumns(
        {
            "meta": F.when(F.col("rel_path") == "stale.gguf", older).when(F.col("rel_path") != "unread.gguf", F.col("meta")),
            "meta_reader": F.when(F.col("rel_path") == "stale.gguf", 0).when(F.col("rel_path") != "unread.gguf", F.col("meta_reader")),
        }
    )
    os.utime(tmp_path / "a.gguf", (1, 1))
    assert state(api.refresh(api.scan_roots(spark, known), before, roots)) == whole | {"a.gguf": (("llama", 65536), 1)}
    closed = api.scan_roots(spark, known).withColumn("accessible", F.lit(False))
    kept = state(api.refresh(closed, before, roots))
    assert kept["stale.gguf"] == (("old", 64), 0) and kept["unread.gguf"] == (None, None) and kept["a.gguf"] == (None, None)


def test_fetch(spark):
    names = ["big-00001-of-00002.gguf", "big-00002-of-00002.gguf", "mmproj-f16.gguf", ".x/y.gguf", "other.gguf"]
    listing = spark.createDataFrame([(i, f, 1) for i, f in enumerate(names)], "ord long, filename string, size long")
    got = rows(api.fetch_plan(listing, "BIG-00001", "org/name", "/s").select("filename", "listed", "dest"))
    assert got == [(f, True, f"/s/name/{f}") for f in names[:3]]
    assert len(rows(api.fetch_plan(listing, "", "org/name", "/s", snapshot=True))) == 4


def test_commands_are_listed():
    found = api.commands()
    assert {"Engine.verify", "Engine.backup", "Engine.status", "refresh", "journal", "fetch_plan", "scan_roots"} <= set(found)
    assert found["journal"].startswith("(ts, line)") and "Ambiguous" not in found and not any(n.startswith("Engine._") for n in found)
