"""Literal cases of the catalog operators."""

from __future__ import annotations

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage import schema
from stowage.functions import names as n
from stowage.functions import scalars as x
from stowage.operators import aggregates as a
from stowage.operators import bundle as b
from stowage.operators import catalog as c
from stowage.operators import health as h
from stowage.plans import actions

from .conftest import rows

FILES = T.StructType(
    [
        T.StructField("root_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("fingerprint", schema.FINGERPRINT),
        T.StructField("sha256", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("meta", schema.META),
        T.StructField("meta_reader", T.IntegerType()),
        T.StructField("accessible", T.BooleanType()),
        T.StructField("verified_unix", T.LongType()),
    ]
)


def fp(size, dev, ino, mtime=0):
    return (size, mtime, 0, Decimal(dev), Decimal(ino))


def files(spark, *given):
    """(root, path, size, fingerprint, sha, accessible[, verified])"""
    full = [(g[0], i, g[1], g[2], g[3], g[4], None, None, 1, g[5], g[6] if len(g) > 6 else None) for i, g in enumerate(given)]
    return spark.createDataFrame(full, FILES)


def roots(spark, *given):
    return spark.createDataFrame([(*g, None) for g in given], "root_id string, kind string, online boolean, label string")


def values(spark, expression, items, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i,) for i in items], f"v {kind}").select(expression(F.col("v"))).collect()]


def test_offline_roots_stay(spark):
    f = files(spark, ("on", "m.gguf", 100, fp(100, 1, 10), "aa", True), ("off", "backup/m.gguf", 100, None, "aa", True))
    r = roots(spark, ("on", "shelf", True), ("off", "shelf", False))
    assert rows(c.models(f).select("key", "size")) == [("sha256:aa", 100)]
    assert rows(c.locations(f, r).select("root_id", "accessible")) == [("off", False), ("on", True)]


def test_states(spark):
    f = files(spark, ("on", "a", 1, None, "1", True), ("on", "b", 1, None, "2", False), ("off", "c", 1, None, "3", True), ("gone", "d", 1, None, "4", True))
    r = roots(spark, ("on", "shelf", True), ("off", "shelf", False))
    got = rows(c.with_state(c.locations(f, r), r).select("rel_path", "state"))
    assert got == [("a", "Present"), ("b", "Unreadable"), ("c", "Offline"), ("d", "Offline")]


def model_tables(spark, given):
    """given: key, display_name, kind, root, path"""
    locs = spark.createDataFrame([(k, root, kind, path, i) for i, (k, _, kind, root, path) in enumerate(given)], "key string, root_id string, kind string, rel_path string, ord long")
    mods = spark.createDataFrame(sorted({(k, 1, name) for k, name, *_ in given}), "key string, size long, display_name string")
    return mods, locs


SNAP = "models--acme--Large/snapshots/rev1/"
BUNDLES = [
    ("part1", "acme/Large", "hf_hub", "hf", SNAP + "q/large-00001-of-00002.gguf"),
    ("part2", "acme/Large", "hf_hub", "hf", SNAP + "q/large-00002-of-00002.gguf"),
    ("proj", "acme/Large", "hf_hub", "hf", SNAP + "mmproj-F16.gguf"),
    ("otherquant", "acme/Large", "hf_hub", "hf", SNAP + "large-Q2_K.gguf"),
    ("omodel", "vision:latest", "ollama", "ol", "blobs/sha256-m"),
    ("oproj", "vision:latest+projector", "ollama", "ol", "blobs/sha256-p"),
    ("weights", "lab/Vectors", "hf_hub", "hf", "models--lab--Vectors/snapshots/rev1/model.safetensors"),
    ("tok", "lab/Vectors", "hf_hub", "hf", "models--lab--Vectors/snapshots/rev1/tokenizer.json"),
    ("pool", "lab/Vectors", "hf_hub", "hf", "models--lab--Vectors/snapshots/rev1/pooler/settings.json"),
    ("other", "lab/Second", "hf_hub", "hf", "models--lab--Second/snapshots/c41/model.safetensors"),
]


def members(pairs):
    out = {}
    for k, m in rows(pairs):
        out.setdefault(k, set()).add(m)
    return out


def test_bundles(spark):
    got = members(b.bundle(*model_tables(spark, BUNDLES)))
    assert got["part1"] == {"part1", "part2", "proj"} and got["proj"] == {"proj"} and got["otherquant"] == {"otherquant", "proj"}
    assert got["omodel"] == got["oproj"] == {"omodel", "oproj"}
    assert got["weights"] == {"weights", "tok", "pool"} and got["tok"] == {"tok"} and got["other"] == {"other"}


def test_sibling_directories_are_apart(spark):
    given = [("w", "w", "shelf", "s", "Emb/model.bin"), ("in", "in", "shelf", "s", "Emb/x/c.json"), ("out", "out", "shelf", "s", "Embx/c.json"), ("top", "top", "shelf", "s", "model.pt")]
    got = members(b.bundle(*model_tables(spark, given)))
    assert got["w"] == {"w", "in"} and got["top"] == {"top"}


def naive_bundle(given):
    """The relation read off its definition, pair by pair."""
    locs = {}
    names = {}
    for k, name, kind, root, path in given:
        locs.setdefault(k, []).append((kind, root, path))
        names.setdefault(k, name)
    import re

    part = re.compile(r"(?s)^(.*)-(\d{5})-of-(\d{5})\.gguf\Z")
    out = {}
    box = lambda kind, p: "/".join(p.split("/")[:3]) if kind == "hf_hub" else "/".join(p.split("/")[:-1])
    heavy = lambda f: f.lower().endswith((".safetensors", ".bin", ".pt", ".pth", ".onnx"))
    for k in locs:
        got = {k}
        for kind, root, path in locs[k]:
            file, mine = path.split("/")[-1], box(kind, path)
            for o, places in locs.items():
                for okind, oroot, opath in places:
                    if oroot != root:
                        continue
                    if kind == "ollama":
                        if okind == "ollama" and names[o].removesuffix("+projector") == names[k].removesuffix("+projector"):
                            got.add(o)
                        continue
                    if okind == "ollama":
                        continue
                    ofile = opath.split("/")[-1]
                    if heavy(file) and mine:
                        if opath.split("/")[: len(mine.split("/"))] == mine.split("/") and opath != mine:
                            got.add(o)
                    elif box(okind, opath) == mine:
                        p, q = part.match(file), part.match(ofile)
                        if p and q and (p[1], p[3]) == (q[1], q[3]) or "mmproj" in ofile.lower() and "mmproj" not in file.lower():
                            got.add(o)
        out[k] = got
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bundles_against_their_definition(spark, seed):
    r = random.Random(seed)
    files_ = ["m-00001-of-00002.gguf", "m-00002-of-00002.gguf", "x-00001-of-00002.gguf", "mmproj-a.gguf", "w.bin", "sub/c.json", "q.gguf"]
    given, kind_of = [], {"s": "shelf", "h": "hf_hub", "o": "ollama"}
    for i in range(30):
        root = r.choice("shho")
        folder = {"s": r.choice(["", "a/", "ab/", "a/b/"]), "h": f"models--o--{r.choice('xy')}/snapshots/r{r.choice('12')}/", "o": "blobs/"}[root]
        name = r.choice(["v:1", "v:1+projector", "z:2"]) if root == "o" else "n"
        given.append((f"k{r.randrange(22)}", name, kind_of[root], root, folder + r.choice(files_) if root != "o" else f"blobs/{i}"))
    names = {}
    given = [(k, names.setdefault(k, name), kind, root, path) for k, name, kind, root, path in given]
    mods, locs = model_tables(spark, given)
    of, relation = naive_bundle(given), b.bundles(mods, locs).written()
    assert members(relation.pairs()) == of
    some = sorted(of)[::3]
    chosen = spark.createDataFrame([(k,) for k in some], "key string")
    assert members(relation.pairs(chosen)) == {k: of[k] for k in some}
    needed = {m: sorted(k for k in of if m in of[k] and m != k and k not in of[m]) for m in of}
    assert rows(b.required_by(relation)) == sorted(((m, i, k) for m, ks in needed.items() for i, k in enumerate(ks)), key=repr)
    union = set().union(*(of[k] for k in some))
    assert {r[0] for r in rows(b.bundle_union(relation, chosen))} == union
    keeper = {c: min((k for k in of if k not in union and c in of[k]), default=None) for c in union}
    assert rows(b.deletable(relation, chosen, mods)) == sorted(((c, "keep", names[k]) if k else (c, "delete", None) for c, k in keeper.items()), key=repr)
    places = {k: min((root, i, path) for i, (o, _, _, root, path) in enumerate(given) if o == k)[2].split("/")[-1] for k in of}
    index = {k: int(f[-19:-14]) if f.endswith(".gguf") and "-of-" in f else None for k, f in places.items()}
    whole = {k: min(ones) for k in of if index[k] not in (None, 1) and (ones := [m for m in of[k] if index[m] == 1])}
    assert dict(rows(b.split_primary(relation, locs))) == whole
    assert dict(rows(b.children(relation, locs))) == {**whole, **{m: ks[0] for m, ks in needed.items() if ks}}


def test_a_large_container_stays_linear(spark):
    """2,000 weights over 20,000 files stand for 44 million pairs; no step writes them down."""
    w, f = 2_000, 20_000
    place = lambda n, name, ending: spark.range(n).select(F.format_string(f"{name}%06d", "id").alias("key"), F.lit("s").alias("root_id"), F.lit("shelf").alias("kind"), F.format_string(f"box/{'sub/' if name == 'f' else ''}{name}%06d{ending}", "id").alias("rel_path"), F.col("id").alias("ord"))
    locs = place(w, "w", ".safetensors").unionByName(place(f, "f", ".json"))
    mods = locs.select("key", F.lit(1).cast("long").alias("size"), F.col("key").alias("display_name"))
    began = time.perf_counter()
    relation = b.bundles(mods, locs).written()
    assert (relation.heads.count(), relation.members.count()) == (w, w + f)
    has, needs = b.dependence(relation)
    assert (has.count(), needs.count()) == (w + f, w)
    pick = lambda k: b.deletable(relation, spark.createDataFrame([(k,)], "key string"), mods).groupBy("action", "kept_for").count()
    assert rows(pick("w000001")) == [("delete", None, w + f)] and rows(pick("f000001")) == [("keep", "w000000", 1)]
    assert b.children(relation, locs).agg(F.count("child"), F.min("parent"), F.max("parent")).first() == (f, "w000000", "w000000")
    assert time.perf_counter() - began < 60


def test_duplicates_and_usage_agree_on_liveness(spark):
    f = files(
        spark,
        ("a", "l1", 500, fp(500, 1, 1), "linked", True), ("b", "l2", 500, fp(500, 1, 1), "linked", True),
        ("a", "c1", 700, fp(700, 1, 2), "copied", True), ("a", "c2", 700, fp(700, 1, 3), "copied", True), ("b", "c3", 700, fp(700, 1, 2), "copied", True),
        ("a", "v1", 900, fp(900, 1, 7), "backedup", True), ("vault", "v2", 900, fp(900, 2, 7), "backedup", True),
        ("off", "o1", 100, fp(100, 3, 1), "unplugged", True), ("off", "o2", 100, fp(100, 3, 2), "unplugged", True),
    )
    r = roots(spark, ("a", "shelf", True), ("b", "shelf", True), ("off", "removable", False))
    stated = c.with_state(c.locations(f, r), r)
    mods = c.models(f)
    assert rows(a.dup_groups(mods, stated).select("key", "reclaimable")) == [("sha256:copied", 700)]
    usage = {r["family"]: r["stored_bytes"] for r in a.family_usage(mods, stated).collect()}
    assert usage["o1"] == 100 and usage["c1"] == 1400


def test_coverage(spark):
    f = files(
        spark,
        ("s", "1", 1, None, "1", True), ("d1", "1", 1, None, "1", True), ("s", "2", 1, None, "2", True), ("d2", "2", 1, None, "2", True), ("s", "3", 1, None, "3", True), ("d1", "3", 1, None, "3", False),
    )
    r = roots(spark, ("s", "shelf", True), ("d1", "removable", True), ("d2", "removable", False))
    assert rows(a.backup_coverage(c.models(f), c.with_state(c.locations(f, r), r))) == [(2, 3)]


def test_hash_is_carried_only_on_an_equal_fingerprint(spark):
    old = files(spark, ("r", "same", 1, fp(1, 1, 1), "cafe", True, 5), ("r", "new", 1, fp(1, 1, 2), "beef", True, 5), ("r", "unknown", 1, None, "dead", True, 5))
    now = files(spark, ("r", "same", 1, fp(1, 1, 1), None, True), ("r", "new", 1, fp(1, 1, 2, 9), None, True), ("r", "unknown", 1, None, None, True))
    got = rows(c.carry_forward(now, old).select("rel_path", "sha256", "verified_unix"))
    assert got == [("new", None, None), ("same", "cafe", 5), ("unknown", None, None)]


def test_old_readers_are_read_again(spark):
    old = files(spark, ("r", "f", 1, fp(1, 1, 1), "x", True)).withColumn("meta", F.lit(None).cast(schema.META))
    meta = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.META.fields])
    stale = old.withColumns({"meta": meta, "meta_reader": F.lit(0)})
    now = files(spark, ("r", "f", 1, fp(1, 1, 1), None, True))
    assert [r[0] for r in c.carry_forward(now, stale).select("needs_header").collect()] == [True]
    assert [r[0] for r in c.carry_forward(now, old.withColumn("meta_reader", F.lit(0))).select("needs_header").collect()] == [False]


SHARED = [("q4", "Big Q4", "shelf", "s", "d/big-Q4.gguf"), ("q8", "Big Q8", "shelf", "s", "d/big-Q8.gguf"), ("mm", "Projector", "shelf", "s", "d/mmproj-F16.gguf")]


def test_a_shared_companion_survives(spark):
    mods, locs = model_tables(spark, SHARED)
    pairs = b.bundles(mods, locs)
    pick = lambda *k: spark.createDataFrame([(i,) for i in k], "key string")
    assert rows(b.deletable(pairs, pick("q4"), mods)) == [("mm", "keep", "Big Q8"), ("q4", "delete", None)]
    assert rows(b.deletable(pairs, pick("q4", "q8"), mods)) == [("mm", "delete", None), ("q4", "delete", None), ("q8", "delete", None)]


def test_restore_mirrors_delete(spark):
    trash = spark.createDataFrame([("s", p) for p in ("d/big-00001-of-00002.gguf", "d/big-00002-of-00002.gguf", "d/mmproj-F16.gguf", "d/other-Q4.gguf")], "root_id string, rel_path string")
    ask = lambda p: {r[2] for r in rows(b.restore_set(trash, spark.createDataFrame([("s", p)], "root_id string, rel_path string")))}
    assert ask("d/big-00001-of-00002.gguf") == {"d/big-00001-of-00002.gguf", "d/big-00002-of-00002.gguf", "d/mmproj-F16.gguf"}
    assert ask("d/mmproj-F16.gguf") == {"d/mmproj-F16.gguf"}


def test_hub_problems(spark):
    refs = spark.createDataFrame([("Hollow", "main", "r0"), ("Untidy", "main", "rev1"), ("Untidy", "old", "rev0gone")], "repo string, ref string, rev string")
    snaps = spark.createDataFrame([("Untidy", "rev1")], "repo string, rev string")
    blobs = spark.createDataFrame([("Untidy", "used", 1), ("Untidy", "orphan", 2), ("Untidy", "dl.incomplete", 3)], "repo string, blob string, size long")
    links = spark.createDataFrame([("Untidy", "rev1", "ok", "used"), ("Untidy", "rev1", "dead", None), ("Untidy", "rev1", "file in place", "regular")], "repo string, rev string, path string, blob string")
    got = sorted(r[0] for r in h.hub_findings(refs, snaps, blobs, links).select("kind").collect())
    assert got == ["dangling_ref", "dangling_snapshot_link", "incomplete_download", "orphan_blob", "pruned_husk"]


def test_missing_layers(spark):
    manifests = spark.createDataFrame([("ghost:latest", [("sha256:gone", 42)])], "name string, layers array<struct<digest string, size long>>")
    assert rows(h.missing_layers(manifests, spark.createDataFrame([], "digest string"))) == [("missing_ollama_blob", "ghost:latest", "sha256:gone", 42)]


def test_stale_drives(spark):
    day, now = 86400, 200 * 86400
    f = files(spark, ("d10", "a", 1, None, "1", True, now - 10 * day), ("d120", "a", 7, None, "1", True, now - 120 * day), ("never", "a", 1, None, "1", True), ("shelf", "a", 1, None, "1", True))
    r = roots(spark, ("d10", "removable", True), ("d120", "removable", False), ("never", "removable", True), ("shelf", "shelf", True))
    assert rows(a.stale_verification(f, r, now).select("root_id", "bytes")) == [("d120", 7), ("never", 1)]


def test_listings(spark):
    listing = spark.createDataFrame([(0, "q/large-00001-of-00002.gguf", 40), (1, "plain-Q4.gguf", 7), (2, "q/large-00002-of-00002.gguf", 10)], "ord long, filename string, size long")
    assert rows(b.listing_groups(listing).select("display", "total")) == [("plain-Q4.gguf", 7), ("q/large.gguf (2 parts)", 50)]
    unknown = listing.withColumn("size", F.when(F.col("ord") == 0, None).otherwise(F.col("size")))
    assert ("q/large.gguf (2 parts)", None) in rows(b.listing_groups(unknown).select("display", "total"))
    gap = spark.createDataFrame([(0, "m-00001-of-00003.gguf", 1), (1, "m-00003-of-00003.gguf", 1)], "ord long, filename string, size long")
    assert [r[1] for r in rows(b.split_set(gap, gap.limit(1))) if not r[2]] == ["m-00002-of-00003.gguf"]
    names = ["big-Q4.gguf", "mmproj-bf16.gguf", "mmproj-f16.gguf", "mmproj-Q8_0.gguf"]
    repo = spark.createDataFrame([(i, f, 1) for i, f in enumerate(names)], "ord long, filename string, size long")
    assert rows(b.projector_pick(repo, repo.filter("filename = 'big-Q4.gguf'"))) == [("mmproj-f16.gguf",)]
    assert rows(b.projector_pick(repo, repo.filter("filename = 'mmproj-Q8_0.gguf'"))) == []


def test_foreign_copies_are_never_linked(spark):
    f = files(spark, ("s", "a", 5, fp(5, 1, 1), "x", True), ("s", "b", 5, fp(5, 1, 1), "x", True), ("s", "c", 5, fp(5, 1, 2), "x", True), ("o", "d", 5, fp(5, 1, 3), "x", True))
    r = roots(spark, ("s", "shelf", True), ("o", "ollama", True))
    got = rows(actions.reclaim(c.with_state(c.locations(f, r), r), c.models(f)).select(F.col("ino").cast("int"), "action", "frees"))
    assert got == [(1, "survivor", 0), (2, "link", 5), (3, "skipped_foreign", 0)]


def test_scalars(spark):
    assert values(spark, x.human_size, [0, 1000, 3072, 5905580032, 1280, 1331], "long") == ["0 B", "1000 B", "3.0 KiB", "5.5 GiB", "1.2 KiB", "1.3 KiB"]
    assert values(spark, n.sanitized, ["../e", "a/../../e", "/etc/passwd", "", "..", "./a/./b.gguf"]) == [None] * 5 + ["a/b.gguf"]
    good, bad = ["maker/Some-Model_1.5"], ["noslash", "too/many/slashes", "/leading", "trailing/", "../../etc", "org/name?x=1", "a/b\n"]
    assert values(spark, x.valid_repo, good + bad) == [True] + [False] * 7
    sha = "AB" * 32
    assert values(spark, x.etag_sha256, [sha, f'"{sha}"', f'W/"{sha}"', "ab" * 16, ""]) == [sha.lower()] * 2 + [None] * 3
    assert values(spark, x.url_path, ["evil?x=1", "a b.gguf", "é", "a/b~c*"]) == ["evil%3Fx%3D1", "a%20b.gguf", "%C3%A9", "a/b~c%2A"]
    assert values(spark, lambda v: n.split_part(v)["count"], ["a-00001-of-00002.gguf", "model-001-of-003.gguf", "a-00001-of-00002.txt", "a-00001-of-00002.GGUF", "-00001-of-00002.gguf"]) == [2, None, None, None, 2]
    assert values(spark, x.file_type_name, [17, 999], "long") == ["Q5_K_M", "type 999"]
    assert values(spark, lambda v: x.head_dim(F.lit(None).cast("long"), F.lit(4096), v), [32, 0, None, 5], "long") == [128, None, None, None]
    assert values(spark, lambda v: x.ago(F.lit(0), v), [90, 91, 5400, 5401, 172800, 172801], "long") == ["90s ago", "1 min ago", "90 min ago", "1 hours ago", "48 hours ago", "2 days ago"]


def test_trash_names(spark):
    f = spark.createDataFrame([("s", "m-Q4.gguf", i) for i in range(2)] + [("s", "d/plain", i) for i in range(2)], "root_id string, rel_path string, ord long")
    assert [r[3] for r in rows(actions.trash_names(f))] == ["d/plain", "d/plain.1", "m-Q4.gguf", "m-Q4.1.gguf"]


def test_trash_names_that_are_taken(spark):
    arrive = lambda *names: spark.createDataFrame([("s", f, i) for i, f in enumerate(names)], "root_id string, rel_path string, ord long")
    there = spark.createDataFrame([("s", "m.gguf"), ("s", "m.2.gguf"), ("s", "d/x.1"), ("t", "m.3.gguf")], "root_id string, rel_path string")
    go = lambda a, p=None: [r["trash_path"] for r in sorted(actions.trash_names(a, p).collect(), key=lambda r: r["ord"])]
    assert go(arrive("m.gguf", "m.gguf", "m.2.gguf"), there) == ["m.1.gguf", "m.3.gguf", "m.2.1.gguf"]
    assert go(arrive("m.1.gguf", "m.gguf", "m.gguf", "m.gguf")) == ["m.1.gguf", "m.gguf", "m.2.gguf", "m.3.gguf"]
    assert go(arrive("d/x", "d/x", "d/x"), there) == ["d/x", "d/x.2", "d/x.3"]
    assert actions.trash_names(arrive("m.gguf").limit(0), there).count() == 0


def inventory(spark):
    f = files(
        spark,
        ("s", "d/big-00001-of-00002.gguf", 40, fp(40, 1, 1), "a1", True), ("s", "d/big-00002-of-00002.gguf", 40, fp(40, 1, 2), "a2", True),
        ("s", "Middle.gguf", 60, fp(60, 1, 3), "b", True), ("s", "small.gguf", 5, fp(5, 1, 4), "c", True), ("s", "middle.gguf", 50, fp(50, 1, 5), "d", False),
    )
    r = roots(spark, ("s", "shelf", True))
    return c.models(f), c.with_state(c.locations(f, r), r)


def test_inventory_orders(spark):
    mods, stated = inventory(spark)
    splits = a.split_rollup(mods, b.split_primary(b.bundles(mods, stated.drop("state")), stated.drop("state")), c.backed_up(stated))
    names = lambda *args: [r["key"][7:] for r in a.inventory_view(mods, stated, *args).collect()]
    assert names("size", False, splits) == ["a1", "b", "d", "a2", "c"]  # a split set goes by the size of all its parts
    assert names("name") == ["a1", "a2", "b", "d", "c"]  # letters' case doesn't matter; equal names go by the rest of the text
    assert names("name", False) == ["c", "d", "b", "a2", "a1"]
    assert names("state", True)[0] == "d"


def test_verification_is_written_back(spark):
    f = files(spark, ("d", "ok", 1, None, "1", True, 5), ("d", "bad", 1, None, "2", True, 6), ("d", "gone", 1, None, "3", True), ("d", "odd/../../up", 1, None, "4", True, 7), ("d", "raw", 1, None, None, True), ("off", "x", 1, None, "1", True))
    r = roots(spark, ("d", "removable", True), ("off", "removable", False))
    fresh = spark.createDataFrame([("d", "ok", "1"), ("d", "bad", "x"), ("d", "odd/../../up", "4")], "root_id string, rel_path string, sha256 string")
    checked = actions.verify(f, fresh, r)
    assert dict(rows(checked.select("rel_path", "status"))) == {"ok": "ok", "bad": "mismatched", "gone": "missing", "odd/../../up": "mismatched", "raw": "unhashed"}
    after = actions.verified(f, checked, 99)
    assert dict(rows(after.select("rel_path", "verified_unix"))) == {"ok": 99, "bad": 6, "gone": None, "odd/../../up": 7, "raw": None, "x": None}
    assert after.columns == f.columns and rows(actions.offline_owned(r)) == [("off",)]


def test_demote_wants_an_owned_target_that_is_there(spark):
    mods, stated = inventory(spark)
    status = lambda t=None: {r["status"] for r in actions.demote(mods, stated, t).collect()}
    assert status() == status({"kind": "removable", "online": True}) == {"demote", "no live shelf copy"}
    assert status({"kind": "removable", "online": False}) == {"target offline"} and status({"kind": "hf_hub", "online": True}) == {"target not owned"}


def test_export_has_a_line_for_each_location(spark):
    mods, stated = inventory(spark)
    lines = rows(c.inventory_json(mods, stated.drop("state")))
    assert len(lines) == 10 and all(line[2].startswith("{") for line in lines)


def test_believable(spark):
    here = files(spark, ("r", "a/real.gguf", 5, None, None, True))
    told = files(spark, ("r", "a/real.gguf", 5, None, "1", True), ("r", "../up", 5, None, "2", True), ("r", "/abs", 5, None, "3", True), ("r", "a/real.gguf", 6, None, "4", True), ("r", "none", 5, None, "5", True))
    assert [r[0] for r in rows(c.believable(told, here).select("sha256"))] == ["1"]
