"""Queries over the derived catalog, by name. ``oracle.py`` has the SQL that gives the same rows."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logs
from ..functions import names as n
from ..functions import scalars as x
from ..operators import aggregates as a
from ..operators import bundle as b
from ..operators import catalog as c
from ..operators import health as h
from ..operators import picks as p
from ..operators import search
from ..sources import documents, headers, scanner, walk
from ..sources.scratch import materialize, scratch_path
from ..store import Store
from ..streaming import hashing, journal
from . import actions
from .fixture import NOW, Catalog, catalog, large_catalog, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def on_catalog(f: Callable[[Catalog], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(catalog(spark, sf_dir))
    return f


def on_settled(f: Callable[[Catalog], DataFrame]) -> Callable:
    """For what goes through the bundle relation: the catalog is written once and read from there."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(catalog(spark, sf_dir).settled())
    return f


def selected(k: Catalog) -> DataFrame:
    """Hashed contents of roots src2, src3 and src4: what the queries select."""
    return k.locations.filter("root_id IN ('src2', 'src3', 'src4') AND key LIKE 'sha256:%'").select("key").distinct()


@on_catalog
def catalog_merge(k: Catalog) -> DataFrame:
    return k.models.select("key", "size", "display_name", "meta.architecture", "meta.size_label", "meta.quantization")


@query
def merge_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of a store that was saved with other files of two roots, and without a third, which then changed to the catalog's."""
    k = catalog(spark, sf_dir)
    files = materialize(k.files.drop("kind"), "files")
    late = F.col("root_id").isin("src2", "src3")
    before = files.filter("root_id <> 'src4'").withColumns({"size": F.when(late, F.col("size") + 1).otherwise(F.col("size")), "sha256": F.when(~late | (F.col("ord") % 2 == 0), F.col("sha256"))})
    with tempfile.TemporaryDirectory() as lock:
        store = Store(spark, scratch_path(spark, "store"), lock)
        store.save(before, k.roots)
        store.update({r: files.filter(F.col("root_id") == r) for r in ("src2", "src3", "src4")})
    return store.contents().select("key", "size", "display_name", "meta.architecture", "meta.size_label", "meta.quantization")


@on_catalog
def location_state(k: Catalog) -> DataFrame:
    return k.stated.select("key", "root_id", "kind", "rel_path", "accessible", F.col("dev").cast("long").alias("dev"), F.col("ino").cast("long").alias("ino"), "state")


@on_catalog
def dup_groups(k: Catalog) -> DataFrame:
    return a.dup_groups(k.models, k.stated)


@query
def dup_groups_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = large_catalog(spark, sf_dir)
    return a.dup_groups(k.models, k.stated)


@on_catalog
def dup_totals(k: Catalog) -> DataFrame:
    return a.dup_totals(a.dup_groups(k.models, k.stated))


@on_catalog
def family_usage(k: Catalog) -> DataFrame:
    return a.usage_report(a.family_usage(k.models, k.stated))


@query
def family_usage_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = large_catalog(spark, sf_dir)
    return a.family_usage(k.models, k.stated)


@on_catalog
def backup_coverage(k: Catalog) -> DataFrame:
    return a.backup_coverage(k.models, k.stated)


@on_catalog
def backed_up(k: Catalog) -> DataFrame:
    return c.backed_up(k.stated)


@on_catalog
def root_impact(k: Catalog) -> DataFrame:
    return a.root_impact(k.models, k.locations)


@on_catalog
def root_rollup(k: Catalog) -> DataFrame:
    return a.root_rollup(k.files.drop("kind"), k.roots)


@on_catalog
def status_headline(k: Catalog) -> DataFrame:
    return a.status(k.models, k.stated, a.dup_groups(k.models, k.stated))


@on_catalog
def stale_verification(k: Catalog) -> DataFrame:
    return a.stale_verification(k.files.drop("kind"), k.roots, NOW)


@on_catalog
def places(k: Catalog) -> DataFrame:
    return a.places(k.locations)


@on_catalog
def cold_contents(k: Catalog) -> DataFrame:
    return a.cold(k.locations)


@on_catalog
def inventory_view(k: Catalog) -> DataFrame:
    return a.inventory_view(k.models, k.stated, "size", ascending=False)


@on_settled
def active_view(k: Catalog) -> DataFrame:
    return a.active_view(k.models, k.locations, b.children(k.bundles, k.locations), "gguf")


@on_settled
def bundle(k: Catalog) -> DataFrame:
    return k.bundles.pairs()


@on_settled
def companions(k: Catalog) -> DataFrame:
    return b.companions(k.bundles)


@on_settled
def required_by(k: Catalog) -> DataFrame:
    return b.required_by(k.bundles)


@on_settled
def split_primary(k: Catalog) -> DataFrame:
    return b.split_primary(k.bundles, k.locations)


@on_settled
def children(k: Catalog) -> DataFrame:
    return b.children(k.bundles, k.locations)


@on_settled
def split_rollup(k: Catalog) -> DataFrame:
    return a.split_rollup(k.models, b.split_primary(k.bundles, k.locations), c.backed_up(k.stated))


@on_settled
def bundle_union(k: Catalog) -> DataFrame:
    return b.bundle_union(k.bundles, selected(k))


@on_settled
def deletable_set(k: Catalog) -> DataFrame:
    return b.deletable(k.bundles, selected(k), k.models)


@on_settled
def selection_totals(k: Catalog) -> DataFrame:
    return a.selection_totals(k.models, b.bundle_union(k.bundles, selected(k)))


@on_settled
def delete_plan(k: Catalog) -> DataFrame:
    return actions.delete(k.bundles, selected(k), k.models, k.stated, k.roots)


@on_settled
def foreign_commands(k: Catalog) -> DataFrame:
    return actions.foreign_commands(actions.delete(k.bundles, selected(k), k.models, k.stated, k.roots))


@on_catalog
def backup_plan(k: Catalog) -> DataFrame:
    return actions.backup(k.models, k.stated, "src3", k.files.filter("root_id = 'src3'"))


@on_settled
def backup_counters(k: Catalog) -> DataFrame:
    return actions.counters(actions.backup(k.models, k.stated, "src3", k.files.filter("root_id = 'src3'"), k.bundles, selected(k)))


def fresh_hashes(k: Catalog) -> DataFrame:
    """Hashes as a verification would read them: every 11th file changed, every 13th unreadable, every 17th under another path."""
    sha = F.when(F.col("ord") % 13 == 0, None).when(F.col("ord") % 11 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))
    return k.files.select("root_id", aside(17).alias("rel_path"), sha.alias("sha256"))


def aside(every: int, folder: str = "aside/") -> Column:
    """The path, but for every so manieth file in another folder, where the other side of a join doesn't have it."""
    return F.when(F.col("ord") % every == 0, F.concat(F.lit(folder), "rel_path")).otherwise(F.col("rel_path"))


@on_catalog
def verify_report(k: Catalog) -> DataFrame:
    return actions.verify(k.files.drop("kind"), fresh_hashes(k), k.roots)


@on_catalog
def verify_writeback(k: Catalog) -> DataFrame:
    """All files after a verification: the ok ones have its time."""
    checked = actions.verify(k.files.drop("kind"), fresh_hashes(k), k.roots)
    return actions.verified(k.files.drop("kind"), checked, NOW).select("root_id", "ord", "rel_path", "verified_unix")


@on_catalog
def repair_plan(k: Catalog) -> DataFrame:
    broken = actions.verify(k.files.drop("kind"), fresh_hashes(k), k.roots).filter("status IN ('mismatched', 'missing', 'unreadable')")
    return actions.repair(broken, k.stated)


@on_catalog
def repair_counters(k: Catalog) -> DataFrame:
    broken = actions.verify(k.files.drop("kind"), fresh_hashes(k), k.roots).filter("status IN ('mismatched', 'missing', 'unreadable')")
    return actions.repair_counters(actions.repair(broken, k.stated))


@on_catalog
def reclaim_counters(k: Catalog) -> DataFrame:
    return actions.reclaim_counters(actions.reclaim(k.stated, k.models))


@on_catalog
def offline_owned(k: Catalog) -> DataFrame:
    return actions.offline_owned(k.roots)


@on_catalog
def verify_lists(k: Catalog) -> DataFrame:
    checked = actions.verify(k.files.drop("kind"), fresh_hashes(k), k.roots)
    lists = [p.verify_list(checked, status).withColumn("status", F.lit(status)) for status in ("mismatched", "unreadable")]
    return lists[0].unionByName(lists[1])


@on_settled
def unreachable_copies(k: Catalog) -> DataFrame:
    plan = actions.delete(k.bundles, selected(k), k.models, k.stated, k.roots)
    return actions.unreachable_copies(plan, k.models, k.stated, k.roots)


@on_settled
def backup_preview(k: Catalog) -> DataFrame:
    return p.backup_preview(k.models, b.bundle_union(k.bundles, selected(k)))


@on_settled
def cold_count(k: Catalog) -> DataFrame:
    return a.cold_count(a.active_view(k.models, k.locations, b.children(k.bundles, k.locations)))


@on_catalog
def demote_targets(k: Catalog) -> DataFrame:
    """What may be demoted to an online drive, to one that isn't plugged in, and to a store that isn't owned."""
    targets = {"drive": {"kind": "removable", "online": True}, "unplugged": {"kind": "removable", "online": False}, "store": {"kind": "ollama", "online": True}}
    plans = [actions.demote(k.models, k.stated, t).select("key", F.lit(name).alias("target"), "status") for name, t in targets.items()]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@on_catalog
def reclaim_plan(k: Catalog) -> DataFrame:
    return actions.reclaim(k.stated, k.models).select("key", F.col("dev").cast("long").alias("dev"), F.col("ino").cast("long").alias("ino"), "paths", "action", "frees")


@query
def reclaim_plan_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = large_catalog(spark, sf_dir)
    return actions.reclaim(k.stated, k.models)


@on_catalog
def archive_plans(k: Catalog) -> DataFrame:
    moves = {"promote": actions.promote(k.models, k.stated).select("key", "status"), "demote": actions.demote(k.models, k.stated), "restore": actions.restore(k.models, k.stated)}
    out = None
    for name, rows in moves.items():
        rows = rows.select("key", F.lit(name).alias("move"), "status")
        out = rows if out is None else out.unionByName(rows)
    return out


@on_settled
def cold_eligible(k: Catalog) -> DataFrame:
    return actions.cold_eligible(k.models, k.stated, b.children(k.bundles, k.locations))


def earlier(k: Catalog) -> DataFrame:
    """The catalog some time before: every 3rd file had another fingerprint, every 5th another path, every 8th an old reader."""
    fp = F.col("fingerprint")
    changed = F.when(F.col("ord") % 3 == 0, fp.withField("mtime_s", fp["mtime_s"] - 1)).otherwise(fp)
    return k.files.withColumns({"rel_path": aside(5), "fingerprint": changed, "meta_reader": F.when(F.col("ord") % 8 == 0, 0).otherwise(F.col("meta_reader"))})


@on_catalog
def reconcile_carry_forward(k: Catalog) -> DataFrame:
    out = c.carry_forward(k.files, earlier(k))
    return out.select("root_id", "rel_path", "sha256", "verified_unix", "meta.architecture", "needs_header")


@on_catalog
def stored_carried_merge(k: Catalog) -> DataFrame:
    stored = k.files.withColumns({"rel_path": aside(6, "stored/"), "sha256": F.when(F.col("ord") % 2 == 0, F.col("sha256"))})
    return c.stored_with_carried(stored, earlier(k)).select("root_id", "rel_path", "size", "sha256", "verified_unix")


@on_catalog
def all_manifests(k: Catalog) -> DataFrame:
    rebuilt = k.files.withColumns({"rel_path": aside(2, "new/"), "size": F.col("size") + 1})
    return c.all_manifests(rebuilt, k.files, k.roots).select("root_id", "ord", "rel_path", "size")


@on_catalog
def hash_worklist(k: Catalog) -> DataFrame:
    return c.hash_worklist(k.files)


@on_catalog
def believable_records(k: Catalog) -> DataFrame:
    bad = F.when(F.col("ord") % 9 == 0, F.concat(F.lit("../"), "rel_path")).when(F.col("ord") % 10 == 0, F.concat(F.lit("./"), "rel_path")).otherwise(F.col("rel_path"))
    sized = k.files.withColumns({"rel_path": bad, "size": F.when(F.col("ord") % 4 == 0, F.col("size") + 1).otherwise(F.col("size"))})
    return c.believable(sized, k.files).select("root_id", "rel_path", "size")


@on_catalog
def find_query(k: Catalog) -> DataFrame:
    return c.find(k.models, k.locations, "G1/M-").select("key", "display_name").unionByName(c.find(k.models, k.locations, "a1").select("key", "display_name")).distinct()


@query
def find_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finds of ``find_query`` by an index."""
    k = catalog(spark, sf_dir).settled()
    index = search.build(search.texts_of(k.models, k.locations), k.models, scratch_path(spark, "search"))
    met = index.find("G1/M-").unionByName(index.find("a1")).distinct()
    return k.models.join(met, "key", "left_semi").select("key", "display_name")


@on_catalog
def first_per_inode(k: Catalog) -> DataFrame:
    scan = k.files.select("root_id", "ord", "kind", "rel_path", F.when(F.col("fingerprint").isNotNull(), F.col("ord") % 3).alias("dev"), F.when(F.col("fingerprint").isNotNull(), F.floor(F.col("ord") / 4)).alias("ino"))
    return c.first_per_inode(scan)


@query
def provenance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = catalog(spark, sf_dir)
    known = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise(F.reverse(F.sha2("text", 256)))
    records = table(spark, sf_dir, "documents").groupBy(known.alias("sha256")).agg(F.min("doc_id").alias("d"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("d"), F.col("url").alias("repo"))
    return c.with_provenance(k.models.select("key"), records.join(pages, "d", "left").select("sha256", "repo")).select("key", "repo")


@on_catalog
def orphan_blobs(k: Catalog) -> DataFrame:
    """Hub parts made of the catalog: a repository is a root, but what src7 and src17 hold has moved away from their refs; every 3rd
    file's blob is another than its link wants, whose target is gone then, and every 19th one is unfinished."""
    repo = F.col("root_id")
    moved = F.when(repo.isin("src7", "src17"), F.concat(repo, F.lit("-moved"))).otherwise(repo).alias("repo")
    rev = lambda last: F.concat(F.lit("rev"), (F.col("ord") % last).cast("string"))
    refs = k.files.select(repo.alias("repo"), F.concat(F.lit("ref"), F.col("ord").cast("string")).alias("ref"), rev(4).alias("rev"))
    snapshots = k.files.select(moved, rev(2).alias("rev")).distinct()
    sha, gone = F.coalesce("sha256", F.concat(F.lit("none"), F.col("ord").cast("string"))), F.col("ord") % 3 == 1
    blob = F.concat(F.when(gone, F.concat(F.lit("x"), sha)).otherwise(sha), F.when(F.col("ord") % 19 == 0, ".incomplete").otherwise(""))
    blobs = k.files.groupBy(moved, blob.alias("blob")).agg(F.max("size").alias("size"))
    links = k.files.select(moved, rev(2).alias("rev"), F.col("rel_path").alias("path"), F.when(~gone, sha).alias("blob"))
    return h.hub_findings(refs, snapshots, blobs, links).select("kind", "subject", "detail", "bytes")


@on_catalog
def missing_layers(k: Catalog) -> DataFrame:
    layer = F.struct(F.coalesce("sha256", F.lit("none")).alias("digest"), F.col("size"))
    manifests = k.files.filter("kind = 'ollama'").groupBy("name").agg(F.collect_list(layer).alias("layers"))
    there = F.when(F.col("accessible") & (F.col("ord") % 2 == 0), F.col("sha256")).otherwise(F.concat(F.lit("x"), F.col("ord").cast("string")))
    return h.missing_layers(manifests, k.files.select(there.alias("digest")).distinct())


@on_catalog
def findings_summary(k: Catalog) -> DataFrame:
    return h.with_remedies(h.stale_findings(k.files.drop("kind"), k.roots, NOW)).groupBy("kind", "label", "executable").agg(F.count(F.lit(1)).alias("findings"), F.sum("bytes").alias("bytes"))


def journal_files(spark: SparkSession, sf_dir: str) -> str:
    """The events table as a journal on storage, appended in three goes. Returns its folder."""
    e = table(spark, sf_dir, "events")
    ts, line = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("line")
    path = scratch_path(spark, "journal")
    most = e.agg(F.max("event_id")).first()[0] or 0
    third = F.least(F.floor(F.col("event_id") * 3 / F.lit(most + 1)), F.lit(2)) + 1
    parts = materialize(e.select(third.alias("go"), "event_id", ts, line), "journal_parts")
    for go in (1, 2, 3):
        documents.append_journal(parts.filter(F.col("go") == go).orderBy("event_id").select("ts", "line"), path)
    return path


@query
def journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.tail(documents.journal(spark, journal_files(spark, sf_dir)), 50).select("ts", "line")


@query
def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.journal(spark, journal_files(spark, sf_dir)).select("ts", "line")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = catalog(spark, sf_dir)
    return k.files.filter("kind IN ('shelf', 'removable')").groupBy(F.col("rel_path").alias("filename")).agg(F.min("ord").alias("ord"), F.when(F.min("ord") % 10 != 3, F.min_by("size", "ord")).alias("size"))


@query
def group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.listing_groups(listing(spark, sf_dir))


@query
def split_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = listing(spark, sf_dir)
    return b.split_set(files, files.filter("filename LIKE '%-0000%' OR filename LIKE '%other%'"))


@query
def projector_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = listing(spark, sf_dir)
    return b.projector_pick(files, files.filter("filename LIKE '%other%'"))


@query
def snapshot_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.when(F.col("ord") % 4 == 0, F.concat(F.lit(".cache/"), "filename")).otherwise(F.col("filename"))
    return listing(spark, sf_dir).select(rel.alias("filename")).filter(~n.has_dot_component(F.col("filename")))


@on_catalog
def restore_set(k: Catalog) -> DataFrame:
    trash = k.files.filter("kind IN ('shelf', 'removable')").select("root_id", "rel_path").distinct()
    return b.restore_set(trash, trash.filter("lower(rel_path) LIKE '%m%0000%' OR lower(rel_path) LIKE '%emb/%' OR lower(rel_path) LIKE '%q8%'"))


@on_catalog
def empty_trash(k: Catalog) -> DataFrame:
    return actions.empty_trash(k.files.filter("kind IN ('shelf', 'removable')"))


@on_catalog
def trash_names(k: Catalog) -> DataFrame:
    return actions.trash_names(k.files.select("root_id", n.file_name(F.col("rel_path")).alias("rel_path"), "ord"))


@on_catalog
def store_layers(k: Catalog) -> DataFrame:
    media = F.when(F.col("ord") % 3 == 0, "application/vnd.image.projector").when(F.col("ord") % 3 == 1, "application/vnd.image.model").otherwise("application/vnd.image.license")
    layer = F.struct(F.col("ord"), media.alias("mediaType"), F.concat(F.lit("sha256:"), F.substring(F.coalesce("sha256", "root_id"), 1, 12)).alias("digest"), F.col("size"))
    manifests = k.files.filter("kind = 'ollama'").groupBy("name").agg(F.sort_array(F.collect_list(layer)).alias("layers"))
    return p.store_models(manifests)


@on_catalog
def scan_order(k: Catalog) -> DataFrame:
    return p.scan_order(k.files.select("kind", "root_id", "rel_path", n.scan_display_name(F.col("kind"), F.col("name"), F.col("rel_path")).alias("display_name")))


@on_catalog
def scalar_format(k: Catalog) -> DataFrame:
    s = F.col("size") * F.col("size") * 37
    return k.files.select(
        "ord",
        x.human_size(s).alias("human"),
        x.ago(F.coalesce("verified_unix", F.lit(NOW + 5)), F.lit(NOW)).alias("ago"),
        x.utc_datetime(F.col("ord") * 86461).alias("at"),
        x.short_hash(F.col("sha256")).alias("short"),
        x.truncate(F.col("rel_path"), 12).alias("cut"),
        x.file_type_name(F.col("ord") % 40).alias("file_type"),
        x.head_dim(F.when(F.col("ord") % 9 == 0, F.col("ord")), F.col("size"), F.col("ord") % 5).alias("head_dim"),
        x.percent(F.col("ord"), F.col("size")).alias("percent"),
    )


@on_catalog
def scalar_paths(k: Catalog) -> DataFrame:
    path, kind = F.col("rel_path"), F.col("kind")
    shown = F.coalesce("name", n.stem(path))
    odd = F.when(F.col("ord") % 7 == 0, F.concat(F.lit("./"), path)).when(F.col("ord") % 7 == 1, F.concat(F.lit("/"), path)).when(F.col("ord") % 7 == 2, F.concat(path, F.lit("/../x"))).otherwise(path)
    s = n.split_part(n.file_name(path))
    return k.files.select(
        "ord",
        n.file_name(path).alias("file"),
        n.stem(path).alias("stem"),
        n.container(kind, path).alias("container"),
        n.sanitized(odd).alias("clean"),
        s["prefix"].alias("prefix"),
        s["index"].alias("part"),
        s["count"].alias("parts"),
        n.is_weights(n.file_name(path)).alias("weights"),
        n.is_projector(n.file_name(path)).alias("projector"),
        x.dest_layout(kind, shown, path).alias("dest"),
        x.owner_removal_command(kind, shown, path).alias("command"),
        x.root_id(kind, F.col("root_id")).alias("root"),
        x.dest_for(F.lit("/shelf"), F.lit("org/name"), odd).alias("dest_for"),
    )


@query
def url_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat("url", F.lit(" é~*?"))
    repo = F.regexp_extract("url", r"https?://[^/]*/(.*)", 1)
    etag = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"'), F.upper(F.sha2("url", 256)), F.lit('"'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('W/"'), F.sha2("url", 256), F.lit('"'))).otherwise(F.md5("url"))
    return table(spark, sf_dir, "pages").select("page_id", x.url_path(u).alias("path"), x.valid_repo(repo).alias("valid"), x.etag_sha256(etag).alias("etag"), x.check_download(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.col("url"))).alias("ok"))


@on_catalog
def usage_totals(k: Catalog) -> DataFrame:
    return a.usage_totals(a.family_usage(k.models, k.stated))


@on_catalog
def scan_footer(k: Catalog) -> DataFrame:
    return a.scan_footer(k.files)


@on_catalog
def trash_totals(k: Catalog) -> DataFrame:
    return a.trash_totals(p.trash_order(k.files.filter("kind IN ('shelf', 'removable') AND lower(rel_path) LIKE '%m-%'")))


@on_catalog
def findings_total(k: Catalog) -> DataFrame:
    return h.total_bytes(h.stale_findings(k.files.drop("kind"), k.roots, NOW))


@on_catalog
def resolve_root(k: Catalog) -> DataFrame:
    found = [c.resolve_root(k.roots, asked) for asked in ("src3", "disk src4", "/mnt/src6", "nothing")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("root_id", "kind")


@on_catalog
def distinct_folders(k: Catalog) -> DataFrame:
    return p.distinct_first(k.files.select(n.parent(F.col("rel_path")).alias("folder"), "ord"), "folder", "ord")


@on_catalog
def ambiguous_matches(k: Catalog) -> DataFrame:
    return p.ambiguous(c.find(k.models, k.locations, "")).select("key", "display_name")


@on_catalog
def first_live_source(k: Catalog) -> DataFrame:
    return actions.first_live(k.stated).select("key", "source.root_id", "source.rel_path")


@query
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of events made of the events table: one of each kind in turn, and progress that is never logged."""
    kinds = [("hash", "done"), ("hash", "failed"), ("backup", "done"), ("backup", "skipped"), ("backup", "progress"), ("reclaim", "relinked"), ("reclaim", "foreign"), ("fetch", "hashing"), ("fetch", "start"), ("fetch", "retry")]
    one = F.element_at(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(e).alias("event")) for s, e in kinds]), (F.col("event_id") % len(kinds) + 1).cast("int"))
    e = F.struct(
        one["source"].alias("source"), one["event"].alias("event"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("label"), F.col("event_type").alias("detail"),
        (F.col("event_id") % 100).alias("seconds"), (F.col("event_id") % 3 * 512).alias("size"), F.when(F.col("event_id") % 4 > 1, F.col("event_id") % 1000).alias("total"), (F.col("event_id") % 5).alias("attempt"),
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", e.alias("e")).select("event_id", logs.log_line(F.col("e")).alias("line"))


@on_catalog
def header_pick(k: Catalog) -> DataFrame:
    """Header fields made of the catalog: the model's own field, one of another word, one with a dot too many."""
    word = F.when(F.col("ord") % 3 == 0, "llama").when(F.col("ord") % 3 == 1, "clip").otherwise("qwen.vision")
    fields = k.files.select(F.col("root_id").alias("file"), F.concat(word, F.lit(".block_count")).alias("name"), "ord")
    one = fields.groupBy("file", "name").agg(F.min("ord").alias("value"))
    return p.header_pick(one, "llama", ".block_count")


@query
def journal_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by day and operation, counted by the stream of the journal."""
    lines, out = journal.journal_stream(spark, journal_files(spark, sf_dir)), scratch_path(spark, "activity")
    counted = journal.activity(lines).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "operation", "entries")
    written = counted.writeStream.outputMode("complete").foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/{number}"))
    done = written.option("checkpointLocation", scratch_path(spark, "activity_progress")).trigger(availableNow=True).start()
    done.awaitTermination()
    last = done.lastProgress
    return spark.read.parquet(f"{out}/{last['batchId']}")


def mounted(path: str) -> str:
    """A path of the shared folder that every machine reaches as a file of its own; stores are scanned through such paths."""
    plain = path.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"{path} is no mounted folder; set spark.checkpoint.dir to one")
    return plain


def written_shelf(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for every path of the owned roots, holding the text of the first document there, written by the executors."""
    top = mounted(scratch_path(spark, "shelf"))
    own = catalog(spark, sf_dir).files.filter("kind IN ('shelf', 'removable')").groupBy("root_id", "rel_path").agg(F.min("ord").alias("ord"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([batch["path"]], names=["path"])

    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    placed = own.join(texts, "ord").select(F.concat_ws("/", F.lit(top), "root_id", "rel_path").alias("path"), "text")
    materialize(placed.mapInArrow(put, "path string"), "written")
    return top


@query
def scan_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a shelf on disk."""
    return scanner.scan(spark, written_shelf(spark, sf_dir)).select("rel_path", "size", F.col("fingerprint.size").alias("fp_size"), "accessible")


@query
def walk_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shelf by the adaptive walk, in rounds of 500 entries a task."""
    return walk.walk_store(spark, written_shelf(spark, sf_dir), entries=500).select("rel_path", "size", F.col("fingerprint.size").alias("fp_size"), "accessible")


@query
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = written_shelf(spark, sf_dir)
    files = materialize(scanner.scan(spark, top, "trash").select(F.element_at(F.split("rel_path", "/"), 1).alias("root_id"), F.concat(F.lit(f"{top}/"), "rel_path").alias("path")), "listed")
    return headers.hash_files(files).select(F.substr("path", F.lit(len(top) + 2)).alias("rel_path"), "sha256", "gone")


@query
def hash_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a stream that hashed what a scan of a shelf found, in units of 64 files."""
    top = written_shelf(spark, sf_dir)
    found = scanner.scan(spark, top, "trash").withColumns({"root_id": F.element_at(F.split("rel_path", "/"), 1), "path": F.concat(F.lit(f"{top}/"), "rel_path")})
    done = hashing.hash_durably(materialize(found, "listed"), scratch_path(spark, "hash_state"), files=64)
    return done.select("rel_path", "sha256", "error", "bytes")


@query
def gguf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made of documents, written and read again: a model's own fields, one of another word, a per-layer array, one of no known type."""
    top = mounted(scratch_path(spark, "headers"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
        number = lambda key, v: text(key) + struct.pack("<II", 4, v)
        for batch in batches:
            os.makedirs(top, exist_ok=True)
            for d, lang in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                arch = ("llama", "qwen", "bert")[d % 3]
                fields = [text("general.architecture") + struct.pack("<I", 8) + text(arch), text("general.name") + struct.pack("<I", 8) + text(f"{lang} {d}"), number("general.file_type", d % 20)]
                fields += [number(f"{arch}.context_length" if d % 4 else "vision.context_length", 1024 + d), number(f"{arch}.embedding_length", 4096), number(f"{arch}.attention.head_count", d % 5)]
                fields.append(text(f"{arch}.attention.head_count_kv") + struct.pack("<IIQII", 9, 4, 2, 8, 4) if d % 2 else number(f"{arch}.attention.head_count_kv", 8))
                with open(os.path.join(top, f"{d}.gguf"), "wb") as f:
                    f.write(struct.pack("<IIQQ", headers.MAGIC, 3, 0, len(fields)) + b"".join(fields) if d % 7 else b"none")
            yield pa.RecordBatch.from_arrays([batch["doc_id"]], names=["doc_id"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    done = materialize(docs.mapInArrow(put, "doc_id long"), "written")
    found = headers.model_meta(done.select(F.concat(F.lit(f"{top}/"), F.col("doc_id").cast("string"), F.lit(".gguf")).alias("path")))
    doc = F.regexp_extract("path", r"([0-9]+)\.gguf$", 1).cast("long").alias("doc_id")
    return found.select(doc, "architecture", "name", "quantization", "context_length", "embedding_length", "head_count", "head_count_kv", "head_dim")
