"""Plans: rows that say what an operation would do. Nothing here moves, links or deletes a byte."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import file_name, parent, sanitized
from ..functions.scalars import dest_layout, owner_removal_command
from ..operators.bundle import Bundles, bundle_union, deletable
from ..operators.catalog import owned

HASHED = "key LIKE 'sha256:%'"


def first_live(stated: DataFrame) -> DataFrame:
    """(key, source): the first location that can be read, by root and position."""
    live = stated.filter("state = 'Present'")
    return live.groupBy("key").agg(F.min_by(F.struct("root_id", "kind", "rel_path"), F.struct("root_id", "ord")).alias("source"))


def backup(mods: DataFrame, stated: DataFrame, target: str, target_files: DataFrame, bundles: Bundles | None = None, selected: DataFrame | None = None) -> DataFrame:
    """(key, status, source_root, source_path, dest_path, size): what a backup to the root ``target`` copies and skips."""
    if selected is not None:
        mods = mods.join(bundle_union(bundles, selected), "key", "left_semi")
    there = target_files.filter(F.col("sha256").isNotNull()).select(F.concat(F.lit("sha256:"), "sha256").alias("key")).unionByName(stated.filter(F.col("root_id") == target).select("key")).distinct()
    rows = mods.join(there.withColumn("there", F.lit(True)), "key", "left").join(first_live(stated), "key", "left")
    state = F.when(~F.expr(HASHED), "not hashed").when(F.col("there"), "skipped_already").when(F.col("source").isNull(), "no reachable copy").otherwise("copy")
    copy = F.col("status") == "copy"
    return rows.withColumn("status", state).select(
        "key",
        "status",
        F.when(copy, F.col("source.root_id")).alias("source_root"),
        F.when(copy, F.col("source.rel_path")).alias("source_path"),
        F.when(copy, dest_layout(F.col("source.kind"), F.col("display_name"), F.col("source.rel_path"))).alias("dest_path"),
        "size",
    )


def counters(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def verify(files: DataFrame, fresh: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, rel_path, sha256, status, size): files of online owned roots against fresh hashes (root_id, rel_path, sha256; null where unreadable).

    A path that would leave its root counts as mismatched, whatever was read.
    """
    online = roots.filter("online AND kind IN ('shelf', 'removable')").select("root_id")
    new = fresh.select("root_id", "rel_path", F.col("sha256").alias("fresh_sha"), F.lit(True).alias("seen"))
    rows = files.join(online, "root_id", "left_semi").join(new, ["root_id", "rel_path"], "left")
    state = (
        F.when(F.col("sha256").isNull(), "unhashed")
        .when(sanitized(F.col("rel_path")).isNull(), "mismatched")
        .when(F.col("seen").isNull(), "missing")
        .when(F.col("fresh_sha").isNull(), "unreadable")
        .when(F.col("fresh_sha") == F.col("sha256"), "ok")
        .otherwise("mismatched")
    )
    return rows.select("root_id", "rel_path", "sha256", state.alias("status"), "size")


def verified(files: DataFrame, checked: DataFrame, now: int) -> DataFrame:
    """``files`` with the time of verification of those that ``checked`` found to be ok; all others keep what they had."""
    good = checked.filter("status = 'ok'").select("root_id", "rel_path", F.lit(now).cast("long").alias("checked_unix"))
    rows = files.join(good, ["root_id", "rel_path"], "left").withColumn("verified_unix", F.coalesce("checked_unix", "verified_unix"))
    return rows.select(*files.columns)


def offline_owned(roots: DataFrame) -> DataFrame:
    """Owned roots that a verification of all has to leave out."""
    return roots.filter("NOT online AND kind IN ('shelf', 'removable')").select("root_id").orderBy("root_id")


def repair(broken: DataFrame, stated: DataFrame) -> DataFrame:
    """(root_id, rel_path, status, source_root, source_path): for broken files (root_id, rel_path, sha256), the first live copy on another root."""
    live = stated.filter("state = 'Present'").select("key", F.col("root_id").alias("r"), F.col("rel_path").alias("p"), "ord")
    b = broken.withColumn("key", F.concat(F.lit("sha256:"), "sha256"))
    met = b.join(live, (b.key == live.key) & (b.root_id != live.r), "left")
    out = met.groupBy("root_id", "rel_path").agg(F.min_by(F.struct("r", "p"), F.when(F.col("r").isNotNull(), F.struct("r", "ord"))).alias("s"))
    return out.select("root_id", "rel_path", F.when(F.col("s.r").isNotNull(), "repair").otherwise("unrepairable").alias("status"), F.col("s.r").alias("source_root"), F.col("s.p").alias("source_path"))


def reclaim(stated: DataFrame, mods: DataFrame) -> DataFrame:
    """(key, dev, ino, paths, action, frees): of the live inodes of one content on one device, one survives (most paths, then
    one with an owned path, then the lowest inode); the others become links if every path of theirs is owned."""
    live = stated.filter(f"state = 'Present' AND dev <> 0 AND {HASHED}")
    inodes = live.groupBy("key", "dev", "ino").agg(F.count(F.lit(1)).alias("paths"), F.bool_or(owned(F.col("kind"))).alias("any_owned"), F.bool_and(owned(F.col("kind"))).alias("all_owned"))
    groups = inodes.groupBy("key", "dev").agg(F.count(F.lit(1)).alias("inodes"), F.min_by("ino", F.struct(-F.col("paths"), ~F.col("any_owned"), "ino")).alias("survivor")).filter("inodes > 1")
    rows = inodes.join(groups, ["key", "dev"]).join(mods.select("key", "size"), "key")
    action = F.when(F.col("ino") == F.col("survivor"), "survivor").when(F.col("all_owned"), "link").otherwise("skipped_foreign")
    return rows.withColumn("action", action).select("key", "dev", "ino", "paths", "action", F.when(F.col("action") == "link", F.col("size")).otherwise(0).alias("frees"))


def repair_counters(plan: DataFrame) -> DataFrame:
    """(status, n) of a repair plan."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reclaim_counters(plan: DataFrame) -> DataFrame:
    """One row: contents with something to link, files that become links, files of other owners that stay, bytes that come free."""
    link = F.col("action") == "link"
    paths = lambda c: F.coalesce(F.sum(F.when(c, F.col("paths"))), F.lit(0))
    return plan.agg(F.count_distinct(F.when(link, F.col("key"))).alias("contents"), paths(link).alias("linked"), paths(F.col("action") == "skipped_foreign").alias("skipped_foreign"), F.coalesce(F.sum("frees"), F.lit(0)).alias("bytes"))


def delete(bundles: Bundles, selected: DataFrame, mods: DataFrame, stated: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, root_id, rel_path, action, detail): trash, foreign (with the owner's command), offline, or keep."""
    plan = deletable(bundles, selected, mods)
    kept = plan.filter("action = 'keep'").select("key", F.lit("").alias("root_id"), F.lit("").alias("rel_path"), F.lit("keep").alias("action"), F.col("kept_for").alias("detail"))
    gone = plan.filter("action = 'delete'").select("key").join(stated, "key").join(roots.select("root_id", "label"), "root_id").join(mods.select("key", "display_name"), "key")
    command = owner_removal_command(F.col("kind"), F.col("display_name"), F.col("rel_path"))
    action = F.when(~owned(F.col("kind")), "foreign").when(F.col("state") != "Present", "offline").otherwise("trash")
    detail = F.when(~owned(F.col("kind")), command).when(F.col("state") != "Present", F.coalesce("label", "root_id"))
    return gone.select("key", "root_id", "rel_path", action.alias("action"), detail.alias("detail")).unionByName(kept)


def unreachable_copies(plan: DataFrame, mods: DataFrame, stated: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, display_name, size, root_id, label, rel_path): owned copies that a delete plan can't reach now."""
    there = plan.filter("action = 'offline'").select("key", "root_id", "rel_path")
    named = roots.select("root_id", F.coalesce("label", "root_id").alias("label"))
    return there.join(named, "root_id").join(mods.select("key", "display_name", "size"), "key").select("key", "display_name", "size", "root_id", "label", "rel_path")


def foreign_commands(plan: DataFrame) -> DataFrame:
    return plan.filter("action = 'foreign' AND detail IS NOT NULL").select(F.col("detail").alias("command")).distinct()


def trash_names(arrivals: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(root_id, rel_path, ord, trash_path): where arrivals (root_id, rel_path, ord) go in a trash that holds ``present`` (root_id, rel_path).

    In their order, each takes its own name, or else the first of name.1, name.2, ... (before the extension) that is free
    by then. Only names that are equal but for such numbers can meet, so these are taken one after the other, in a stream.
    """
    columns = ["root_id", "rel_path", "ord"]
    rows = arrivals.select(*columns, F.lit(1).alias("arrives"))
    if present is not None:
        rows = rows.unionByName(present.select("root_id", "rel_path", F.lit(0).cast(arrivals.schema["ord"].dataType).alias("ord"), F.lit(0).alias("arrives")))
    family = F.regexp_replace(file_name(F.col("rel_path")), r"\.[0-9]+(?=\.|$)", "")
    dealt = rows.withColumns({"folder": parent(F.col("rel_path")), "family": family})
    group = ["root_id", "folder", "family"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken, following = None, set(), {}
        for batch in batches:
            out = []
            for at, path, arrives in zip(zip(*(batch[c].to_pylist() for c in group), strict=True), batch["rel_path"].to_pylist(), batch["arrives"].to_pylist(), strict=True):
                if at != current:
                    current, taken, following = at, set(), {}
                name = path
                if arrives:
                    folder, _, file = path.rpartition("/")
                    stem, dot, ending = file.rpartition(".")
                    n = following.get(path, 1)
                    while name in taken:
                        numbered = f"{stem}.{n}.{ending}" if dot else f"{file}.{n}"
                        name = f"{folder}/{numbered}" if folder else numbered
                        n += 1
                    following[path] = n
                taken.add(name)
                out.append(name)
            keep = pa.array([bool(a) for a in batch["arrives"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch[c].filter(keep) for c in columns), pa.array(out, pa.string()).filter(keep)], names=[*columns, "trash_path"])

    ordered = dealt.repartition(*group).sortWithinPartitions(*group, "arrives", "ord", "rel_path")
    kind = arrivals.schema["ord"].dataType.simpleString()
    return ordered.mapInArrow(assign, f"root_id string, rel_path string, ord {kind}, trash_path string")


def empty_trash(trash: DataFrame) -> DataFrame:
    """(root_id, rel_path, size, action): every file of a trash goes for good."""
    return trash.select("root_id", "rel_path", "size", F.lit("destroy").alias("action"))


def promote(mods: DataFrame, stated: DataFrame) -> DataFrame:
    """(key, status, source_root, source_path): contents without a live owned copy that have a live copy elsewhere."""
    flags = stated.groupBy("key").agg(F.bool_or((F.col("state") == "Present") & owned(F.col("kind"))).alias("owned_copy"))
    rows = mods.select("key").join(flags, "key", "left").join(first_live(stated), "key", "left")
    state = F.when(F.col("owned_copy"), "already owned").when(F.col("source").isNull(), "no reachable copy").otherwise("promote")
    ready = F.col("status") == "promote"
    return rows.withColumn("status", state).select("key", "status", F.when(ready, F.col("source.root_id")).alias("source_root"), F.when(ready, F.col("source.rel_path")).alias("source_path"))


def demote(mods: DataFrame, stated: DataFrame, target: dict | None = None) -> DataFrame:
    """(key, status): hashed contents with a live shelf copy may move to colder storage, to an owned root that is there.

    ``target`` has kind and online of the root that they are to go to.
    """
    shelf = stated.groupBy("key").agg(F.bool_or((F.col("state") == "Present") & (F.col("kind") == "shelf")).alias("on_shelf"))
    state = F.when(~F.expr(HASHED), "not hashed").when(~F.coalesce("on_shelf", F.lit(False)), "no live shelf copy").otherwise("demote")
    if target is not None and target["kind"] not in ("shelf", "removable"):
        state = F.lit("target not owned")
    elif target is not None and not target["online"]:
        state = F.lit("target offline")
    return mods.select("key").join(shelf, "key", "left").select("key", state.alias("status"))


def restore(mods: DataFrame, stated: DataFrame) -> DataFrame:
    """(key, status): contents that may come back from a drive; an unplugged drive and none at all are told apart."""
    f = stated.groupBy("key").agg(
        F.bool_or((F.col("state") == "Present") & (F.col("kind") == "shelf")).alias("on_shelf"),
        F.bool_or((F.col("state") == "Present") & (F.col("kind") == "removable")).alias("on_drive"),
        F.bool_or((F.col("state") == "Offline") & (F.col("kind") == "removable")).alias("unplugged"),
    )
    state = (
        F.when(~F.expr(HASHED), "not hashed").when(F.col("on_shelf"), "already on shelf").when(F.col("on_drive"), "restore").when(F.col("unplugged"), "drive offline").otherwise("no drive copy")
    )
    return mods.select("key").join(f, "key", "left").select("key", state.alias("status"))


def cold_eligible(mods: DataFrame, stated: DataFrame, kids: DataFrame) -> DataFrame:
    """Keys offered for cold storage: hashed, not a companion or later part, with a live shelf copy."""
    shelf = stated.filter("state = 'Present' AND kind = 'shelf'").select("key")
    return mods.filter(HASHED).select("key").join(kids.select(F.col("child").alias("key")), "key", "left_anti").join(shelf, "key", "left_semi")
