"""Aggregates over the catalog: usage, duplicates, coverage, impact, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import family, kind_label
from .catalog import backed_up

STALE_DAYS = 90


def family_usage(mods: DataFrame, stated: DataFrame) -> DataFrame:
    """family, contents, unique_bytes, stored_bytes (size times live inodes, 1 at least; unknown inodes count as one)."""
    live = stated.filter("state = 'Present'").groupBy("key").agg(F.count_distinct("dev", "ino").alias("inodes"))
    f = family(F.col("meta.architecture"), F.col("meta.size_label"), F.col("display_name"))
    stored = F.col("size") * F.greatest(F.coalesce("inodes", F.lit(0)), F.lit(1))
    return mods.join(live, "key", "left").groupBy(f.alias("family")).agg(F.count(F.lit(1)).alias("contents"), F.sum("size").alias("unique_bytes"), F.sum(stored).alias("stored_bytes"))


def usage_report(usage: DataFrame) -> DataFrame:
    """Usage with overhead, most stored first."""
    return usage.withColumn("overhead_bytes", F.col("stored_bytes") - F.col("unique_bytes")).orderBy(F.desc("stored_bytes"), "family")


def usage_totals(usage: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return usage.agg(total("unique_bytes").alias("unique_bytes"), total("stored_bytes").alias("stored_bytes"), (total("stored_bytes") - total("unique_bytes")).alias("overhead_bytes"))


def scan_footer(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(~F.col("accessible")).alias("missing"))


def dup_groups(mods: DataFrame, stated: DataFrame) -> DataFrame:
    """key, size, display_name, extra_copies, reclaimable of hashed contents with more than one live inode on a device."""
    live = stated.filter("state = 'Present' AND dev <> 0 AND key LIKE 'sha256:%'")
    per_device = live.groupBy("key", "dev").agg((F.count_distinct("ino") - 1).alias("extra"))
    extra = per_device.groupBy("key").agg(F.sum("extra").alias("extra_copies")).filter("extra_copies > 0")
    return mods.join(extra, "key").select("key", "size", "display_name", "extra_copies", (F.col("size") * F.col("extra_copies")).alias("reclaimable"))


def ranked_dups(dups: DataFrame) -> DataFrame:
    return dups.orderBy(F.desc("reclaimable"), "key")


def dup_totals(dups: DataFrame) -> DataFrame:
    return dups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))


def backup_coverage(mods: DataFrame, stated: DataFrame) -> DataFrame:
    flags = mods.select("key").join(backed_up(stated), "key", "left")
    return flags.agg(F.count_if(F.coalesce("backed_up", F.lit(False))).alias("backed_up"), F.count(F.lit(1)).alias("contents"))


def root_impact(mods: DataFrame, locs: DataFrame) -> DataFrame:
    """For every root: contents on it, those only on it, and their bytes."""
    per_root = locs.select("key", "root_id").distinct()
    spread = per_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"))
    only = (F.col("roots") == 1).cast("long")
    return per_root.join(spread, "key").join(mods.select("key", "size"), "key").groupBy("root_id").agg(
        F.count(F.lit(1)).alias("touched"), F.sum(only).alias("only_here"), F.sum(only * F.col("size")).alias("only_bytes")
    )


def root_rollup(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Every registered root with its files and bytes, zero for none."""
    held = files.groupBy("root_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return roots.select("root_id", "kind", "online").join(held, "root_id", "left").select("root_id", "kind", "online", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def status(mods: DataFrame, stated: DataFrame, dups: DataFrame) -> DataFrame:
    """One row. unreachable goes by the stored flag of every location, offline by live locations: two different counts."""
    flags = stated.groupBy("key").agg(F.bool_or("accessible").alias("some_accessible"), F.bool_or(F.col("state") == "Present").alias("live"), F.bool_or((F.col("kind") == "removable") & (F.col("state") != "Unreadable")).alias("backed"))
    rows = mods.select("key", "size").join(flags, "key", "left").join(dups.select("key", "reclaimable"), "key", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("contents"),
        F.count_if(F.col("key").startswith("sha256:")).alias("hashed"),
        F.count_if(~F.col("key").startswith("sha256:")).alias("pending"),
        F.count_if(~F.coalesce("some_accessible", F.lit(False))).alias("unreachable"),
        F.count_if(~F.coalesce("live", F.lit(False))).alias("offline"),
        F.count_if(F.coalesce("backed", F.lit(False))).alias("backed_up"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count("reclaimable").alias("dup_groups"),
        F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("dup_bytes"),
    )


def stale_verification(files: DataFrame, roots: DataFrame, now: int) -> DataFrame:
    """Removable roots with hashed files whose oldest verification is missing or over STALE_DAYS days ago."""
    hashed = files.filter(F.col("sha256").isNotNull()).join(roots.filter("kind = 'removable'").select("root_id"), "root_id", "left_semi")
    by_root = hashed.groupBy("root_id").agg(F.min(F.coalesce("verified_unix", F.lit(0))).alias("oldest"), F.sum("size").alias("bytes"))
    days = F.floor((F.lit(now) - F.col("oldest")) / 86400)
    return by_root.filter((F.col("oldest") == 0) | (days > STALE_DAYS)).select("root_id", "oldest", F.when(F.col("oldest") > 0, days).alias("days"), "bytes")


def places(locs: DataFrame) -> DataFrame:
    return locs.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(kind_label(F.col("kind")))), " + ").alias("places"))


def cold(locs: DataFrame) -> DataFrame:
    """(key, cold): every location is on a removable root."""
    return locs.groupBy("key").agg(F.bool_and(F.col("kind") == "removable").alias("cold"))


def active_view(mods: DataFrame, locs: DataFrame, kids: DataFrame, text: str = "") -> DataFrame:
    """(key, show, matches): top-level contents; one goes from view if it and all its children are cold, and is shown if it or a child matches."""
    hay = F.lower(F.concat_ws(" ", "display_name", F.coalesce("meta.quantization", F.lit("")), "places", "key"))
    rows = mods.join(places(locs), "key").join(cold(locs), "key").select("key", "cold", hay.contains(text.lower()).alias("match"))
    inner = kids.join(rows.withColumnsRenamed({"key": "child", "cold": "c_cold", "match": "c_match"}), "child").groupBy(F.col("parent").alias("key")).agg(F.bool_and("c_cold").alias("c_cold"), F.bool_or("c_match").alias("c_match"))
    top = rows.join(kids.select(F.col("child").alias("key")), "key", "left_anti").join(inner, "key", "left")
    hidden = F.col("cold") & F.coalesce("c_cold", F.lit(True))
    return top.select("key", hidden.alias("all_cold"), (F.col("match") | F.coalesce("c_match", F.lit(False))).alias("matches")).withColumn("show", ~F.col("all_cold") & F.col("matches"))


def cold_count(active: DataFrame) -> DataFrame:
    """How many top-level contents of an ``active_view`` are out of view, as they and all their children are cold."""
    return active.agg(F.count_if("all_cold").alias("cold"))


def split_rollup(mods: DataFrame, primaries: DataFrame, backed: DataFrame) -> DataFrame:
    """(primary, parts, size, backed_up) of split sets: sizes summed, backed up only if every part is."""
    each = primaries.select("primary", F.col("part").alias("key")).unionByName(primaries.select("primary", F.col("primary").alias("key")).distinct())
    full = each.join(mods.select("key", "size"), "key").join(backed, "key", "left")
    return full.groupBy("primary").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.bool_and(F.coalesce("backed_up", F.lit(False))).alias("backed_up"))


def selection_totals(mods: DataFrame, members: DataFrame) -> DataFrame:
    return mods.join(members.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("contents"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def trash_totals(trash: DataFrame) -> DataFrame:
    return trash.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def inventory_view(mods: DataFrame, stated: DataFrame, order: str = "name", ascending: bool = True, splits: DataFrame | None = None) -> DataFrame:
    """The inventory by one of its columns (name, quant, size, where, backup, state); ties by display_name, always ascending.

    By name it goes by all text that a search looks at, the name first; by size a split set (``splits``: primary, size) goes by that of all its parts.
    """
    live = stated.groupBy("key").agg(F.count_if(F.col("state") == "Present").alias("live"))
    rows = mods.join(places(stated), "key").join(backed_up(stated), "key").join(live, "key").select("key", "display_name", F.coalesce("meta.quantization", F.lit("")).alias("quant"), "size", "places", "backed_up", "live")
    shown = rows.columns
    size = F.col("size")
    if splits is not None:
        rows = rows.join(splits.select(F.col("primary").alias("key"), F.col("size").alias("whole_size")), "key", "left")
        size = F.coalesce("whole_size", "size")
    haystack = F.lower(F.concat_ws(" ", "display_name", "quant", "places", "key"))
    by = {"name": haystack, "quant": F.col("quant"), "size": size, "where": F.col("places"), "backup": F.col("backed_up"), "state": F.col("live")}[order]
    return rows.orderBy(by.asc() if ascending else by.desc(), "display_name", "key").select(*shown)
