"""The catalog: content keys, merge, liveness, reconciliation of scans with what was known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import sanitized, stem

READER_VERSION = 1


def content_key(sha256: Column, fingerprint: Column, root_id: Column, rel_path: Column) -> Column:
    """sha256:<hex>, else pending:<dev>:<ino>:<size of the fingerprint>, else unknown:<root>:<path>."""
    part = lambda f: fingerprint[f].cast("string")
    pending = F.when(fingerprint.isNotNull(), F.concat_ws(":", F.lit("pending"), part("dev"), part("ino"), part("size")))
    return F.coalesce(F.concat(F.lit("sha256:"), sha256), pending, F.concat_ws(":", F.lit("unknown"), root_id, rel_path))


def locations(files: DataFrame, roots: DataFrame) -> DataFrame:
    """One row a file: key, root_id, kind, rel_path, accessible (while the root is online), dev, ino, ord."""
    online = roots.select("root_id", "kind", "online")
    keyed = files.join(online, "root_id", "left")
    fp = F.col("fingerprint")
    zero = F.lit(0).cast(files.schema["fingerprint"].dataType["dev"].dataType)
    return keyed.select(
        content_key(F.col("sha256"), fp, F.col("root_id"), F.col("rel_path")).alias("key"),
        "root_id",
        "kind",
        "rel_path",
        (F.col("accessible") & F.coalesce("online", F.lit(False))).alias("accessible"),
        F.coalesce(fp["dev"], zero).alias("dev"),
        F.coalesce(fp["ino"], zero).alias("ino"),
        "ord",
    )


def models(files: DataFrame) -> DataFrame:
    """One row a content: size and name of its first file by (root, position), meta of the first file that has one."""
    at = F.struct("root_id", "ord")
    fp = F.col("fingerprint")
    keyed = files.withColumns({"key": content_key(F.col("sha256"), fp, F.col("root_id"), F.col("rel_path")), "shown": F.coalesce("name", stem(F.col("rel_path"))), "at": at})
    return keyed.groupBy("key").agg(
        F.min_by("size", "at").alias("size"), F.min_by("shown", "at").alias("display_name"), F.min_by("meta", F.when(F.col("meta").isNotNull(), F.col("at"))).alias("meta")
    )


def with_state(locs: DataFrame, roots: DataFrame) -> DataFrame:
    """Add state: Present, Unreadable, or Offline where the root is offline or not registered."""
    online = roots.select("root_id", "online")
    state = F.when(~F.coalesce("online", F.lit(False)), "Offline").when(F.col("accessible"), "Present").otherwise("Unreadable")
    return locs.join(online, "root_id", "left").select(*locs.columns, state.alias("state"))


def owned(kind: Column) -> Column:
    return kind.isin("shelf", "removable")


def backed_up(stated: DataFrame) -> DataFrame:
    """(key, backed_up): a copy on a removable root that isn't known to be unreadable; an unplugged one counts."""
    return stated.groupBy("key").agg(F.bool_or((F.col("kind") == "removable") & (F.col("state") != "Unreadable")).alias("backed_up"))


def carry_forward(scan: DataFrame, previous: DataFrame) -> DataFrame:
    """A fresh scan with the hash and verification of unchanged files, and needs_header where the header must be read.

    Unchanged: the fingerprint is known and equal. A known header is kept unless an older reader wrote it.
    """
    old = previous.select(
        "root_id", "rel_path", F.col("fingerprint").alias("old_fp"), F.col("sha256").alias("old_sha"), F.col("verified_unix").alias("old_verified"), F.col("meta").alias("old_meta"), F.col("meta_reader").alias("old_reader")
    )
    same = F.coalesce(F.col("fingerprint") == F.col("old_fp"), F.lit(False))
    current = same & (F.col("old_meta").isNull() | (F.col("old_reader") >= READER_VERSION))
    return scan.drop("sha256", "verified_unix").join(old, ["root_id", "rel_path"], "left").select(
        *[c for c in scan.columns if c not in ("sha256", "verified_unix", "meta")],
        F.when(same, F.col("old_sha")).alias("sha256"),
        F.when(same, F.col("old_verified")).alias("verified_unix"),
        F.when(current, F.col("old_meta")).alias("meta"),
        (~current).alias("needs_header"),
    )


def stored_with_carried(stored: DataFrame, carried: DataFrame) -> DataFrame:
    """What this machine stored, completed by what a drive carries: hashes of equal files, and files only the drive knows.

    Here two unknown fingerprints are equal.
    """
    c = carried.select(*[F.col(x).alias(f"c_{x}") for x in carried.columns])
    both = stored.join(c, (stored.root_id == c.c_root_id) & (stored.rel_path == c.c_rel_path), "full")
    fill = F.col("sha256").isNull() & F.col("c_rel_path").isNotNull() & F.col("fingerprint").eqNullSafe(F.col("c_fingerprint"))
    out = []
    for x in stored.columns:
        own = F.when(fill, F.col(f"c_{x}")).otherwise(F.col(x)) if x in ("sha256", "verified_unix") else F.col(x)
        out.append(F.when(F.col("rel_path").isNotNull(), own).otherwise(F.col(f"c_{x}")).alias(x))
    return both.select(*out)


def all_manifests(rebuilt: DataFrame, stored: DataFrame, roots: DataFrame) -> DataFrame:
    """Files of online roots as rebuilt, and of all others as stored: offline is not gone."""
    online = roots.filter("online").select("root_id")
    return rebuilt.join(online, "root_id", "left_semi").unionByName(stored.join(online, "root_id", "left_anti"), allowMissingColumns=True)


def believable(carried: DataFrame, present: DataFrame) -> DataFrame:
    """Carried records with a path inside the root, whose file is there with just that size."""
    clean = carried.withColumn("rel_path", sanitized(F.col("rel_path"))).filter(F.col("rel_path").isNotNull())
    return clean.join(present.select("root_id", "rel_path", "size"), ["root_id", "rel_path", "size"], "left_semi").select(*carried.columns)


def hash_worklist(files: DataFrame) -> DataFrame:
    return files.filter(F.col("sha256").isNull() & F.col("accessible")).select("root_id", "rel_path", "size")


def find(mods: DataFrame, locs: DataFrame, query: str) -> DataFrame:
    """Models whose hash begins with the query, or whose name or a path contains it; letters' case doesn't matter."""
    q = query.lower()
    in_path = locs.filter(F.lower("rel_path").contains(q)).select("key").distinct().withColumn("by_path", F.lit(True))
    hit = F.col("key").startswith(f"sha256:{q}") | F.lower("display_name").contains(q) | F.coalesce("by_path", F.lit(False))
    return mods.join(in_path, "key", "left").filter(hit).drop("by_path")


def resolve_root(roots: DataFrame, asked: str) -> DataFrame:
    """The first root by id that the text names by id, label or path."""
    named = (F.col("root_id") == asked) | (F.col("label") == asked) | (F.col("path") == asked)
    return roots.filter(F.coalesce(named, F.lit(False))).orderBy("root_id").limit(1)


def with_provenance(mods: DataFrame, provenance: DataFrame) -> DataFrame:
    sha = F.when(F.col("key").startswith("sha256:"), F.substr("key", F.lit(8)))
    return mods.withColumn("sha256", sha).join(provenance, "sha256", "left")


def first_per_inode(scan: DataFrame) -> DataFrame:
    """Of files that are one inode, the first by store (shelf, ollama, hub) and scan order; unknown inodes all stay."""
    rank = F.when(F.col("kind") == "ollama", 1).when(F.col("kind") == "hf_hub", 2).otherwise(0)
    known = scan.filter(F.col("dev").isNotNull() & F.col("ino").isNotNull())
    at = F.struct(rank, "ord", "root_id", "rel_path")
    rows = F.struct(*scan.columns)
    return known.groupBy("dev", "ino").agg(F.min_by(rows, at).alias("r")).select("r.*").unionByName(scan.filter(F.col("dev").isNull() | F.col("ino").isNull()))


def inventory_json(mods: DataFrame, locs: DataFrame) -> DataFrame:
    """(key, ord, json): the exported inventory, a line for each model and one for each location after its model's, so that no row grows with the copies of a content."""
    models_ = mods.select("key", F.lit(-1).cast("long").alias("ord"), F.lit("").alias("root_id"), F.to_json(F.struct("key", "size", "display_name", "meta")).alias("json"))
    places_ = locs.select("key", "ord", "root_id", F.to_json(F.struct("key", "root_id", "kind", "rel_path", "accessible", "dev", "ino")).alias("json"))
    return models_.unionByName(places_).repartitionByRange("key", "root_id", "ord").sortWithinPartitions("key", "root_id", "ord").select("key", "ord", "json")
