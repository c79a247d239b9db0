"""The commands of the engine, each a DataFrame (or several by name). Nothing here changes the files of a root; plans say what would happen."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import has_dot_component, sanitized, scan_display_name
from .functions.scalars import ago, dest_for, human_size
from .operators import aggregates, bundle, catalog, health, picks
from .plans import actions
from .sources import documents, headers, scanner, walk
from .sources.scratch import materialize
from .sources.state import TRASH
from .streaming import hashing


class Ambiguous(ValueError):
    """A query that must name one content names none or several."""

    def __init__(self, query: str, count: int, matches: list[str]) -> None:
        super().__init__(f"{query!r} matches {count} contents" + (": " + ", ".join(matches) if matches else ""))
        self.count, self.matches = count, matches


def scan_roots(spark: SparkSession, roots: Sequence[dict[str, str]]) -> DataFrame:
    """Rows of all roots that are there: root_id, kind, ord (by path), and the columns of a scan."""
    parts = []
    for r in roots:
        if os.path.isdir(r["path"]):
            rows = scanner.scan(spark, r["path"], r["kind"]) if r["kind"] == "ollama" else walk.walk_store(spark, r["path"], r["kind"])
            parts.append(rows.select(F.lit(r["root_id"]).alias("root_id"), F.lit(r["kind"]).alias("kind"), *[c for c in rows.columns if c != "extra"]))
    if not parts:
        return spark.createDataFrame([], f"root_id string, kind string, {scanner.SCHEMA}").drop("extra").withColumn("ord", F.lit(0).cast("long"))
    every = reduce(DataFrame.unionByName, parts)
    # Numbers that rise with the path; they need not be gapless, so no task has to see a whole root.
    return every.repartitionByRange("root_id", "rel_path").sortWithinPartitions("root_id", "rel_path").withColumn("ord", F.monotonically_increasing_id())


def register(spark: SparkSession, roots: Sequence[dict[str, str]]) -> DataFrame:
    """Roots with whether they are online, looked up once."""
    rows = [(r["root_id"], r["kind"], os.path.isdir(r["path"]), r.get("label"), r["path"]) for r in roots]
    return spark.createDataFrame(rows, "root_id string, kind string, online boolean, label string, path string")


@dataclass
class Refreshed:
    """``files`` as they are now, ``read``: what was hashed (root_id, rel_path, fingerprint and the columns of headers.HASHED), ``errors``: what couldn't be (root_id, rel_path, error)."""

    files: DataFrame
    read: DataFrame

    @property
    def errors(self) -> DataFrame:
        return self.read.filter("error IS NOT NULL").select("root_id", "rel_path", "error")

    def log_lines(self) -> DataFrame:
        """(ts, line) for the journal."""
        return hashing.log_lines(self.read)


def refresh(scan: DataFrame, previous: DataFrame, roots: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """The files of ``refresh_all``."""
    return refresh_all(scan, previous, roots, carried).files


def refresh_all(scan: DataFrame, previous: DataFrame, roots: DataFrame, carried: DataFrame | None = None, readers: int = 4, state: str | None = None, progress: str | None = None) -> Refreshed:
    """A scan reconciled with the stored files: unchanged ones keep their hash, changed ones are hashed, offline roots stay.

    The scan is written down once, so that all that follows sees one state of the stores; a file that isn't any more what the scan saw
    when it is read gets no hash but an error. ``readers`` tasks read from a root at a time. With ``state``, a folder, hashing is a stream
    that makes its work durable there (``streaming.hashing``), and a run after a lost one goes on; ``progress`` is where readers tell how far they are.

    ``carried`` are the records that drives have with them (``documents.carried``): what of them is believable completes the stored files.
    Headers are read of files that carry_forward asks for and of those that no reader has been at (no meta_reader); a file that
    can't be reached keeps the header known of its fingerprint, and isn't stamped.
    """
    at = ["root_id", "rel_path"]
    scan = materialize(scan, "scan")
    if carried is not None:
        told = catalog.believable(carried, scan)
        previous = catalog.stored_with_carried(previous, told.select(*[F.col(c) if c in told.columns else F.lit(None).cast(previous.schema[c].dataType).alias(c) for c in previous.columns]))
        previous = materialize(previous, "stored")
    known = materialize(catalog.carry_forward(scan.withColumns({"sha256": F.lit(None).cast("string"), "verified_unix": F.lit(None).cast("long")}), previous), "reconciled")
    places = roots.select("root_id", F.col("path").alias("root_path"), F.col("kind").alias("root_kind"))
    path = F.concat_ws("/", "root_path", "rel_path")
    todo = catalog.hash_worklist(known).join(known.select(*at, "fingerprint"), at).join(places, "root_id").select(*at, path.alias("path"), "size", "fingerprint")
    if state is None:
        read = todo.select(*at, "path", "fingerprint").join(headers.hash_files(todo, readers, progress), "path").select(*at, "fingerprint", *headers.HASHED_COLUMNS)
    else:
        read = hashing.hash_durably(todo, state, readers, progress)
    read = materialize(read, "read")
    fresh = read.select(*at, F.col("sha256").alias("fresh"))

    old = previous.select(*at, F.col("fingerprint").alias("old_fp"), F.col("meta").alias("old_meta"), F.col("meta_reader").alias("old_reader"))
    same = F.coalesce(F.col("fingerprint") == F.col("old_fp"), F.lit(False))
    unread = F.col("needs_header") | (F.col("meta").isNull() & F.col("old_reader").isNull())
    stated = known.join(old, at, "left").withColumn("to_read", F.col("accessible") & unread)
    paths = stated.filter("to_read").join(places, "root_id").select(*at, path.alias("path"), F.col("root_kind").alias("file_kind"))
    found = headers.file_meta(paths.select("path", F.col("file_kind").alias("kind")))
    facts = paths.join(found.withColumnRenamed("meta", "fresh_meta"), "path").select(*at, "fresh_meta")

    done = stated.join(fresh, at, "left").join(facts, at, "left").withColumns(
        {
            "sha256": F.coalesce("sha256", "fresh"),
            "meta": F.when(F.col("to_read"), F.col("fresh_meta")).when(same, F.col("old_meta")),
            "meta_reader": F.when(F.col("to_read"), F.lit(catalog.READER_VERSION)).when(same, F.col("old_reader")),
        }
    )
    return Refreshed(catalog.all_manifests(done.drop("fresh", "needs_header", "to_read", "fresh_meta", "old_fp", "old_meta", "old_reader"), previous, roots), read)


class Engine:
    """Commands over one state of the catalog: ``files`` and ``roots``. What several commands share is computed once and written."""

    def __init__(self, files: DataFrame, roots: DataFrame) -> None:
        self.files, self.roots = files.drop("kind"), roots

    @cached_property
    def stated(self) -> DataFrame:
        return materialize(catalog.with_state(catalog.locations(self.files, self.roots), self.roots), "stated")

    @cached_property
    def locations(self) -> DataFrame:
        return self.stated.drop("state")

    @cached_property
    def models(self) -> DataFrame:
        return materialize(catalog.models(self.files), "models")

    @cached_property
    def bundles(self) -> bundle.Bundles:
        return bundle.bundles(self.models, self.locations).written()

    def select(self, queries: Sequence[str]) -> DataFrame:
        """The one content that each query names."""
        keys = []
        for q in queries:
            met = catalog.find(self.models, self.locations, q)
            found = [r["key"] for r in picks.ambiguous(met).select("key").collect()]  # ten at most
            if len(found) != 1:
                raise Ambiguous(q, met.count() if len(found) == 10 else len(found), found)
            keys += found
        return self.models.filter(F.col("key").isin(keys)).select("key")

    def matching(self, queries: Sequence[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [catalog.find(self.models, self.locations, q).select("key") for q in queries]).distinct()

    def scan(self) -> DataFrame:
        """All files, those that are one inode once."""
        rows = self.files.join(self.roots.select("root_id", "kind"), "root_id").withColumns({"dev": F.col("fingerprint.dev"), "ino": F.col("fingerprint.ino")})
        return picks.scan_order(catalog.first_per_inode(rows).withColumn("display_name", scan_display_name(F.col("kind"), F.col("name"), F.col("rel_path"))))

    def target(self, asked: str) -> dict:
        """The root that a text names by id, label or path."""
        found = catalog.resolve_root(self.roots, asked).collect()
        if not found:
            raise ValueError(f"{asked!r} names no root")
        return found[0].asDict()

    def status(self) -> dict[str, DataFrame]:
        return {"roots": aggregates.root_rollup(self.files, self.roots), "headline": aggregates.status(self.models, self.stated, self.dups())}

    def dups(self) -> DataFrame:
        return aggregates.ranked_dups(aggregates.dup_groups(self.models, self.stated))

    def report(self) -> DataFrame:
        return aggregates.usage_report(aggregates.family_usage(self.models, self.stated))

    def doctor(self, now: int, stores: Sequence[dict[str, str]] = (), timer: str | None = None, *findings: DataFrame) -> DataFrame:
        """Stale drives, what is wrong in ``stores`` (kind ollama or hf_hub, path), a timer that isn't active, and the given findings, with what may be done about each."""
        spark = self.files.sparkSession
        every = [health.stale_findings(self.files, self.roots, now), *findings, *(store_health(spark, r["kind"], r["path"]) for r in stores if os.path.isdir(r["path"]))]
        if timer is not None:
            every.append(health.scrub_finding(spark, timer, self.roots.filter("kind IN ('shelf', 'removable')").count()))
        return health.with_remedies(reduce(DataFrame.unionByName, every))

    def where(self, query: str, provenance: DataFrame) -> DataFrame:
        """Every copy of what the query matches; anything but a copy that can be read now is shown as OFFLINE."""
        found = catalog.with_provenance(catalog.find(self.models, self.locations, query), provenance)
        return found.join(self.stated, "key").withColumn("shown", F.when(F.col("state") == "Present", "present").otherwise("OFFLINE"))

    def forget(self, root_id: str) -> Engine:
        return Engine(self.files.filter(F.col("root_id") != root_id), self.roots.filter(F.col("root_id") != root_id))

    def impact(self, root_id: str) -> DataFrame:
        return aggregates.root_impact(self.models, self.locations).filter(F.col("root_id") == root_id)

    def archive(self, queries: Sequence[str]) -> DataFrame:
        return self._moved(actions.promote(self.models, self.stated), queries)

    def demote(self, queries: Sequence[str], target: str | None = None) -> DataFrame:
        return self._moved(actions.demote(self.models, self.stated, None if target is None else self.target(target)), queries)

    def restore(self, queries: Sequence[str]) -> DataFrame:
        return self._moved(actions.restore(self.models, self.stated), queries)

    def _moved(self, plan: DataFrame, queries: Sequence[str]) -> DataFrame:
        return plan.join(bundle.bundle_union(self.bundles, self.select(queries)), "key", "left_semi")

    def dedup(self) -> DataFrame:
        return actions.reclaim(self.stated, self.models)

    def delete(self, queries: Sequence[str]) -> DataFrame:
        return actions.delete(self.bundles, self.select(queries), self.models, self.stated, self.roots)

    def delete_preview(self, queries: Sequence[str]) -> dict[str, DataFrame]:
        """The plan of a delete, the copies that it can't reach now, and the commands for those of other owners."""
        plan = materialize(self.delete(queries), "delete_plan")
        return {"plan": plan, "unreachable": actions.unreachable_copies(plan, self.models, self.stated, self.roots), "commands": actions.foreign_commands(plan)}

    def backup_preview(self, queries: Sequence[str]) -> DataFrame:
        return picks.backup_preview(self.models, bundle.bundle_union(self.bundles, self.matching(queries)))

    def cold_storage(self, text: str = "") -> DataFrame:
        """Contents that may go to cold storage, by a part of their name."""
        kids = bundle.children(self.bundles, self.locations)
        named = self.models.filter(F.lower("display_name").contains(text.lower())).select("key", "display_name", "size")
        return named.join(actions.cold_eligible(self.models, self.stated, kids), "key", "left_semi").orderBy(F.desc("size"), "key")

    def backup(self, target: str, queries: Sequence[str] = ()) -> DataFrame:
        chosen = self.matching(queries) if queries else None
        return actions.backup(self.models, self.stated, target, self.files.filter(F.col("root_id") == target), self.bundles if queries else None, chosen)

    def verify(self, now: int, root: str | None = None, repair: bool = False, readers: int = 4) -> dict[str, DataFrame]:
        """Reads every file of online owned roots again, or of the one that ``root`` names. Paths that would leave a root count as mismatched.

        ``written`` has the files with the new times of verification, ``offline`` the owned roots that were left out.
        """
        roots = self.roots if root is None else self.roots.filter(F.col("root_id") == self.target(root)["root_id"])
        owned = roots.filter("online AND kind IN ('shelf', 'removable')")
        safe = self.files.filter(sanitized(F.col("rel_path")).isNotNull() & F.col("sha256").isNotNull())
        here = safe.join(owned.select("root_id", F.col("path").alias("root_path")), "root_id").withColumn("path", F.concat_ws("/", "root_path", "rel_path"))
        read = here.select("root_id", "rel_path", "path").join(headers.hash_files(here.drop("fingerprint"), readers), "path").filter(~F.col("gone"))
        checked = materialize(actions.verify(self.files, read.select("root_id", "rel_path", "sha256"), roots), "checked")
        out = {"files": checked, "counters": actions.counters(checked), "written": actions.verified(self.files, checked, now), "offline": actions.offline_owned(roots)}
        out |= {status: picks.verify_list(checked, status) for status in ("mismatched", "unreadable")}
        if repair:
            out["repair"] = actions.repair(checked.filter("status IN ('mismatched', 'missing', 'unreadable')"), self.stated)
            out["repair_counters"] = actions.repair_counters(out["repair"])
        return out

    def scrub(self, scan: DataFrame, now: int) -> dict[str, DataFrame]:
        """What a scheduler runs from time to time: hash what is new or changed, then read all of it again."""
        fresh = materialize(refresh(scan, self.files, self.roots), "refreshed")
        return Engine(fresh, self.roots).verify(now)

    def inventory(self, order: str = "name", ascending: bool = True, text: str = "") -> DataFrame:
        splits = aggregates.split_rollup(self.models, bundle.split_primary(self.bundles, self.locations), catalog.backed_up(self.stated)) if order == "size" else None
        return aggregates.inventory_view(self.models, self.stated, order, ascending, splits).filter(F.lower(F.concat_ws(" ", "display_name", "quant", "places", "key")).contains(text.lower()))


def as_json(found: DataFrame | dict[str, DataFrame]) -> DataFrame:
    """(part, json): what any command gives as a line of JSON a row, nulls included; part names the piece of a command that gives several."""
    parts = {"": found} if isinstance(found, DataFrame) else found
    lines = [rows.select(F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json")) for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, lines)


def store_health(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Findings of a hub, or of an ollama store, on disk."""
    if kind == "hf_hub":
        return health.hub_health(materialize(scanner.scan(spark, path, "links", 3), "hub_parts"))
    blobs = scanner.scan(spark, os.path.join(path, "blobs"), "trash").select(F.regexp_replace("rel_path", "^sha256-", "sha256:").alias("digest"))
    return health.missing_layers(documents.store_manifests(spark, os.path.join(path, "manifests")), blobs)


def journal(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(ts, line): the last entries, or all of them, oldest first."""
    entries = documents.journal(spark, path)
    return (entries.orderBy("seq") if limit is None else picks.tail(entries, limit)).select("ts", "line")


TRASHED = "root_id string, root_label string, root_path string, rel_path string, size long, trashed_unix long"


def trash_scan(spark: SparkSession, roots: Sequence[dict[str, str]]) -> DataFrame:
    """The columns of TRASHED for every file in the trash of every owned root that is there. The label is the root's id where it has none;
    the time is that of the file, which a move into the trash sets."""
    out = spark.createDataFrame([], TRASHED)
    for r in roots:
        folder = os.path.join(r["path"], TRASH)
        if r["kind"] in ("shelf", "removable") and os.path.isdir(folder):
            label, path = F.lit(r.get("label") or r["root_id"]).alias("root_label"), F.lit(r["path"]).alias("root_path")
            time = F.greatest(F.coalesce("fingerprint.mtime_s", F.lit(0)), F.lit(0)).alias("trashed_unix")
            out = out.unionByName(walk.walk_store(spark, folder, "trash").select(F.lit(r["root_id"]).alias("root_id"), label, path, "rel_path", "size", time))
    return out


def trash_list(trash: DataFrame, text: str = "", now: int | None = None) -> DataFrame:
    """The trash by path, of those whose path holds the text; with ``now`` sizes and ages are shown too."""
    rows = trash.filter(F.lower("rel_path").contains(text.lower()))
    if now is not None:
        rows = rows.withColumns({"shown_size": human_size(F.col("size")), "age": ago(F.col("trashed_unix"), F.lit(now))})
    return picks.trash_order(rows)


def trash_restore(trash: DataFrame, text: str) -> DataFrame:
    """All that comes back with the files that the text matches."""
    return bundle.restore_set(trash, trash.filter(F.lower("rel_path").contains(text.lower()))).select("root_id", "rel_path").distinct()


def hub_filter(listing: DataFrame, text: str) -> DataFrame:
    """The rows of a grouped hub listing whose shown name holds the text."""
    return listing.filter(F.lower("display").contains(text.lower()))


def fetch_plan(remote: DataFrame, pattern: str, repo: str, shelf: str, snapshot: bool = False) -> DataFrame:
    """(filename, listed, dest): the files to download; a pattern takes whole split sets and one projector along."""
    if snapshot:
        chosen = remote.filter(~has_dot_component(F.col("filename"))).select("filename", F.lit(True).alias("listed"))
    else:
        picked = remote.filter(F.lower("filename").contains(pattern.lower())).select("filename")
        sets = bundle.split_set(remote, picked).select("filename", "listed").distinct()
        chosen = sets.unionByName(bundle.projector_pick(remote, picked).withColumn("listed", F.lit(True)))
    return chosen.select("filename", "listed", dest_for(F.lit(shelf), F.lit(repo), F.col("filename")).alias("dest"))


def commands() -> dict[str, str]:
    """What there is to call: the commands of an ``Engine`` and the functions here, each with the first line of its description."""
    own = {f"Engine.{n}": f for n, f in vars(Engine).items() if callable(f) and not n.startswith("_")}
    here = {n: f for n, f in globals().items() if getattr(f, "__module__", None) == __name__ and callable(f) and not isinstance(f, type)}
    return {n: (f.__doc__ or "").strip().split("\n")[0] for n, f in sorted({**own, **here}.items())}
