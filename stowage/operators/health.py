"""Health of stores as anti-joins: what points at nothing, and what nothing points at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregates import stale_verification

#: Classes of findings: kind, label, whether a remedy may be executed, what it is, what fixing it costs.
KINDS = (
    ("dangling_ref", "dangling ref", False, "A ref names a revision that is no longer on disk.", "Nothing: what it points to is gone."),
    ("pruned_husk", "pruned husk", True, "Refs are all that is left of a repository.", "Nothing: it holds no bytes."),
    ("orphan_blob", "orphan blob", False, "No snapshot refers to this content.", "The bytes of the blob, which are real data."),
    ("incomplete_download", "incomplete download", True, "A download was interrupted and left its part.", "Resuming it: the download would start anew."),
    ("dangling_snapshot_link", "dangling snapshot link", False, "A snapshot entry points at content that is gone.", "Nothing: the bytes are gone."),
    ("missing_ollama_blob", "missing ollama blob", True, "A registered model lacks a blob and can not run.", "The registration of the model."),
    ("scrub_timer_off", "scrub timer off", True, "Nothing reads the tracked bytes again from time to time.", "Nothing: idle reading is added."),
    ("stale_verification", "stale verification", False, "A drive has not been verified for a long time, or never.", "Nothing: the drive is read."),
)


def kinds(spark: SparkSession) -> DataFrame:
    row = "('{}', '{}', {}, '{}', '{}')"
    values = ", ".join(row.format(k, label, str(ok).lower(), what, cost) for k, label, ok, what, cost in KINDS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(kind, label, executable, explanation, loss)")


def scrub_finding(spark: SparkSession, state: str, owned_roots: int) -> DataFrame:
    """One finding while owned roots exist and the timer isn't active."""
    wanted = state != "active" and owned_roots > 0
    return finding(spark.range(int(wanted)), "scrub_timer_off", F.lit("scrub timer"), F.lit(state), F.lit(0))


def finding(rows: DataFrame, kind: str, subject, detail, size) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), subject.alias("subject"), detail.alias("detail"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))


def hub_findings(refs: DataFrame, snapshots: DataFrame, blobs: DataFrame, links: DataFrame) -> DataFrame:
    """From refs (repo, ref, rev), snapshots (repo, rev), blobs (repo, blob, size) and links (repo, rev, path, blob): what each entry of a
    snapshot leads to; blob is null where that is gone."""
    part = blobs.filter(F.col("blob").endswith(".incomplete"))
    whole = blobs.filter(~F.col("blob").endswith(".incomplete"))
    content = snapshots.select("repo").unionByName(whole.select("repo")).distinct()
    husks = refs.join(content, "repo", "left_anti").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list(F.concat("ref", F.lit(" → "), F.substring("rev", 1, 12)))), ", ").alias("refs"))
    dangling = refs.join(content, "repo", "left_semi").join(snapshots.select("repo", "rev"), ["repo", "rev"], "left_anti")
    used = links.filter(F.col("blob").isNotNull()).select("repo", "blob")
    dead = links.filter(F.col("blob").isNull())
    orphans = whole.join(used, ["repo", "blob"], "left_anti")
    zero, c = F.lit(0), F.col
    # The wording of the details is fixed output.
    return (
        finding(part, "incomplete_download", c("repo"), F.concat(F.lit("blobs/"), "blob"), c("size"))
        .unionByName(finding(husks, "pruned_husk", c("repo"), F.concat(F.lit("refs remain ("), "refs", F.lit(") but all content is pruned")), zero))
        .unionByName(finding(dangling, "dangling_ref", c("repo"), F.concat(F.lit("refs/"), "ref", F.lit(" → "), F.substring("rev", 1, 12), F.lit(" has no snapshot")), zero))
        .unionByName(finding(dead, "dangling_snapshot_link", c("repo"), c("path"), zero))
        .unionByName(finding(orphans, "orphan_blob", c("repo"), F.concat(F.lit("blobs/"), F.substring("blob", 1, 16), F.lit(" referenced by no snapshot")), c("size")))
    )


def hub_health(parts: DataFrame) -> DataFrame:
    """Findings of a hub from the rows of a scan of kind ``links``."""
    at = F.split("rel_path", "/")
    rows = parts.select("extra", "name", "size", F.col("rel_path").alias("path"), F.element_at(at, 1).alias("repo"), F.element_at(at, 3).alias("third"), F.element_at(at, -1).alias("last"))
    of = lambda kind: rows.filter(F.col("extra") == kind)
    return hub_findings(
        of("ref").select("repo", F.col("last").alias("ref"), F.col("name").alias("rev")),
        of("snapshot").select("repo", F.col("name").alias("rev")),
        of("blob").select("repo", F.col("name").alias("blob"), "size"),
        of("link").select("repo", F.col("third").alias("rev"), "path", F.col("name").alias("blob")),
    )


def missing_layers(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """From manifests (name, layers of digest and size) and blobs (digest): layers, of any type, without a blob."""
    layers = manifests.select("name", F.explode("layers").alias("layer")).select("name", "layer.digest", "layer.size")
    return finding(layers.join(blobs.select("digest"), "digest", "left_anti"), "missing_ollama_blob", F.col("name"), F.col("digest"), F.col("size"))


def stale_findings(files: DataFrame, roots: DataFrame, now: int) -> DataFrame:
    stale = stale_verification(files, roots, now)
    detail = F.when(F.col("oldest") == 0, F.lit("never verified")).otherwise(F.concat(F.lit("oldest verification "), F.col("days").cast("string"), F.lit(" days ago")))
    return finding(stale, "stale_verification", F.col("root_id"), detail, F.col("bytes"))


def with_remedies(findings: DataFrame) -> DataFrame:
    return findings.join(F.broadcast(kinds(findings.sparkSession)), "kind")  # eight rows


def total_bytes(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("findings"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
