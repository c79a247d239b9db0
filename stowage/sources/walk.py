"""An adaptive walk of a store: a frontier of folders that is dealt anew until nothing is left of it.

A task walks its folders depth first until it has seen so many entries; what it hasn't got to goes back to the frontier, and
so do the names of a very large folder that it hasn't looked at. The next round deals all of that evenly. A small store takes
one round, and neither a deep nor a wide folder stays with one task. Every round is written down, so a lost task
walks its own folders again and nothing else.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scanner import DEPTH, FINGERPRINT, WEIGHTS, holds_weights, is_gguf, join, listed, stat_row
from .scratch import materialize

#: Entries that a task looks at in a round, and items of the frontier that it begins with at most.
ENTRIES, ITEMS = 20_000, 64
#: What is still to be done: a folder ("gguf": of a shelf, "all": comes whole, "trash") or a file, and how many levels more.
ITEM = "item string, rel string, left int"
FOUND = f"{ITEM}, rel_path string, size long, fingerprint {FINGERPRINT}, accessible boolean"
_ARROW = pa.schema(
    [
        ("item", pa.string()), ("rel", pa.string()), ("left", pa.int32()), ("rel_path", pa.string()), ("size", pa.int64()),
        ("fingerprint", pa.struct([("size", pa.int64()), ("mtime_s", pa.int64()), ("mtime_nsec", pa.int64()), ("dev", pa.decimal128(20, 0)), ("ino", pa.decimal128(20, 0))])), ("accessible", pa.bool_()),
    ]
)


def expand(root: str, item: str, rel: str, left: int) -> Iterator[tuple[str, str, int]]:
    """What a folder leads to: its files and the folders to walk, with how many levels they have left."""
    entries = listed(os.path.join(root, rel))
    if item == "trash":
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if left:
                    yield "trash", join(rel, e.name), left - 1
            elif not e.is_dir():
                yield "own", join(rel, e.name), 0
        return
    if item == "gguf" and holds_weights(entries):
        item, left = "all", DEPTH
    for e in entries:
        if e.name.startswith("."):
            continue
        if e.is_dir():
            if left:
                yield item, join(rel, e.name), left - 1
        elif item == "all" or is_gguf(e.name):
            yield "file", join(rel, e.name), 0


def walk(root: str, todo: list[tuple[str, str, int]], entries: int = ENTRIES) -> Iterator[tuple]:
    """Rows of FOUND: files with what they are, and after ``entries`` of these what is still to be done."""
    todo, seen = todo[::-1], 0
    while todo:
        item, rel, left = todo.pop()
        if seen >= entries:
            yield item, rel, left, None, None, None, None
        elif item in ("file", "own"):
            path, size, fp, _, there, _ = stat_row(root, rel, follow=item == "file")
            names = ("size", "mtime_s", "mtime_nsec", "dev", "ino")
            yield None, None, None, path, size, None if fp is None else dict(zip(names, fp, strict=True)), there
            seen += 1
        else:
            found = list(expand(root, item, rel, left))
            seen += 1
            todo += found[::-1]


def one_round(frontier: DataFrame, root: str, parts: int, entries: int) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("item", "rel", "left")), strict=True)]
        out = []
        for row in walk(root, todo, entries):
            out.append(row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return frontier.repartition(parts).mapInArrow(go, FOUND)


def begin(root: str, kind: str, depth: int) -> list[tuple[str, str, int]]:
    """The first frontier. A hub's are its snapshots, which come whole."""
    if kind != "hf_hub":
        return [("trash" if kind == "trash" else "gguf", "", depth)]
    repos = [e.name for e in listed(root) if e.name.startswith("models--") and e.is_dir()]
    return [("all", f"{repo}/snapshots/{rev.name}", depth) for repo in repos for rev in listed(os.path.join(root, repo, "snapshots")) if rev.is_dir()]


def walk_store(spark: SparkSession, root: str, kind: str = "shelf", depth: int = DEPTH, entries: int = ENTRIES) -> DataFrame:
    """(rel_path, size, fingerprint, name, accessible) of the files of a shelf, a hub or a trash: the rows of a scan of the same kind."""
    frontier = spark.createDataFrame(begin(root, kind, depth), ITEM)
    waiting, found = frontier.count(), None
    while waiting:
        parts = max(1, min(math.ceil(waiting / ITEMS) if waiting > ITEMS else waiting, 100_000))
        done = materialize(one_round(frontier, root, parts, entries), "walked")
        rows = done.filter("rel_path IS NOT NULL").drop("item", "rel", "left")
        found = rows if found is None else found.unionByName(rows)
        frontier = done.filter("rel_path IS NULL").select("item", "rel", "left")
        waiting = frontier.count()
    if found is None:
        found = spark.createDataFrame([], FOUND).drop("item", "rel", "left")
    if kind != "hf_hub":
        return found.withColumn("name", F.lit(None).cast("string")).select("rel_path", "size", "fingerprint", "name", "accessible")
    # Of a snapshot without weights only GGUF files count.
    file, snapshot = F.element_at(F.split("rel_path", "/"), -1), F.substring_index("rel_path", "/", 3)
    weights = F.lower(file).rlike("(?:" + "|".join(rf"\{w}" for w in WEIGHTS) + ")$")
    heavy = found.filter(weights).select(snapshot.alias("snapshot")).distinct()
    gguf = F.lower(file).rlike(r".\.gguf$")
    name = F.replace(F.regexp_replace(F.substring_index("rel_path", "/", 1), "^models--", ""), F.lit("--"), F.lit("/"))
    rows = found.withColumns({"snapshot": snapshot, "name": name})
    kept = rows.filter(gguf).unionByName(rows.filter(~gguf).join(heavy, "snapshot", "left_semi").select(*rows.columns))
    return kept.select("rel_path", "size", "fingerprint", "name", "accessible")
