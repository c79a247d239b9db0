"""Large JSON documents read in pieces: the elements of one long array or map, found by byte ranges in many tasks.

Whether a byte lies in a string, and how deep, follows from all bytes before it. Tasks therefore sum up each block of a file for
every state that it may begin in; one row a block is put together in order, which gives each block its true state. Then
every task cuts the elements that begin in its block, and reads on where the last of them ends in a later one. Files are opened
by path, so executors must have them mounted. A document that doesn't end where it should is left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from .scratch import materialize

BLOCK = 8 << 20
#: Bytes before an opening bracket that its key is looked for in.
KEY_BYTES = 1 << 16
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*+)"\s*:\s*\Z', re.DOTALL)
#: States that a block may begin in: outside a string, within one, within one behind a backslash.
STATES = ((False, False), (True, False), (True, True))


def structure(data: np.ndarray, in_string: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(places of brackets outside strings, +1 or -1 for each, in a string at the end, behind a backslash at the end)."""
    at = np.arange(len(data))
    slash = data == 92
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(slash, -1, at))])  # the last other byte before each place
    run = at - 1 - before[:-1] + (escaped & (before[:-1] < 0))
    quote = (data == 34) & (run % 2 == 0)
    inside = (np.cumsum(quote) - quote + in_string) % 2 == 1
    opens, closes = (data == 123) | (data == 91), (data == 125) | (data == 93)
    places = np.flatnonzero((opens | closes) & ~inside)
    ends_in = bool((int(quote.sum()) + in_string) % 2)
    tail = len(data) - 1 - int(before[-1]) + (escaped and before[-1] < 0)
    return places, np.where(opens[places], 1, -1), ends_in, ends_in and bool(tail % 2)


def read(path: str, start: int, size: int) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(start)
        return np.frombuffer(f.read(size), np.uint8)


def key_before(data: np.ndarray, place: int) -> str | None:
    met = _KEY.search(data[max(0, place - KEY_BYTES) : place].tobytes())
    return None if met is None else json.loads(b'"' + met[1] + b'"', strict=False)


def cut(path: str, block: int, size: int, in_string: bool, escaped: bool, depth: int, name: str, whole: Sequence[str]) -> Iterator[tuple[str, bool | None, str | None, str | None]]:
    """What begins in a block: ("element", whether it is one of ``name``'s, None if an earlier block has to say so, key, text), ("container", None, name, text) for
    those in ``whole``, and last ("block", whether ``name`` is open at its end, None, None)."""
    start = block * size
    behind = read(path, max(0, start - KEY_BYTES), min(start, KEY_BYTES))
    own = read(path, start, size)
    places, steps, string, slash = structure(own, in_string, escaped)
    data, off = np.concatenate([behind, own]), len(behind)
    depths, places = depth + np.cumsum(steps), places + off
    limit, at = len(data), start + len(own)

    def closing(i: int, level: int) -> int | None:
        """The place of the bracket that brings the depth back to ``level`` behind the i-th, reading on where it must; None if there is none."""
        nonlocal data, places, steps, depths, string, slash, at
        while True:
            found = np.flatnonzero((depths[i + 1 :] <= level) & (steps[i + 1 :] < 0))
            if len(found):
                return int(places[i + 1 + found[0]])
            more = read(path, at, size)
            if not len(more):
                return None
            p, s, string, slash = structure(more, string, slash)
            depths = np.concatenate([depths, (depths[-1] if len(depths) else depth) + np.cumsum(s)])
            places, steps, data, at = np.concatenate([places, p + len(data)]), np.concatenate([steps, s]), np.concatenate([data, more]), at + len(more)

    wanted = None
    for i in np.flatnonzero((steps > 0) & (depths <= 3)).tolist():
        if places[i] >= limit:
            break
        if depths[i] == 2:
            key = key_before(data, int(places[i]))
            wanted = key == name
            if key in whole and (end := closing(i, 1)) is not None:
                yield "container", None, key, data[places[i] : end + 1].tobytes().decode("utf-8", "replace")
        elif depths[i] == 3 and wanted is not False and data[places[i]] == 123 and (end := closing(i, 2)) is not None:
            yield "element", wanted, key_before(data, int(places[i])), data[places[i] : end + 1].tobytes().decode("utf-8", "replace")
    yield "block", wanted, None, None


def elements(spark: SparkSession, paths: Sequence[str], name: str, whole: Sequence[str] = (), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(path, ord, key, json) of the objects in the array or map ``name`` of each document, and (path, name, json) of the containers ``whole`` beside it."""
    sized = spark.createDataFrame([(p, os.path.getsize(p)) for p in paths], "path string, size long")
    blocks = sized.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / block) - 1, F.lit(0)))).alias("block"))
    dealt = blocks.repartition(max(1, sum(-(-os.path.getsize(p) // block) for p in paths)), "path", "block")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, b in zip(batch["path"].to_pylist(), batch["block"].to_pylist(), strict=True):
                data = read(p, b * block, block)
                for i, s in enumerate(STATES):
                    _, steps, string, slash = structure(data, *s)
                    rows.append((p, b, i, STATES.index((string, slash)), int(steps.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["path", "block", "state", "then", "step"])

    def in_order(table: pa.Table) -> pa.Table:
        """The state of every block of one document; three rows a block."""
        rows = {(b, s): (t, d) for b, s, t, d in zip(*(table[c].to_pylist() for c in ("block", "state", "then", "step")), strict=True)}
        state, depth, out = 0, 0, []
        for b in sorted({b for b, _ in rows}):
            out.append((table["path"][0].as_py(), b, state, depth))
            state, step = rows[b, state]
            depth += step
        fine = state == 0 and depth == 0
        return pa.table({"path": pa.array([r[0] for r in out], pa.string()), "block": pa.array([r[1] for r in out], pa.int64()), "state": pa.array([r[2] for r in out], pa.int32()), "depth": pa.array([r[3] for r in out], pa.int64()), "fine": pa.array([fine] * len(out))})

    sums = materialize(dealt.mapInArrow(sum_up, "path string, block long, state int, then int, step long"), "json_blocks")
    begun = materialize(sums.groupBy("path").applyInArrow(in_order, "path string, block long, state int, depth long, fine boolean"), "json_states").filter("fine")

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, b, s, d in zip(*(batch[c].to_pylist() for c in ("path", "block", "state", "depth")), strict=True):
                rows = [(p, b, k, *found) for k, found in enumerate(cut(p, b, block, *STATES[s], d, name, whole))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()))], names=["path", "block", "k", "what", "wanted", "key", "json"])

    found = begun.select("path", "block", "state", "depth").repartition("path", "block").mapInArrow(cut_all, "path string, block long, k long, what string, wanted boolean, key string, json string")
    found = materialize(found, "json_elements")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = found.filter("what = 'block'").select("path", "block", F.last("wanted", True).over(earlier).alias("open"))
    mine = found.filter("what = 'element'").join(carried, ["path", "block"]).filter(F.coalesce("wanted", "open", F.lit(False)))
    counts = mine.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("k")) - 1  # what begins in one block
    numbered = mine.join(counts, ["path", "block"]).select("path", (F.col("before") + place).cast("long").alias("ord"), "key", "json")
    return numbered, found.filter("what = 'container'").select("path", F.col("key").alias("name"), "json")


def manifests(spark: SparkSession, paths: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The rows of ``documents.manifests`` for documents however large."""
    files, beside = elements(spark, paths, "files", ("root",), block)
    roots = beside.select("path", F.from_json("json", schema.ROOT).alias("root")).filter("root.id IS NOT NULL")
    each = files.withColumn("f", F.from_json("json", schema.FILE)).join(roots, "path")
    return each.select(F.col("root.id").alias("root_id"), F.col("root.kind").alias("kind"), "f.*", "ord")


def inventory(spark: SparkSession, path: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(models, locations) as ``documents.inventory`` has them, of an inventory however large."""
    each = elements(spark, [path], "models", (), block)[0].select("key", F.from_json("json", schema.MODEL).alias("m"))
    return each.select("key", "m.size", "m.display_name", "m.meta"), each.select("key", F.posexplode("m.locations").alias("ord", "l")).select("key", "l.*", F.col("ord").cast("long").alias("ord"))
