"""Reading model headers and hashing files, in Arrow batches over a list of paths."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import file_type_name, head_dim
from ..operators.ranks import numbered
from ..schema import META
from .scanner import WEIGHTS
from .scratch import materialize

#: Limits and codes of the header format (fixed values).
MAGIC, MOST_KEYS, MOST_BYTES, MOST_STRING, MOST_ITEMS = 0x46554747, 100_000, 256 << 20, 64 << 20, 1 << 22
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9


class Cursor:
    """Reads little-endian values of a header and refuses to go past its limit."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.used = file, 0

    def take(self, n: int) -> bytes:
        self.used += n
        if self.used > MOST_BYTES:
            raise ValueError("the header is too long")
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the header is cut off")
        return data

    def skip(self, n: int) -> None:
        self.used += n
        if self.used > MOST_BYTES:
            raise ValueError("the header is too long")
        self.file.seek(n, os.SEEK_CUR)

    def number(self, code: str) -> int | float | bool:
        return struct.unpack(f"<{code}", self.take(struct.calcsize(f"<{code}")))[0]

    def text(self) -> str:
        n = self.number("Q")
        if n > MOST_STRING:
            raise ValueError("a string of the header is too long")
        return self.take(n).decode("utf-8", "replace")

    def value(self, kind: int, wanted: bool) -> object:
        if kind in SCALARS:
            return self.number(SCALARS[kind])
        if kind == STRING:
            if wanted:
                return self.text()
            return self.skip(self.number("Q"))
        if kind != ARRAY:
            raise ValueError(f"value type {kind} is unknown")
        inner, n = self.number("I"), self.number("Q")
        if inner == ARRAY:
            raise ValueError("arrays of arrays are refused")
        if wanted and n > MOST_ITEMS:
            raise ValueError("an array of the header is too long")
        if not wanted and inner in SCALARS:
            return self.skip(n * struct.calcsize(f"<{SCALARS[inner]}"))
        items = [self.value(inner, wanted) for _ in range(n)]
        return items if wanted else None


def read_fields(path: str, wanted: Callable[[str], bool]) -> dict[str, object]:
    """The wanted key-value pairs of a GGUF header, version 2 or 3."""
    with open(path, "rb") as f:
        c = Cursor(f)
        if c.number("I") != MAGIC:
            raise ValueError("not a GGUF file")
        if c.number("I") not in (2, 3):
            raise ValueError("this GGUF version is not supported")
        c.number("Q")
        keys = c.number("Q")
        if keys > MOST_KEYS:
            raise ValueError("the header has too many keys")
        found = {}
        for _ in range(keys):
            key = c.text()
            take = wanted(key)
            value = c.value(c.number("I"), take)
            if take:
                found[key] = value
        return found


def header_fields(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, name, json, error) of a DataFrame with path: fields whose key ends in one of ``suffixes``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                try:
                    rows += [(path, k, json.dumps(v), None) for k, v in read_fields(path, lambda k: k.endswith(suffixes)).items()]
                except (OSError, ValueError) as e:
                    rows.append((path, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "name", "json", "error"])

    return files.select("path").mapInArrow(read, "path string, name string, json string, error string")


#: What the catalog keeps of a header: column, suffix after the architecture.
META_SUFFIXES = (("context_length", ".context_length"), ("block_count", ".block_count"), ("embedding_length", ".embedding_length"), ("head_count", ".attention.head_count"), ("head_count_kv", ".attention.head_count_kv"), ("key_length", ".attention.key_length"))


def model_meta(files: DataFrame) -> DataFrame:
    """path and the header's facts. A per-layer array is no single number and gives null, as does a negative one; without a
    field of the model's own architecture, the first by name of another word with the same suffix is taken."""
    fields = header_fields(files, ("general.architecture", "general.name", "general.size_label", "general.file_type", *(s for _, s in META_SUFFIXES))).filter("name IS NOT NULL")
    own = fields.filter("name = 'general.architecture'").select("path", F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v").alias("architecture"))
    value = F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v")
    number = F.when(~F.col("json").startswith("["), value.try_cast("long"))
    rows = fields.join(own, "path", "left").withColumns({"text": value, "number": F.when(number >= 0, number)})
    pick = {}
    for column, suffix in META_SUFFIXES:
        exact = F.col("name") == F.concat("architecture", F.lit(suffix))
        word = F.col("name").endswith(suffix) & ~F.expr(f"left(name, length(name) - {len(suffix)})").contains(".")
        pick[column] = F.min_by("number", F.when(exact | word, F.struct(~F.coalesce(exact, F.lit(False)), "name")))
    general = {c: F.max(F.when(F.col("name") == f"general.{c}", F.col("text"))) for c in ("name", "size_label")}
    kind = F.max(F.when(F.col("name") == "general.file_type", F.col("number")))
    out = rows.groupBy("path", "architecture").agg(*[c.alias(n) for n, c in {**general, **pick, "file_type": kind}.items()])
    quant = F.when(F.col("file_type").isNotNull(), file_type_name(F.col("file_type")))
    return out.withColumns({"quantization": quant, "head_dim": head_dim(F.col("key_length"), F.col("embedding_length"), F.col("head_count"))}).drop("file_type", "key_length")


def weights_meta(path: str) -> dict[str, object] | None:
    """What a config.json beside weights says; None if it says nothing."""
    try:
        with open(os.path.join(os.path.dirname(path), "config.json"), encoding="utf-8") as f:
            c = json.load(f)
    except (OSError, ValueError):
        return None
    c = c if isinstance(c, dict) else {}
    text = lambda k: c[k] if isinstance(c.get(k), str) else None
    length = c.get("max_position_embeddings")
    found = {"architecture": text("model_type"), "name": text("_name_or_path"), "context_length": length if isinstance(length, int) and length >= 0 else None}
    return found if any(v is not None for v in found.values()) else None


def file_meta(files: DataFrame) -> DataFrame:
    """(path, meta) of a DataFrame with path and kind (of the root) for every file that has facts: those of its own header, or
    of the config.json beside weights. Blobs of an ollama store are read whatever their name is."""
    files = files.select("path", "kind").distinct()
    is_gguf = F.lower("path").rlike(r"[^/]\.gguf$") | (F.col("kind") == "ollama")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p, **m} for p in batch["path"].to_pylist() if (m := weights_meta(p))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"path": pa.string(), "architecture": pa.string(), "name": pa.string(), "context_length": pa.int64()}))

    weights = files.filter(~is_gguf & F.lower("path").rlike("|".join(rf"\{w}$" for w in WEIGHTS))).select("path").distinct()
    beside = weights.mapInArrow(read, "path string, architecture string, name string, context_length long")
    facts = model_meta(files.filter(is_gguf).select("path").distinct()).unionByName(beside, allowMissingColumns=True)
    return facts.select("path", F.struct(*META.fieldNames()).cast(META).alias("meta"))


#: A read of a file, and how often a long one tells how far it is.
HASHED = "path string, sha256 string, error string, gone boolean, bytes long, seconds double"
HASHED_COLUMNS = [c.split(" ")[0] for c in HASHED.split(", ")]
BLOCK, TOLD_EVERY = 4 << 20, 64 << 20
PROGRESS = "path string, event string, done long, total long, at double"
CHANGED = "it changed while it was read"


def identity(s: os.stat_result) -> tuple:
    return s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_dev, s.st_ino


def read_whole(path: str, fingerprint: tuple | None = None, tell: Callable[[str, int, int], None] = lambda *_: None, block: int = BLOCK, every: int = TOLD_EVERY) -> tuple:
    """A row of HASHED. A file that isn't what ``fingerprint`` says, or another before than after the reading, has an error and no hash."""
    h, began, done, told = hashlib.sha256(), time.monotonic(), 0, 0
    error, gone = None, False
    try:
        with open(path, "rb") as f:
            before = identity(os.fstat(f.fileno()))
            tell("start", 0, before[0])
            while piece := f.read(block):
                h.update(piece)
                done += len(piece)
                if done - told >= every:
                    told = done
                    tell("progress", done, before[0])
        if identity(os.stat(path)) != before or done != before[0] or fingerprint is not None and fingerprint != before:
            error = CHANGED
    except OSError as e:
        error, gone = str(e), isinstance(e, FileNotFoundError | NotADirectoryError)
    tell("failed" if error else "done", done, done)
    return path, None if error else h.hexdigest(), error, gone, done, time.monotonic() - began


def reader_of(place: Column, readers: int) -> Column:
    """Who of ``readers`` reads the file at ``place`` of a root's, the longest first: they are dealt to and fro."""
    at = place % (2 * readers)
    return F.when(at < readers, at).otherwise(2 * readers - 1 - at).cast("int")


def dealt_by_bytes(files: DataFrame, readers: int, bounded: bool = False) -> DataFrame:
    """``files`` (root_id, size) dealt to ``readers`` tasks a root so that each has about as many bytes: the longest first, to and fro.

    ``bounded``: there are few enough files for a window a root.
    """
    if bounded:
        placed = files.withColumn("place", F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("size"), "path")) - 1)
    else:
        placed = numbered(materialize(files.withColumn("less", -F.col("size")), "to_read"), "root_id", ["less", "path"]).drop("less")
    placed = placed.withColumn("reader", reader_of(F.col("place"), readers)).drop("place")
    roots = [r[0] for r in placed.select("root_id").distinct().collect()]  # as many as there are roots
    if not roots:
        return placed
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(sorted(roots, key=str)) for x in (str(r), i)]), F.coalesce(F.col("root_id").cast("string"), F.lit("None")))
    return placed.repartitionById(readers * len(roots), (number * readers + F.col("reader")).cast("int"))


def hash_files(files: DataFrame, readers: int = 4, progress: str | None = None, tasks: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of HASHED of each path: whole files in blocks; gone where there is no such file; a file that changes meanwhile has an error.

    ``readers`` tasks at a time read from one root (column root_id; without it there is one root), which spares disks, and have
    equal bytes where there is a column size. With a column fingerprint, a file must be what it says. ``progress`` is a folder that
    executors and driver have mounted: tasks write there what they are at (``reading_progress``). ``tasks``: the files are dealt
    already, a column task says to which of so many. The columns ``keep`` are handed on before the others.
    """
    known = "fingerprint" in files.columns
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = None
        if progress is not None:
            os.makedirs(progress, exist_ok=True)
            log = open(os.path.join(progress, f"{uuid.uuid4().hex}.jsonl"), "a", buffering=1, encoding="utf-8")  # noqa: SIM115
        for batch in batches:
            prints = batch["fingerprint"].to_pylist() if known else [None] * len(batch)
            for at, (path, p) in enumerate(zip(batch["path"].to_pylist(), prints, strict=True)):
                tell = (lambda event, done, total, path=path: log.write(json.dumps({"path": path, "event": event, "done": done, "total": total, "at": time.time()}) + "\n")) if log else (lambda *_: None)
                expected = None if p is None else (p["size"], p["mtime_s"], p["mtime_nsec"], int(p["dev"]), int(p["ino"]))
                row = read_whole(path, expected, tell)
                kept = [batch[c].slice(at, 1) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([v], kind) for v, kind in zip(row, kinds, strict=True))], names=[*keep, *HASHED_COLUMNS])
        if log:
            log.close()

    wanted = [*dict.fromkeys(["path", *(["fingerprint"] if known else []), *keep])]
    told = T.StructType([files.schema[c] for c in keep] + T.StructType.fromDDL(HASHED).fields)
    if tasks is not None:
        return files.repartitionById(tasks, F.col("task")).select(*wanted).mapInArrow(digest, told)
    own = [c for c in wanted if c not in ("root_id", "size")]
    rows = files.select(*own, F.col("root_id") if "root_id" in files.columns else F.lit("").alias("root_id"), F.coalesce("size", F.lit(0)).alias("size") if "size" in files.columns else F.lit(0).alias("size"))
    return dealt_by_bytes(rows, readers).select(*wanted).mapInArrow(digest, told)


def reading_progress(spark: SparkSession, folder: str) -> DataFrame:
    """(path, event, done, total, at): what the readers have told so far: start, progress every 64 MiB, then done or failed."""
    if not os.path.isdir(folder):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).json(f"file://{os.path.abspath(folder)}")
