"""Helpers that several operators share: reading, shared scratch tables, skew-proof row numbers."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize, scratch_path

__all__ = ["documents", "materialize", "number_rows", "numbered_files", "scratch_path", "ship", "unused"]

#: Rows that one cell of ``number_rows`` holds on average, so that no task sorts an unbounded group.
ROWS_PER_CELL = 20_000


#: Rows go to Python workers in batches of so many bytes, so that neither side holds much at a time.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that they need no installation, and bound the session's batches."""
    context = spark.sparkContext
    size = spark.conf.get(BATCH, None)
    if size is None or not size.rstrip("bB").isdigit() or not 0 < int(size.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="stowage-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "stowage.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "stowage").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """part (the partition that a file was written from), file (its place among that partition's) and content of the files that Spark wrote to ``path``."""
    name = F.element_at(F.split("path", "/"), -1)
    part, file = F.regexp_extract(name, r"part-(\d+)", 1), F.regexp_extract(name, r"-c(\d+)[^-]*$", 1)
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return read.select(part.cast("long").alias("part"), F.coalesce(file.try_cast("long"), F.lit(0)).alias("file"), "content")


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, with marks behind it as long as one of ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def number_rows(
    rows: DataFrame, group: Sequence[str], salt: Sequence[str | Column], order: Sequence[str | Column], out: str, total: int
) -> DataFrame:
    """Add ``out``, a gapless number from 0 within each ``group``, without sorting a whole group in one task.

    Each group is dealt into cells by a hash of ``salt``; rows are numbered within cells, and the cells' counts,
    summed up in cell order, are their offsets. ``rows`` is read twice, so it should be a written table, and
    ``total`` (its number of rows) sets the number of cells. Which order the numbers follow is not promised.
    """
    cells = max(16, math.ceil(total / ROWS_PER_CELL))
    group = list(group)
    cell, place, base = (unused(rows.columns, n) for n in ("cell", "place", "base"))
    dealt = rows.withColumn(cell, F.pmod(F.xxhash64(*salt), F.lit(cells)))
    counts = dealt.groupBy(*group, cell).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"{k}_of" for k in (*group, cell)]
    offsets = counts.select(*[F.col(c).alias(k) for c, k in zip((*group, cell), keys, strict=True)], F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    numbered = dealt.withColumn(place, F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)) - 1)
    on = F.lit(True)
    for c, k in zip((*group, cell), keys, strict=True):
        on &= numbered[c].eqNullSafe(offsets[k])
    joined = numbered.join(offsets, on)
    return joined.select(*[numbered[f"`{c}`"] for c in rows.columns], (offsets[base] + numbered[place]).cast("long").alias(out))
