"""Token counts of documents by a separator scan over flat token files.

The files hold 16-bit little-endian ids and nothing else: every document's ids and then the end-of-document id, with no
index. Spark's text writer makes them: a row is a block of documents with end ids between them, the two bytes of the end
id are its line separator, and a file ends after ROWS_PER_FILE rows. (The writer puts the bytes of a string as they are,
which a test holds.) The scan looks at
fixed-size blocks of a file, finds the end ids in each with one vector comparison, and gives, by block, the place of
its first and last end id and the lengths between; a prefix scan over blocks brings the last end before each block to
it, which gives the length of the document that runs across the boundary, and the number of documents before it.

Cases: a null or empty text is a document of 0 tokens; repeated rows are documents of their own; an empty table gives
no rows; a file without a last end id has an unfinished document, which is counted too; other columns are ignored. A
file is read as a whole; it has some 100 MB, however large the table, unless single documents have that many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, numbered_files, scratch_path, ship

END_ID = 50256
BLOCK_IDS = 1 << 18
#: Bytes of text that a written row takes together, and rows of a file.
ROW_BYTES, ROWS_PER_FILE = 2 << 20, 64


def write_flat_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, row_bytes: int = ROW_BYTES, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write flat files under ``path`` in the order of the table ``docs``. Returns (part, place, doc_id, n_bytes): which document stands where."""
    ship(docs.sparkSession)

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in batches:
            lengths = tokens.text_sizes(batch)
            for a, b in tokens.slices(lengths, row_bytes):
                ids, starts = encode(batch["text"][a:b])
                if len(ids) and int(ids.max()) >= end_id:
                    raise ValueError("an id is not below the end id")
                joined = np.insert(ids.astype("<u2"), starts[1:-1], np.uint16(end_id))  # the writer ends the last document
                yield pa.RecordBatch.from_arrays([pa.array([joined.tobytes()], pa.binary())], names=["ids"])

    end = end_id.to_bytes(2, "little").decode("iso-8859-1")
    out = docs.select("text").mapInArrow(encode_all, "ids binary").select(F.col("ids").cast("string").alias("value"))
    out.write.option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", rows_per_file).text(path)
    # Files have the number of the partition that they were written from, and the table's partitions are the same at every scan.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return docs.select(F.spark_partition_id().cast("long").alias("part"), place.alias("place"), F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))


def running_total(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``order`` and before: the sum of ``value`` over earlier rows. ``rows`` has one row a file, partition or thousands of documents."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*order, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("before"))


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """part (of the files), place (in them), ordinal, start (ids and end ids before it) and n_tokens (without the end id) of every document in the files."""
    ship(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, block, is_last, content in zip(*(batch[c].to_pylist() for c in ("part", "file", "block", "is_last")), batch["content"], strict=True):
                own, at = np.frombuffer(content.as_buffer(), "<u2"), block * block_ids
                ends = np.flatnonzero(own == end_id) + at
                if is_last and own[-1] != end_id:
                    ends = np.append(ends, at + len(own))
                first, close = (int(ends[0]), int(ends[-1])) if len(ends) else (None, None)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int64()),
                        "file": pa.array([file], pa.int64()),
                        "block": pa.array([block], pa.int64()),
                        "first": pa.array([first], pa.int64()),
                        "last": pa.array([close], pa.int64()),
                        "ends": pa.array([len(ends)], pa.int64()),
                        "inner": pa.array([(np.diff(ends) - 1).tolist()], pa.list_(pa.int64())),
                        "inner_at": pa.array([(ends[:-1] + 1).tolist()], pa.list_(pa.int64())),
                        "size": pa.array([len(own)], pa.int64()),
                    }
                )

    # Files are cut into blocks before they go to Python, so no worker holds more than some blocks.
    size, step = F.octet_length("content"), 2 * block_ids
    cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")), lambda i: F.substr("content", i * step + 1, F.lit(step)))
    files = numbered_files(spark, path).filter(size > 0)
    pieces = files.select("part", "file", F.ceil(size / step).alias("n"), F.posexplode(cut).alias("block", "content"))
    pieces = pieces.select("part", "file", "block", (F.col("block") == F.col("n") - 1).alias("is_last"), "content")
    blocks = materialize(pieces.mapInArrow(scan, "part long, file long, block long, first long, last long, ends long, inner array<long>, inner_at array<long>, size long"), "blocks")
    # The prefix scan: within files over blocks, across files over sums.
    earlier = Window.partitionBy("part", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.select(
        "part",
        "file",
        "first",
        "inner",
        "inner_at",
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("open"),
        F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("docs_before"),
    ).filter(F.col("first").isNotNull())
    files_of = blocks.groupBy("part", "file").agg(F.sum("ends").alias("docs"), F.sum("size").alias("ids"))
    base = running_total(files_of, ["part", "file"], "docs").withColumnRenamed("before", "docs_base").join(running_total(files_of, ["part", "file"], "ids").withColumnRenamed("before", "ids_base"), ["part", "file"])
    base = base.withColumn("part_base", F.min("docs_base").over(Window.partitionBy("part")))
    each_doc = F.arrays_zip(F.concat(F.array(F.col("open") + 1), "inner_at").alias("at"), F.concat(F.array(F.col("first") - F.col("open") - 1), "inner").alias("n"))
    each = stitched.withColumn("found", each_doc).join(base, ["part", "file"]).select("part", "part_base", "docs_base", "docs_before", "ids_base", F.posexplode("found").alias("k", "doc"))
    ordinal = F.col("docs_base") + F.col("docs_before") + F.col("k")
    return each.select("part", (ordinal - F.col("part_base")).alias("place"), ordinal.alias("ordinal"), (F.col("ids_base") + F.col("doc.at")).alias("start"), F.col("doc.n").alias("n_tokens"))


def document_token_counts(docs: DataFrame, vocabulary: str, row_bytes: int = ROW_BYTES, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """doc_id, ordinal, start and n_tokens of every document of a table, counted from flat files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "flat_tokens")
    order = write_flat_files(docs, vocabulary, path, row_bytes=row_bytes, rows_per_file=rows_per_file)
    met = count_tokens(spark, path).join(order, ["part", "place"], "full")
    fits = F.col("n_tokens").isNotNull() & F.col("n_bytes").isNotNull() & (F.col("n_tokens") <= F.col("n_bytes")) & ((F.col("n_tokens") == 0) == (F.col("n_bytes") == 0))
    sure = F.when(fits, F.col("n_tokens")).otherwise(F.raise_error(F.lit("the table was not the same at two scans; write it to files first")).cast("long"))
    return met.select("doc_id", "ordinal", "start", sure.alias("n_tokens"))
