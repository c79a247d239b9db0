"""Token files of transposed blocks: fixed-size id blocks as bit or byte planes, each plane compressed with zstandard.

A file is a run of segments, each: magic, length of the whole segment, header, document table, chunk index, planes, and a
closing newline. The chunk index has, for every block, its number of ids and the compressed size of each plane, so a
reader finds any block without touching others. Spark's own text writer puts the bytes to storage (a segment is a row,
the newline its end; it puts the bytes of a string as they are, which a test holds), hence the committers and every file
system that Spark knows work, and a lost task leaves no half file; a file ends after SEGMENTS_PER_FILE segments, so its
size doesn't grow with the table, and Spark's binaryFile reader brings it back as a whole.

Cases: null and empty text are documents of the end id alone; null doc_ids come first; repeated rows are documents of
their own; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, numbered_files, scratch_path, ship

MAGIC = b"STOWPLN1"
HEAD = struct.Struct("<8sQIIIBQI")  # magic, segment bytes, ids a block, documents, blocks, bits a plane, ids, bytes of the document table
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
SEGMENTS_PER_FILE = 64


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """32-bit ids as 4 byte planes or 32 bit planes, lowest first."""
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        return [np.ascontiguousarray(as_bytes[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, plane_bits: int) -> np.ndarray:
    if plane_bits == 8:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").reshape(-1)[:n]
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS, plane_bits: int = 8) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    table = squeeze(known.tobytes() + keys.tobytes() + sizes.astype("<u8").tobytes())
    index, body = [], []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        planes = [squeeze(p) for p in to_planes(block, plane_bits)]
        index.append(np.array([len(block), *map(len, planes)], "<u4").tobytes())
        body += planes
    rest = [table, *index, *body, b"\n"]
    total = HEAD.size + sum(map(len, rest))
    return HEAD.pack(MAGIC, total, block_ids, len(doc_ids), len(index), plane_bits, len(ids), len(table)) + b"".join(rest)


def read_segments(file: bytes | memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, ids) of each segment of a file."""
    at = 0
    while at < len(file):
        magic, total, _, docs, blocks, plane_bits, n_ids, table_size = HEAD.unpack_from(file, at)
        if magic != MAGIC or file[at + total - 1 : at + total] != b"\n":
            raise ValueError(f"no token segment at byte {at}")
        undo = zstandard.ZstdDecompressor().decompress
        p = at + HEAD.size
        table = undo(file[p : p + table_size], max_output_size=17 * docs)
        p += table_size
        planes = 32 // plane_bits
        index = np.frombuffer(file, "<u4", blocks * (planes + 1), p).reshape(blocks, planes + 1)
        p += index.nbytes
        parts = []
        for row in index.tolist():
            got = []
            for size in row[1:]:
                got.append(undo(file[p : p + size], max_output_size=row[0]))
                p += size
            parts.append(from_planes(got, row[0], plane_bits))
        ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
        if len(ids) != n_ids:
            raise ValueError(f"segment at byte {at} has {len(ids)} ids, not {n_ids}")
        known = np.frombuffer(table, np.uint8, docs)
        keys = np.frombuffer(table, "<i8", docs, docs).tolist()
        yield [k if ok else None for k, ok in zip(keys, known, strict=True)], np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64), ids
        at += total


def write_token_files(
    docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS, plane_bits: int = 8, segment_ids: int = SEGMENT_IDS, segments_per_file: int = SEGMENTS_PER_FILE
) -> None:
    """Write the ids of whole texts, ``end_id`` after each, to files under ``path`` in ascending doc_id order."""
    ship(docs.sparkSession)

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], np.int64)
            segment = write_segment(names, sizes, np.concatenate(held), block_ids, plane_bits)
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([segment[:-1]], pa.binary())], names=["segment"])  # the writer ends the line

        count = 0
        for batch in batches:
            lengths = tokens.text_sizes(batch)
            for a, b in tokens.slices(lengths, min(2 << 20, 4 * segment_ids)):
                ids, starts = encode(batch["text"][a:b])
                names += batch["doc_id"][a:b].to_pylist()
                held += [np.append(ids[s:e], np.uint32(end_id)) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                count += len(ids)
                if count >= segment_ids:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    text_hash = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", text_hash).sortWithinPartitions("doc_id", text_hash)
    ordered.mapInArrow(encode_all, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", segments_per_file).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(batch["part"].to_pylist(), batch["file"].to_pylist(), batch["content"], strict=True):
                start = 0
                for doc_ids, sizes, ids in read_segments(memoryview(content.as_buffer())):
                    ends = np.cumsum(sizes)
                    crcs = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {"part": [part] * len(doc_ids), "file": [file] * len(doc_ids), "doc_id": pa.array(doc_ids, pa.int64()), "local": pa.array(start + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crcs, pa.int64())}
                    )
                    start += int(sizes.sum())

    schema = "part long, file long, doc_id long, local long, n_tokens long, ids_crc32 long"
    found = materialize(numbered_files(spark, path).mapInArrow(decode, schema), "documents_of_files")
    totals = found.groupBy("part", "file").agg(F.sum("n_tokens").alias("total"))  # one row a file
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return found.join(bases, ["part", "file"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, **layout: int) -> DataFrame:
    """What ``read_token_files`` finds in files of ``docs``; ``layout`` as in ``write_token_files``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token_files")
    write_token_files(docs, vocabulary, path, **layout)
    return read_token_files(spark, path)
