"""Byte-level BPE through a global shuffle of distinct words.

Texts are exploded into pre-tokens with their positions, chunk by chunk: a chunk (some MB of whole documents) gives its
distinct words, dealt to buckets by a hash of the word, and a row of positions (which word stands where). A bucket sees
all chunks' rows for its words one after the other and encodes each distinct word once; the ids go back to the chunk,
which puts them together by position. Decoding is a map-side join of the ids with the token-byte table, whose size is
the vocabulary's. Rows of one word are one a chunk, so the most frequent word weighs no more than any other. A worker
holds the distinct words of one bucket; their number rises with the corpus much more slowly than the corpus itself, so
from MANY_BUCKETS on the number of buckets rises with the square root of the corpus.

The words and the positions are two evaluations over the same input; a checksum of the chunk's words is carried by
both, so an input that isn't the same twice ends in an error, never in wrong ids. Give it a table, not a random sample.

Cases: null and empty text have no tokens and the digest of no bytes; repeated rows get rows of their own; an empty table
gives no rows; a document longer than a chunk is a chunk of its own; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import ship

CHUNK_BYTES = 8 << 20
BUCKET_BYTES, MANY_BUCKETS = 16 << 20, 8192
POSITIONS = (1 << 31) - 1  # sorts after all buckets
ROWS = "chunk long, bucket int, payload binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def head(checksum: int, n: int) -> bytes:
    return struct.pack("<II", checksum, n)


def head_of(raw: bytes) -> tuple[int, int]:
    return struct.unpack_from("<II", raw)


#: The pattern that pieces may be cut for as the encoder of ids cuts them (fixed value); for any other one texts stay whole.
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordCodes(tokens.PieceEncoder):
    """Numbers the pre-tokens of a chunk; texts are cut as for ids, so that the pattern runs once a piece."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.words, self.whole = False, pattern != USUAL_PATTERN
        self.codes: dict[str, int] = {}
        self.prepare()

    def cut(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (begins, ends) if self.whole else super().cut(raw, begins, ends)

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = self.codes
        own = [self.find(p) for p in pieces]
        return np.fromiter((codes.setdefault(w, len(codes)) for words in own for w in words), np.uint32), np.fromiter(map(len, own), np.int64, len(own))


class Ranks:
    """A rank file: encodes one word, and has the bytes of every id."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


_ranks: dict[tuple[str, str], Ranks] = {}


def ranks_of(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _ranks:
        _ranks[path, pattern] = Ranks(path, pattern)
    return _ranks[path, pattern]


def chunks(batches: Iterator[pa.RecordBatch], pattern: str, chunk_bytes: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, list[str], int]]:
    """(chunk id, doc_ids, number of words of each, codes, words by code, checksum). Codes go by falling frequency.

    The id is a digest of what the chunk holds; equal chunks (rows repeated in bulk) have equal rows, so sharing an id does no harm.
    """
    numberer = WordCodes(pattern)
    doc_ids: list = []
    codes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def close() -> tuple[int, list, np.ndarray, np.ndarray, list[str], int]:
        flat = np.concatenate([*codes, np.empty(0, np.uint32)]).astype(np.uint32)
        words = list(numberer.codes)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        counts = np.concatenate(sizes)
        name = hashlib.blake2b("\0".join(words).encode(), digest_size=8)
        name.update(repr(doc_ids).encode() + counts.tobytes() + flat.tobytes())
        out = int.from_bytes(name.digest(), "little", signed=True), list(doc_ids), counts, rank[flat] if len(flat) else flat, [words[i] for i in order.tolist()], zlib.crc32(name.digest())
        numberer.codes.clear()
        numberer.reset()
        doc_ids.clear()
        codes.clear()
        sizes.clear()
        return out

    for batch in batches:
        lengths = tokens.text_sizes(batch)
        for a, b in tokens.slices(lengths, chunk_bytes // 4):
            own = sum(lengths[a:b])
            if held and held + own > chunk_bytes:
                yield close()
                held = 0
            found, starts = numberer.encode(batch["text"][a:b])
            doc_ids += batch["doc_id"][a:b].to_pylist()
            codes.append(found)
            sizes.append(np.diff(starts))
            held += own
    if doc_ids:
        yield close()


def word_rows(docs: DataFrame, pattern: str, buckets: int, chunk_bytes: int) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, _, words, checksum in chunks(batches, pattern, chunk_bytes):
            raw = [w.encode() for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = []
            for group in np.split(order, cuts[1:]) if len(raw) else ():
                mine = [raw[i] for i in group.tolist()]
                lengths = np.fromiter(map(len, mine), np.uint32, len(mine))
                payload = head(checksum, len(mine)) + np.diff(group, prepend=0).astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + b"".join(mine)
                rows.append((chunk, int(bucket[group[0]]), squeeze(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "payload"])

    return docs.mapInArrow(explode, ROWS)


def position_rows(docs: DataFrame, pattern: str, chunk_bytes: int) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, doc_ids, sizes, codes, _, checksum in chunks(batches, pattern, chunk_bytes):
            known = np.array([d is not None for d in doc_ids], np.uint8)
            keys = np.array([d or 0 for d in doc_ids], "<i8")
            planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            payload = head(checksum, len(doc_ids)) + known.tobytes() + keys.tobytes() + sizes.astype("<u4").tobytes() + planes.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([POSITIONS], pa.int32()), pa.array([squeeze(payload)], pa.binary())], names=["chunk", "bucket", "payload"])

    return docs.mapInArrow(explode, ROWS)


def encode_rows(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of words (sorted by bucket) to rows of ids: each distinct word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = ranks_of(path, pattern).encode
        known: dict[bytes, list[int]] = {}
        current = -1
        for batch in batches:
            out = []
            for bucket, payload in zip(batch["bucket"].to_pylist(), batch["payload"], strict=True):
                if bucket != current:
                    known, current = {}, bucket
                raw = unsqueeze(payload.as_py())
                n = head_of(raw)[1]
                lengths = np.frombuffer(raw, "<u4", n, 8 + 4 * n)
                ends = (np.cumsum(lengths) + 8 + 8 * n).tolist()
                ids = []
                for s, e in zip([8 + 8 * n, *ends], ends, strict=False):
                    word = raw[s:e]
                    found = known.get(word)
                    if found is None:
                        known[word] = found = piece(word)
                    ids.append(found)
                sizes = np.fromiter(map(len, ids), np.uint32, n)
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                out.append(squeeze(raw[: 8 + 4 * n] + sizes.astype("<u4").tobytes() + flat.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["bucket"], pa.array(out, pa.binary())], names=["chunk", "bucket", "payload"])

    return words.mapInArrow(encode, ROWS)


def reassemble(rows: DataFrame, path: str, pattern: str, schema: str, describe) -> DataFrame:
    """Put ids in place. ``rows`` are sorted by chunk and bucket; ``describe`` makes a column list of (doc_ids, ids of each, token-byte table)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks_of(path, pattern).table
        current, parts = None, {}
        for batch in batches:
            for chunk, bucket, payload in zip(batch["chunk"].to_pylist(), batch["bucket"].to_pylist(), batch["payload"], strict=True):
                if chunk != current:
                    current, parts = chunk, {}
                raw = unsqueeze(payload.as_py())
                checksum, n = head_of(raw)
                if bucket != POSITIONS:
                    sizes = np.frombuffer(raw, "<u4", n, 8 + 4 * n)
                    parts[bucket] = checksum, np.cumsum(np.frombuffer(raw, "<u4", n, 8)), sizes, np.frombuffer(raw, "<u4", -1, 8 + 8 * n)
                    continue
                known = np.frombuffer(raw, np.uint8, n, 8)
                doc_ids = [k if ok else None for k, ok in zip(np.frombuffer(raw, "<i8", n, 8 + n).tolist(), known, strict=True)]
                counts = np.frombuffer(raw, "<u4", n, 8 + 9 * n).astype(np.int64)
                codes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 8 + 13 * n).reshape(4, -1).T).view("<u4").reshape(-1)
                words = sum(len(p[1]) for p in parts.values())
                if any(p[0] != checksum for p in parts.values()) or len(codes) and int(codes.max()) + 1 != words:
                    raise RuntimeError(f"chunk {chunk} differs between two readings of the input; write it to a table first")
                sizes, starts = np.zeros(words, np.int64), np.zeros(words, np.int64)
                base = 0
                for _, where, own, flat in parts.values():
                    sizes[where] = own
                    starts[where] = base + np.cumsum(own) - own
                    base += len(flat)
                ids_of = np.concatenate([*[p[3] for p in parts.values()], np.empty(0, "<u4")])
                each = sizes[codes]
                ends = np.cumsum(each)
                ids = ids_of[np.repeat(starts[codes] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
                doc_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
                cuts = [0, *doc_ends.tolist()]
                yield describe(doc_ids, [ids[s:e] for s, e in zip(cuts, cuts[1:], strict=False)], table)

    return rows.mapInArrow(build, schema)


def _digests(doc_ids: list, ids: list[np.ndarray], table: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(doc_ids, pa.int64()),
            "n_tokens": pa.array(map(len, ids), pa.int64()),
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(b"".join(map(table.__getitem__, x.tolist()))).hexdigest() for x in ids],
        }
    )


def _whole(doc_ids: list, ids: list[np.ndarray], table: list[bytes]) -> pa.RecordBatch:
    decoded = [b"".join(map(table.__getitem__, x.tolist())) for x in ids]
    return pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary())}
    )


def buckets_for(size: int) -> int:
    """How many buckets the words of ``size`` bytes of text are dealt to."""
    wanted = math.ceil(size / BUCKET_BYTES)
    return max(1, wanted if wanted <= MANY_BUCKETS else math.ceil(math.sqrt(wanted * MANY_BUCKETS)))


def _encoded(docs: DataFrame, path: str, pattern: str, schema: str, describe, buckets: int | None, chunk_bytes: int) -> DataFrame:
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if buckets is None:
        buckets = buckets_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    words = word_rows(docs, pattern, buckets, chunk_bytes).repartition("bucket").sortWithinPartitions("bucket")
    rows = encode_rows(words, path, pattern).unionByName(position_rows(docs, pattern, chunk_bytes))
    return reassemble(rows.repartition("chunk").sortWithinPartitions("chunk", "bucket"), path, pattern, schema, describe)


def encode_documents(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (bytes) of every document."""
    return _encoded(docs, path, pattern, "doc_id long, ids array<int>, decoded binary", _whole, buckets, chunk_bytes)


def digest_documents(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return _encoded(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, buckets, chunk_bytes)
