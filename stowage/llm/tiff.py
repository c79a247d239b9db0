"""TIFF media columns: walk image directories, undo PackBits, LZW or deflate and predictors, one row per page.

``pages_of`` reads classic TIFF of either byte order, strips and tiles, 1, 2, 4, 8 or 16 bits a sample, chunky or planar.
``write_gray`` stores bytes as 8-bit gray pages, so that any payload makes the round trip; ``store_texts`` takes the
compression, the predictor, strips or tiles and the byte order from a hash of the text, and as many pages as it needs.
``digest_of`` puts the pages of a file, which follow each other within a task, together again.

Cases: a null file, one that is no TIFF, or a broken directory gives one row with page -1 and the reason in ``error``; a
page that can't be decoded (also one that claims more pixels than its data can hold) gives such a row with its own
number, and the walk goes on; samples of less than 8 bits come as a byte each; a directory loop ends the walk; null text
is stored as empty text; equal texts give equal files and values; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from . import tokens
from .common import ship

#: Pixels of a stored row, rows of a page, of a strip and of a tile, and pixels across a tile.
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE_ROWS, TILE_COLUMNS = 64, 512, 128, 64, 32
#: Fixed values of the format: bytes of each field type, and the tags in use.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: No compression makes more bytes out of one (LZW: 4096 bytes out of 12 bits).
MOST_EXPANSION = 2800
#: Bytes of a page's pixels at most, as a value of a row has no more.
MOST_PAGE = (1 << 31) - 1
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def undo_packbits(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def do_packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(run.start())
        out += bytes((257 - len(run[0]), run[0][0]))
        at = run.end()
    literal(len(data))
    return bytes(out)


def undo_lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; widths grow one code early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table: list[bytes] = []
    out: list[bytes] = []
    held = bits = made = 0
    width, limit, last = 9, 511, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            table, width, limit, last = base.copy(), 9, 511, b""
            continue
        if code == 257 or made >= most:
            break
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("a code beyond the LZW table")
        out.append(entry)
        made += len(entry)
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= limit and width < 12:
            width += 1
            limit = (1 << width) - 1
    return b"".join(out)


def undo_deflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


def do_lzw(data: bytes) -> bytes:
    held = bits = 0
    out = bytearray()
    width, table = 9, {bytes((i,)): i for i in range(256)}
    following = 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4095:
            put(256)
            width, table, following = 9, {bytes((i,)): i for i in range(256)}, 258
        elif following + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


UNDO = {NONE: lambda data, most: bytes(data), LZW: undo_lzw, DEFLATE: undo_deflate, OLD_DEFLATE: undo_deflate, PACKBITS: undo_packbits}
DO = {NONE: bytes, LZW: do_lzw, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: do_packbits}


def write_gray(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tiled: bool = False, order: str = "<", page_rows: int = PAGE_ROWS) -> bytes:
    """8-bit gray pages of WIDTH pixels across and up to ``page_rows`` rows, in strips or tiles. ``payload`` is a multiple of WIDTH bytes."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    file = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4  # where the place of the next directory is to be written
    down, across = (TILE_ROWS, TILE_COLUMNS) if tiled else (STRIP_ROWS, WIDTH)
    for top in range(0, max(1, len(pixels)), page_rows):
        page = pixels[top : top + page_rows]
        places, sizes = [], []
        for y in range(0, len(page), down):
            for x in range(0, WIDTH, across):
                part = page[y : y + down, x : x + across]
                if tiled and len(part) < down:
                    part = np.concatenate([part, np.zeros((down - len(part), across), np.uint8)])
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.uint8(0)).astype(np.uint8)
                data = DO[compression](part.tobytes())
                places.append(len(file))
                sizes.append(len(data))
                file += data
        layout = [(TILE_WIDTH, across), (TILE_LENGTH, down)] if tiled else [(ROWS_PER_STRIP, down)]
        fields = {IMAGE_WIDTH: [WIDTH], IMAGE_LENGTH: [len(page)], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor], **{t: [v] for t, v in layout}}
        fields |= {TILE_OFFSETS: places, TILE_BYTES: sizes} if tiled else {STRIP_OFFSETS: places, STRIP_BYTES: sizes}
        entries = []
        for tag, values in sorted(fields.items()):
            long = tag in (IMAGE_WIDTH, IMAGE_LENGTH) or len(values) > 1 or max(values) > 65535
            data = struct.pack(f"{order}{len(values)}{'I' if long else 'H'}", *values)
            if len(data) > 4:
                place = len(file)
                file += data
                data = struct.pack(f"{order}I", place)
            entries.append(struct.pack(f"{order}HHI", tag, 4 if long else 3, len(values)) + data.ljust(4, b"\0"))
        file += bytes(len(file) % 2)
        struct.pack_into(f"{order}I", file, link, len(file))
        file += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(file)
        file += bytes(4)
    return bytes(file)


def directories(file: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """The byte order and the whole-number fields of every image directory, in the order of their chain."""
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if order is None or struct.unpack_from(f"{order}H", file, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", file, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(f"{order}H", file, at)[0]
        fields = {}
        for i in range(count):
            tag, kind, n, _ = struct.unpack_from(f"{order}HHII", file, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            if n * TYPE_BYTES.get(kind, 0) > 4:
                place = struct.unpack_from(f"{order}I", file, place)[0]
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code and n:
                fields[tag] = struct.unpack_from(f"{order}{n}{code}", file, place)
        yield order, fields
        at = struct.unpack_from(f"{order}I", file, at + 2 + 12 * count)[0]


def decode_page(file: bytes, order: str, fields: dict[int, tuple[int, ...]], seen: Claims | None = None) -> np.ndarray:
    """Samples as (rows, columns, samples a pixel)."""
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples = one(IMAGE_WIDTH, 0), one(IMAGE_LENGTH, 0), one(SAMPLES, 1)
    bits, planar, predictor = one(BITS, 1), one(PLANAR, 1) == 2, one(PREDICTOR, 1)
    if bits not in (1, 2, 4, 8, 16) or predictor not in ((1, 2) if bits >= 8 else (1,)):
        raise ValueError(f"{bits} bits a sample with predictor {predictor} are not supported")
    undo = UNDO.get(one(COMPRESSION, 1))
    if undo is None:
        raise ValueError(f"compression {one(COMPRESSION, 1)} is not supported")
    if bits < 8 and one(FILL_ORDER, 1) != 1:
        raise ValueError("a fill order of 2 is not supported")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    tiled = TILE_OFFSETS in fields
    across = one(TILE_WIDTH, width) if tiled else width
    down = one(TILE_LENGTH, height) if tiled else min(one(ROWS_PER_STRIP, height), height)
    offsets, sizes = (fields[TILE_OFFSETS], fields[TILE_BYTES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_BYTES])
    if min(width, height, samples, across, down) < 1:
        raise ValueError("a page without pixels")
    depth, planes = (1, samples) if planar else (samples, 1)
    if not len(offsets) == len(sizes) == planes * -(-height // down) * -(-width // across):
        raise ValueError("the strips or tiles don't make up the page")
    there = sum(max(0, min(size, len(file) - start)) for start, size in zip(offsets, sizes, strict=True))
    part_bytes = down * -(-across * depth * bits // 8)
    pixels = height * width * samples * kind.itemsize
    if max(part_bytes * len(offsets), pixels) > MOST_PAGE:
        raise ValueError("the page is too large for a row")
    if max(part_bytes * len(offsets), pixels // (8 if bits < 8 else 1)) > MOST_EXPANSION * there:
        raise ValueError("the page claims more pixels than its data can hold")
    if seen is not None:
        seen.add(pixels // (8 if bits < 8 else 1), zip(offsets, sizes, strict=True), len(file))
    page = np.zeros((height, width, samples), kind)
    grid = ((plane, y, x) for plane in range(planes) for y in range(0, height, down) for x in range(0, width, across))
    for (plane, y, x), start, size in zip(grid, offsets, sizes, strict=True):
        rows = down if tiled else min(down, height - y)
        wide = -(-across * depth * bits // 8)  # rows begin at whole bytes
        raw = undo(file[start : start + size], rows * wide)
        if bits < 8:
            packed = np.frombuffer(raw, np.uint8, rows * wide).reshape(rows, wide, 1) >> np.arange(8 - bits, -1, -bits, dtype=np.uint8) & np.uint8((1 << bits) - 1)
            part = packed.reshape(rows, -1)[:, : across * depth].reshape(rows, across, depth)
        else:
            part = np.frombuffer(raw, kind, rows * across * depth).reshape(rows, across, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        target = page[y : y + rows, x : x + across]
        part = part[: target.shape[0], : target.shape[1]]
        if planar:
            target[:, :, plane] = part[:, :, 0]
        else:
            target[:] = part
    return page


class Claims:
    """What the pages of one file have claimed together. Strips that several pages share hold their pixels once, so such pages can't go on for ever."""

    def __init__(self) -> None:
        self.claimed, self.strips, self.there = 0, set(), 0

    def add(self, pixels: int, strips: Iterable[tuple[int, int]], size: int) -> None:
        for start, length in set(strips) - self.strips:
            self.strips.add((start, length))
            self.there += max(0, min(length, size - start))
        self.claimed += pixels
        if self.claimed > MOST_EXPANSION * min(self.there, size):
            raise TooMuch("the pages claim more pixels than the file can hold")


class TooMuch(ValueError):
    """The walk of a file ends with this."""


def feature_of(page: np.ndarray, bits: int = 0) -> str:
    """Size, mean and the counts of samples in eight equal ranges of value."""
    bits = bits or 8 * page.dtype.itemsize
    flat = page.reshape(-1) >> (bits - 3) if bits > 3 else page.reshape(-1) << (3 - bits)
    counts = np.bincount(flat.astype(np.int64), minlength=8)
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]};mean={int(page.sum(dtype=np.int64)) * 1000 // max(1, page.size)};hist={','.join(map(str, counts))}"


#: What a damaged file may end in.
BROKEN = (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error)
PAGE = [("page", IntegerType()), ("width", IntegerType()), ("height", IntegerType()), ("samples", IntegerType()), ("bits", IntegerType()), ("pixels", BinaryType()), ("feature", StringType()), ("error", StringType())]


def pages(file: bytes) -> Iterator[tuple]:
    """The values of PAGE for every page of a file."""
    nothing = (None,) * 6
    try:
        claims = Claims()
        for n, (order, fields) in enumerate(directories(file)):
            try:
                page, bits = decode_page(file, order, fields, claims), fields.get(BITS, (1,))[0]
                yield n, page.shape[1], page.shape[0], page.shape[2], bits, page.tobytes(), feature_of(page, bits), None
            except BROKEN as e:
                yield n, *nothing, str(e) or type(e).__name__
                if isinstance(e, TooMuch):
                    return
    except BROKEN as e:
        yield -1, *nothing, str(e) or type(e).__name__


def pages_of(files: DataFrame, content: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per page: the columns ``keep``, page, width, height, samples, bits, pixels (as stored, rows one after the other), feature, error.

    The rows of a file follow each other, in the order of its directories.
    """
    ship(files.sparkSession)
    keep = list(keep)
    own = [f"own{i}" for i in range(len(keep))]
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            size = 0

            def flush() -> pa.RecordBatch:
                columns = [batch[c].take(pa.array(at)) for c in own] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                rows.clear()
                at.clear()
                return pa.RecordBatch.from_arrays(columns, names=[*own, *(n for n, _ in PAGE)])

            for i, file in enumerate(batch["content"]):
                for row in pages(file.as_py() or b""):
                    rows.append(row)
                    at.append(i)
                    size += len(row[5] or b"")
                    if size > 4 << 20:
                        yield flush()
                        size = 0
            if rows:
                yield flush()

    named = files.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)], F.col(f"`{content}`").alias("content"))
    found = named.mapInArrow(read, StructType([*named.select(*own).schema.fields, *[StructField(n, t) for n, t in PAGE]]))
    return found.select(*[F.col(o).alias(c) for c, o in zip(keep, own, strict=True)], *[n for n, _ in PAGE])


def layout_of(payload: bytes) -> dict[str, object]:
    """Compression, predictor, strips or tiles and byte order of a payload, by its checksum: half deflate, a quarter LZW, a quarter PackBits."""
    h = zlib.crc32(payload)
    return {"compression": (DEFLATE, LZW, DEFLATE, PACKBITS)[h % 4], "predictor": 1 + (h >> 2) % 2, "tiled": bool((h >> 3) % 2), "order": "<>"[(h >> 4) % 2]}


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a TIFF file) of every row."""
    ship(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = tokens.text_sizes(batch)
            for a, b in tokens.slices(lengths, 4 << 20):
                raw = [(t.as_py() or "").encode() for t in batch["text"][a:b]]
                payloads = [x + bytes(-len(x) % WIDTH if x else WIDTH) for x in raw]
                media = [write_gray(x, **layout_of(x)) for x in payloads]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def digest_of(stored: DataFrame) -> DataFrame:
    """What is read back from the stored media: payload and media digests, the features of the pages and their number."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    files = stored.select(F.monotonically_increasing_id().alias("file"), "doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pages of a file follow each other, also across batches."""
        current, done = None, []

        def close() -> None:
            _, doc_id, n_bytes, media_bytes, media_sha256, digest, length, tail, features = current
            done.append((doc_id, n_bytes, length, digest.hexdigest(), zlib.crc32(tail), media_bytes, media_sha256, "|".join(features), len(features)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for file, *rest, pixels, feature, error in zip(*(batch[c].to_pylist() for c in ("file", "doc_id", "n_bytes", "media_bytes", "media_sha256")), batch["pixels"], batch["feature"].to_pylist(), batch["error"].to_pylist(), strict=True):
                if error is not None:
                    raise RuntimeError(f"a stored page can't be read back: {error}")
                if current is None or current[0] != file:
                    if current is not None:
                        close()
                    current = [file, *rest, hashlib.sha256(), 0, b"", []]
                data = pixels.as_buffer()
                current[5].update(data)
                current[6] += len(data)
                current[7] = bytes(data[-64:])
                current[8].append(feature)
            if len(done) >= 1000:
                yield flush()
        if current is not None:
            close()
        if done:
            yield flush()

    found = pages_of(files, "media", ["file", "doc_id", "n_bytes", "media_bytes", "media_sha256"]).select("file", "doc_id", "n_bytes", "media_bytes", "media_sha256", "pixels", "feature", "error")
    return found.mapInArrow(fold, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
