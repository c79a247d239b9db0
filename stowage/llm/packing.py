"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the plan is made for counts of lengths, not for documents: items above
a third of the capacity pair at most twice per bin by greedy matching (the largest left takes the largest that fits),
smaller ones, in descending order, each go to the fullest bin that has room. The plan lists, for every length, ranges of
item numbers and the bins they go to; its size depends on the capacity alone. Items are numbered within their length
in a distributed way and look their bin up.

Cases: null text is an empty document, of the end id alone; longer documents than the capacity are cut into pieces of
the capacity, the last one may be shorter; repeated rows are packed each for itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, number_rows, ship, unused

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and cut what is longer than ``capacity``."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in batches:
            lengths = tokens.text_sizes(batch)
            for a, b in tokens.slices(lengths, 2 << 20):
                ids, starts = encode(batch["text"][a:b])
                rows = []
                for doc, s, e in zip(batch["doc_id"][a:b].to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = np.append(ids[s:e], np.uint32(end_id)).astype("<u4")
                    rows += [(doc, k, at, len(x), zlib.crc32(x.tobytes())) for k, at in enumerate(range(0, len(own), capacity)) for x in (own[at : at + capacity],)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in them, number of such bins), for ``counts`` of each length."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    done: list[tuple[tuple[int, ...], int]] = []
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def keep(lengths: tuple[int, ...], bins: int) -> None:
        gap = capacity - sum(lengths)
        if not bins:
            return
        if not gap:
            done.append((lengths, bins))
            return
        if gap not in open_bins:
            open_bins[gap] = []
            insort(gaps, gap)
        open_bins[gap].append((lengths, bins))

    while large:  # the largest takes the largest partner that fits
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at < 0:
            keep((n,), left[n])
            bins = left[n]
        else:
            m = large[at]
            bins = left[n] // 2 if m == n else min(left[n], left[m])
            if not bins:  # a last one of its own kind
                smaller = at - 1
                if smaller >= 0:
                    m, bins = large[smaller], 1
                    keep((n, m), 1)
                    left[m] -= 1
                    if not left[m]:
                        large.remove(m)
                else:
                    keep((n,), 1)
                    bins = 1
            else:
                keep((n, m), bins)
                left[m] -= bins
                if m != n and not left[m]:
                    large.remove(m)
        left[n] -= bins
        if not left[n]:
            large.remove(n)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(gaps, n)
            if at == len(gaps):  # no room: new bins
                each = capacity // n
                keep((n,) * each, count // each)
                keep((n,) * (count % each), 1 if count % each else 0)
                break
            gap = gaps[at]
            group, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            each = gap // n
            whole = min(bins, count // each)
            keep(group + (n,) * each, whole)
            count -= whole * each
            if whole < bins:
                keep(group + (n,) * count, 1 if count else 0)
                keep(group, bins - whole - (1 if count else 0))
                count = 0
    for groups in open_bins.values():
        done += groups
    return done


def place_table(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first item number, first bin, offset), in order: where the items of a length go."""
    used: dict[int, int] = {}
    rows, bin_at = [], 0
    for lengths, bins in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), bin_at, offset))
            used[n] = used.get(n, 0) + bins
            offset += n
        bin_at += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``items`` (a written table with length from 1 to ``capacity``, doc_id, piece and any other columns but these two)."""
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most one row a length
    table = place_table(plan_bins(counts, capacity))
    span = max(counts.values(), default=0) + 1
    keys = table[:, 0] * span + table[:, 1]
    mark = unused(items.columns, "number")
    numbered = number_rows(items, ["length"], [F.col(f"`{c}`") for c in items.columns if c != "length"], ["doc_id", "piece"], mark, sum(counts.values()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", mark))
            row = np.searchsorted(keys, length * span + number, side="right") - 1
            out = {c: batch[c] for c in batch.schema.names if c != mark}
            out |= {"sequence_id": pa.array(table[row, 2] + number - table[row, 1]), "offset": pa.array(table[row, 3])}
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return numbered.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces_of(docs, vocabulary, capacity), "pieces"), capacity)
