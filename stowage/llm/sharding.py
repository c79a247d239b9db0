"""Sharding by minimax contiguous partition of ordered atomic groups (documents with equal texts).

Groups stand in the order of a 64-bit hash of their text. The smallest feasible capacity is found by binary search,
each capacity checked by greedy filling, and the order is cut where that filling cuts. Sizes reach the driver only as
sums over ranges of the hash ("cells"), which are divided further just where a cut may fall, so what it holds is bounded
by the resolution and not by the corpus; the result is the exact optimum over the groups all the same.

Cases: null text has size 1, checksum 0 and forms a group of its own; empty text has size 1; repeated rows are
separate rows of one group and of one shard; an empty table gives no rows; a group above the mean shard size gets a
shard as large as itself, as no atomic cut is smaller; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_rows

FIRST_BITS, MORE_BITS = 14, 6


class Cells:
    """Sums of sizes over ranges of the group order; ``atomic`` cells hold one group."""

    def __init__(self, cells: list[tuple[int, int, int, int]]) -> None:
        self.cells = sorted(cells)  # (lowest key, highest key, bytes, resolution)
        self.ends = list(accumulate(c[2] for c in self.cells))
        self.total = self.ends[-1] if self.ends else 0

    def atomic(self, i: int) -> bool:
        return self.cells[i][0] == self.cells[i][1]

    def fill(self, capacity: int, shards: int, fluid: bool) -> list[int] | None:
        """Greedy cuts, as bytes before each; None if ``shards`` don't suffice. A cell of several groups may be cut anywhere if ``fluid``, else nowhere."""
        at, cuts = 0, []
        while at < self.total:
            if len(cuts) == shards:
                return None
            limit = at + capacity
            if limit >= self.total:
                return cuts
            i = bisect_right(self.ends, limit)  # the cell that the limit falls in
            start = self.ends[i - 1] if i else 0
            if fluid and not self.atomic(i):
                start = limit
            if start <= at:
                return None
            cuts.append(at := start)
        return cuts

    def least(self, shards: int, fluid: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            cuts = self.fill(mid, shards, fluid)
            if cuts is not None and len(cuts) < shards:
                high = mid
            else:
                low = mid + 1
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[int]:
        """Cells of several groups that a cut may fall in for some capacity from ``low`` to ``high``."""
        found, early, late = set(), 0, 0
        for _ in range(shards):
            i = bisect_right(self.ends, early + low)
            early = max(early, self.ends[i - 1] if i else 0)
            late = min(self.total, late + high)
            j = bisect_left(self.ends, late)
            found.update(k for k in range(bisect_left(self.ends, early), min(j, len(self.ends) - 1) + 1) if not self.atomic(k))
        return sorted(found)


def minimax_cuts(keyed: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity and the keys at which shards 1, 2, ... begin. ``keyed`` has key and size."""

    def sums(rows: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        by = rows.groupBy(F.shiftright("key", 64 - bits).alias("cell"))
        return [(*r, bits) for r in by.agg(F.min("key"), F.max("key"), F.sum("size")).drop("cell").collect()]

    table = Cells(sums(keyed, FIRST_BITS))
    while True:
        high, low = table.least(shards, fluid=False), table.least(shards, fluid=True)
        vague = set(table.unsure(low, high, shards)) if low < high else set()
        if not vague:
            break
        cells = [c for i, c in enumerate(table.cells) if i not in vague]
        for bits in {table.cells[i][3] for i in vague}:
            ids = [(table.cells[i][0] >> (64 - bits),) for i in vague if table.cells[i][3] == bits]
            wanted = F.broadcast(keyed.sparkSession.createDataFrame(ids, "wanted long"))  # bounded by the resolution
            cells += sums(keyed.join(wanted, F.shiftright("key", 64 - bits) == F.col("wanted"), "left_semi"), min(64, bits + MORE_BITS))
        table = Cells(cells)
    return high, [table.cells[bisect_right(table.ends, c)][0] for c in table.fill(high, shards, fluid=False) or []]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``; law ``bytes``."""
    text = F.col("text")
    keyed = materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sharding_keys",
    )
    _, starts = minimax_cuts(keyed, shards)
    shard = F.lit(0)
    for s in starts:
        shard = shard + F.when(F.col("key") >= F.lit(s), 1).otherwise(0)
    placed = keyed.withColumn("shard", shard.cast("int"))
    slots = number_rows(placed, ["shard"], ["doc_id", "key"], ["doc_id", "key"], "slot", keyed.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
