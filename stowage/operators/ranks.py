"""Numbers of rows by an order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def numbered(rows: DataFrame, group: str, order: Sequence[str], out: str = "place", total: str | None = None) -> DataFrame:
    """``rows`` with ``out``, gapless from 0 in each group by ``order`` (nulls first), and ``total``, the group's number of rows. ``rows`` is a written table.

    Rows are range-partitioned by group and order and written; a partition's rows of a group are numbered by where they stand,
    and the counts of earlier partitions, a row a partition and group, are added up.
    """
    sort = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    counts = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    each = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(each.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_g", "_p", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(each).alias("_of"))
    met = dealt.join(offsets, dealt[group].eqNullSafe(offsets["_g"]) & (dealt["_part"] == offsets["_p"]))
    found = [(F.col("_at") + F.col("_shift")).cast("long").alias(out), *([F.col("_of").cast("long").alias(total)] if total else [])]
    return met.select(*[dealt[f"`{c}`"] for c in rows.columns], *found)
