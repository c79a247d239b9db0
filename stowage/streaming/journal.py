"""The journal as a stream, and incremental refresh of the catalog in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import carry_forward, hash_worklist
from ..sources.documents import journal_lines


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """(ts, line) of journal files as they are appended."""
    return journal_lines(spark.readStream.option("recursiveFileLookup", True).text(path))


def activity(entries: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Entries by time window and first word, with a watermark; an addition of this engine."""
    timed = entries.withColumn("at", F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ss"))).filter("at IS NOT NULL").withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), F.element_at(F.split("line", " "), 1).alias("operation")).agg(F.count(F.lit(1)).alias("entries")).select(F.col("w.start").alias("start"), "operation", "entries")


#: How often work is made durable: the first batch at once, then every so many seconds at most (fixed pace), of so many files of scan rows.
PACE, FILES_A_BATCH = "5 seconds", 32


def scan_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Scan rows as Parquet files of them arrive, FILES_A_BATCH files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(path)


def refresh_stream(scans: DataFrame, known: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str, follow: bool = False) -> StreamingQuery:
    """Reconcile arriving scan rows with what is known: unchanged files keep their hash, ``store`` gets every batch with
    the rest unhashed. Runs over what is there and stops, or with ``follow`` goes on at PACE; the checkpoint makes a
    restart go on where it stopped."""

    def batch(rows: DataFrame, number: int) -> None:
        store(carry_forward(rows, known()), number)

    pace = {"processingTime": PACE} if follow else {"availableNow": True}
    return scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**pace).start()


def pending(files: DataFrame) -> DataFrame:
    return hash_worklist(files)
