"""Hashing as a stream over a worklist, so that a run that is lost goes on where its last unit was made durable.

The worklist is cut in units: the first of one file, so that a state that can't be written shows at once, then of so many files
or bytes at most. A wave, a file of the worklist and a micro-batch, has up to as many units of each root as the root has readers,
so that all roots are read side by side and a reader has about a unit. What a reader has read, failures among it, becomes a file of
the wave's folder in the state as soon as its task ends, so a lost run loses a unit a reader at most. A wave whose folder
is whole is not read again, nor is a file that the state knew under the same fingerprint when the stream began, from this run or another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.logs import log_line
from ..operators.ranks import numbered
from ..sources.headers import HASHED, hash_files, reader_of
from ..sources.scanner import FINGERPRINT
from ..sources.scratch import materialize, on_storage, scratch_path

#: What a unit has at most: files (fixed pace of 32), and bytes that four readers take some seconds for.
FILES_A_UNIT, BYTES_A_UNIT = 32, 8 << 30
WORK = f"root_id string, rel_path string, path string, size long, fingerprint {FINGERPRINT}"
UNITS = f"{WORK}, unit string, task int, wave string"
STATE = f"root_id string, rel_path string, fingerprint {FINGERPRINT}, {HASHED}"


def write_units(todo: DataFrame, path: str, files: int = FILES_A_UNIT, size: int = BYTES_A_UNIT, readers: int = 4) -> None:
    """Write a worklist (the columns of WORK) to the folder ``path`` in units, by root and path, and these in waves.

    The first unit is a wave, and so is the next one of every root; then a root has ``readers`` units in a wave, fewer when they have
    ``size`` bytes. A wave's files are dealt to ``readers`` tasks a root by bytes. A unit belongs to the root of its first file.
    """
    rows = materialize(todo.select(*[c.split(" ")[0] for c in ("root_id", "rel_path", "path", "size", "fingerprint")], F.lit("").alias("all")), "worklist")
    placed = numbered(rows, "all", ["root_id", "rel_path"]).withColumn("at", F.floor((F.col("place") + F.lit(files - 1)) / files))
    before = Window.partitionBy("at").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # ``files`` rows
    cut = placed.withColumn("part", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / size))
    units = cut.groupBy("at", "part").agg(F.coalesce(F.min("root_id"), F.lit("")).alias("home"), F.sum("size").alias("bytes"))
    first = units.filter("at > 0").groupBy("home").agg(F.min("at").alias("first"))
    turn = F.when(F.col("at") == 0, F.lit(0)).otherwise(1 + F.ceil((F.col("at") - F.col("first")) / readers))
    earlier = Window.partitionBy("home", "turn").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)  # units of a root in a wave
    late = F.floor(F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) / size)
    dealt = units.join(first, "home", "left").withColumn("turn", turn).select("at", "part", F.format_string("%012d-%06d", "turn", late).alias("wave"))
    longest = Window.partitionBy("wave", "root_id").orderBy(F.desc("size"), "path")
    reader = reader_of(F.row_number().over(longest) - 1, readers)
    task = (F.dense_rank().over(Window.partitionBy("wave").orderBy("root_id")) - 1) * readers + reader
    waves = cut.join(dealt, ["at", "part"]).repartition("wave")
    named = waves.select(*rows.columns[:-1], F.format_string("%012d-%06d", "at", "part").alias("unit"), task.cast("int").alias("task"), "wave")
    named.sortWithinPartitions("wave").write.partitionBy("wave").parquet(path)


def hashed(spark: SparkSession, state: str) -> DataFrame:
    """The columns of STATE: the last result of each file, also of waves that were lost before they were whole."""
    fs, make = on_storage(state)
    folder = f"{state}/hashed"
    if not fs.exists(make(folder)):
        return spark.createDataFrame([], STATE)
    columns = ("fingerprint", "path", "sha256", "error", "gone", "bytes", "seconds")
    rows = spark.read.schema(f"{STATE}, batch string").parquet(folder)
    last = F.struct("batch", F.col("_metadata.file_modification_time"))
    return rows.groupBy("root_id", "rel_path").agg(F.max_by(F.struct(*columns), last).alias("r")).select("root_id", "rel_path", "r.*")


def unknown(todo: DataFrame, known: DataFrame) -> DataFrame:
    """``todo`` without the files that ``known`` has a hash of under the same fingerprint."""
    return todo.join(known.filter("sha256 IS NOT NULL").select("root_id", "rel_path", "fingerprint"), ["root_id", "rel_path", "fingerprint"], "left_anti").select(*todo.columns)


def hash_stream(spark: SparkSession, work: str, state: str, progress: str | None = None, run: str = "") -> StreamingQuery:
    """Hash the waves in ``work`` into ``state`` and stop; started again, it goes on. ``run`` names the worklist, a new one for each worklist."""
    listed = spark.read.schema(UNITS).parquet(work)
    tasks = (listed.agg(F.max("task")).first()[0] or 0) + 1
    known, before = scratch_path(spark, "known"), hashed(spark, state).filter("sha256 IS NOT NULL")
    listed.join(before.select("root_id", "rel_path", "fingerprint", "sha256"), ["root_id", "rel_path", "fingerprint"]).select("root_id", "rel_path", "fingerprint", "sha256", "wave").write.partitionBy("wave").parquet(known)
    fs, make = on_storage(known)
    waves = {s.getPath().getName().removeprefix("wave=") for s in fs.globStatus(make(f"{known}/wave=*"))}

    def batch(rows: DataFrame, number: int) -> None:
        target = f"{state}/hashed/batch={run}{number:012d}"
        fs, make = on_storage(target)
        if fs.exists(make(f"{target}/_SUCCESS")):
            return
        if waves and (wave := rows.first()["wave"]) in waves:
            rows = unknown(rows, rows.sparkSession.read.schema(f"{STATE}, wave string").parquet(f"{known}/wave={wave}"))
        # A task's file is put in place when the task ends (version 2), not with the job; after a lost run others are added to them.
        durable = hash_files(rows, progress=progress, tasks=tasks, keep=("root_id", "rel_path", "fingerprint")).write.mode("append")
        durable.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(target)

    units = spark.readStream.schema(UNITS).option("maxFilesPerTrigger", 1).parquet(work)
    return units.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint{run}").trigger(availableNow=True).start()


def hash_durably(todo: DataFrame, state: str, readers: int = 4, progress: str | None = None, files: int = FILES_A_UNIT, size: int = BYTES_A_UNIT) -> DataFrame:
    """The state's results for the worklist ``todo`` (the columns of WORK); only what the state doesn't know is read."""
    spark, run = todo.sparkSession, F.unix_micros(F.current_timestamp())
    run = f"{spark.range(1).select(run).first()[0]:020d}-"
    work = f"{state}/work/{run}{uuid.uuid4().hex[:8]}"
    rest = materialize(unknown(todo, hashed(spark, state)), "to_hash")
    if not rest.isEmpty():
        write_units(rest, work, files, size, readers)
        hash_stream(spark, work, state, progress, run).awaitTermination()
    wanted = todo.select("root_id", "rel_path", F.col("fingerprint").alias("wanted"))
    return hashed(spark, state).join(wanted, ["root_id", "rel_path"]).filter(F.col("fingerprint").eqNullSafe(F.col("wanted"))).drop("wanted")


def log_lines(results: DataFrame) -> DataFrame:
    """(ts, line) for the journal: what was hashed, and what couldn't be."""
    failed = F.col("error").isNotNull()
    none = F.lit(None).cast("long")
    event = F.struct(F.lit("hash").alias("source"), F.when(failed, "failed").otherwise("done").alias("event"), F.col("rel_path").alias("label"), F.col("error").alias("detail"), "seconds", none.alias("size"), none.alias("total"), none.alias("attempt"))
    return results.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("ts"), event.alias("e")).select("ts", log_line(F.col("e")).alias("line"))
