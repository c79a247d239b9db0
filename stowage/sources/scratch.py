"""Tables written to the folder that driver and executors share, so that later steps read rows instead of computing them again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder that goes with the process; any other session gets
    a folder in its warehouse, since a machine-local one would be lost on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="stowage-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    else:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stowage_scratch"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def on_storage(path: str):
    """The Hadoop file system of ``path``, and a maker of its paths."""
    jvm = SparkContext._jvm
    hadoop = jvm.org.apache.hadoop
    make = hadoop.fs.Path
    context = SparkContext._active_spark_context
    conf = context._jsc.hadoopConfiguration() if context is not None else hadoop.conf.Configuration()
    return make(path).getFileSystem(conf), make


def discard() -> None:
    """Delete what ``materialize`` has written in this process. Its tables can't be read afterwards; it also runs when the process ends."""
    for path in sorted(_used):
        try:
            fs, make = on_storage(path)
            fs.delete(make(path), True)
        except Exception:  # noqa: BLE001  the session or the storage may be gone already
            continue
    _used.clear()


def scratch_path(spark: SparkSession, name: str) -> str:
    if not _used:
        atexit.unregister(discard)
        atexit.register(discard)
    top = f"{shared_dir(spark)}/stowage/{spark.sparkContext.applicationId}"
    _used.add(top)
    return f"{top}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: the lineage is cut, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
