"""A catalog kept on storage: files by root, what each root knows of contents, and the contents, in versions (``sources.versions``)."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import api, schema
from .api import Engine
from .operators import merging
from .sources import documents
from .sources.documents import upsert_provenance
from .sources.scratch import materialize
from .sources.state import writer
from .sources.versions import Versions

#: The columns of stored files.
STORED = T.StructType([T.StructField("root_id", T.StringType()), T.StructField("ord", T.LongType()), *schema.FILE.fields])
#: Shares that provenance is kept in, by the beginning of its hashes.
PREFIX = 1


class Store:
    """Commands read an ``engine`` from it and write one back; one writer at a time holds the lock in ``lock_folder``."""

    def __init__(self, spark: SparkSession, path: str, lock_folder: str, buckets: int = merging.BUCKETS) -> None:
        self.spark, self.versions, self.lock_folder, self.buckets = spark, Versions(spark, path), lock_folder, buckets

    def load(self, number: int | None = None) -> Engine | None:
        """The engine of a commit, the newest where none is named; None where nothing was committed."""
        at = self.versions.commit(number)
        files, roots = self.versions.table("files", at), self.versions.table("roots", at)
        return None if files is None else Engine(files, roots)

    def contents(self, number: int | None = None) -> DataFrame | None:
        """The merged contents of a commit: key, size, display_name, meta, bucket."""
        return self.versions.table("contents", self.versions.commit(number))

    def save(self, files: DataFrame, roots: DataFrame) -> dict:
        """Commit files of all roots and merge them whole."""
        with writer(self.lock_folder):
            rows = materialize(files, "to_save")
            parts = materialize(merging.partials(rows, self.buckets), "partials")
            split = {"files": (rows, ["root_id"], None), "partials": (parts, ["root_id", "bucket"], None), "contents": (merging.merged(parts), ["bucket"], None)}
            return self.versions.put({"roots": {"all": roots}}, split=split)

    def update(self, changed: Mapping[str, DataFrame | None], roots: DataFrame | None = None, based_on: dict | None = None) -> dict:
        """Commit the new files of some roots (None: the root is forgotten); only contents that these roots know otherwise are merged again.

        ``based_on`` is the commit that the files were made from; another one since then is a conflict, and nothing is written.
        """
        with writer(self.lock_folder):
            at, ids = based_on or self.versions.commit(), list(changed)
            every, known = self.versions.table("partials", at), self.versions.table("files", at)
            rows = reduce(DataFrame.unionByName, [f.select(*known.columns) for f in changed.values() if f is not None], known.limit(0))
            rows = materialize(rows.filter(F.col("root_id").isin(ids)), "to_save")
            fresh = materialize(merging.partials(rows, self.buckets).select(*every.columns), "partials")
            touched = materialize(merging.changed_keys(every.filter(F.col("root_id").isin(ids)), fresh), "touched")
            buckets = [r[0] for r in touched.select("bucket").distinct().collect()]  # of a fixed number
            split = {"files": (rows, ["root_id"], ids), "partials": (fresh, ["root_id", "bucket"], ids)}
            if buckets:
                parts = every.filter(~F.col("root_id").isin(ids)).unionByName(fresh)
                split["contents"] = merging.merged_again(self.versions.table("contents", at), parts, touched, buckets), ["bucket"], buckets
            return self.versions.put({} if roots is None else {"roots": {"all": roots}}, at, split)

    def refresh(self, roots: Sequence[dict[str, str]], state: str | None = None, journal: str | None = None, readers: int = 4, progress: str | None = None) -> dict:
        """Scan ``roots`` (root_id, kind, path, label), hash what is new or changed, and commit the files of those that are there; others stay as they were.

        What was hashed, and what couldn't be, goes to the ``journal`` once it is committed. With ``state`` hashing is durable (``api.refresh_all``).
        """
        at, registered = self.versions.commit(), api.register(self.spark, roots)
        known = self.versions.table("files", at)
        scan = api.scan_roots(self.spark, roots)
        previous = self.spark.createDataFrame([], STORED) if known is None else known
        done = api.refresh_all(scan, previous, registered, documents.carried(self.spark, roots), readers, state, progress)
        rows = materialize(done.files.select(*[f.name for f in STORED.fields]), "refreshed")
        if known is None:
            out = self.save(rows, registered)
        else:
            here = [r["root_id"] for r in roots if os.path.isdir(r["path"])]
            out = self.update({i: rows.filter(F.col("root_id") == i) for i in here}, registered, at)
        if journal is not None:
            documents.append_journal(done.log_lines(), journal)
        return out

    def record(self, provenance: DataFrame) -> dict:
        """Upsert provenance by hash; only the shares that its hashes are in are written again."""
        with writer(self.lock_folder):
            at = self.versions.commit()
            new = materialize(provenance, "provenance")
            prefixes = [r[0] for r in new.select(F.substring("sha256", 1, PREFIX)).distinct().collect()]  # sixteen at most
            known = self.versions.table("provenance", at)
            shares = {}
            for p in prefixes:
                mine = F.substring("sha256", 1, PREFIX) == p
                rows = new.filter(mine)
                shares[p] = upsert_provenance((new.limit(0) if known is None else known).filter(mine), rows)
            return self.versions.put({"provenance": shares}, based_on=at)

    def provenance(self) -> DataFrame | None:
        return self.versions.table("provenance")
