"""Tables by key with copy-on-write merge: devices, rules, thresholds, alarms by id.

Rows lie in buckets by a hash of the key. A merge rewrites only the buckets that hold a
changed key; all of them change hands with one manifest, so readers see the table before or after a merge, never between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertide.operators.ordered import null_safe
from embertide.sources.manifest import GENERATION, Manifest

BUCKETS = 1024
BUCKET = "key_bucket"


class KeyedTable:
    """A table with one row per ``keys``; ``buckets`` is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.manifest = Manifest(spark, path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None where nothing is stored."""
        files = self._files(buckets)
        if not files:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{name}" for name in files])
        return rows.drop(BUCKET)

    def _files(self, buckets: list[int] | None = None) -> list[str]:
        wanted = None if buckets is None else {f"{BUCKET}={n}" for n in buckets}
        return [n for n in self.manifest.live() if wanted is None or n.split("/")[0] in wanted]

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the whole content of the table."""
        self._put(rows, self._files())

    def merge(self, delta: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """Put the rows of ``delta`` in the place of rows with equal keys, and add new ones; the buckets rewritten.

        ``delta`` has one row per key unless ``combine`` (stored, delta) says what becomes of equal keys.
        A row whose column ``_deleted`` is true takes its key out. Stored rows of other buckets are not read.
        """
        touched = sorted(r[0] for r in self._bucketed(delta).select(BUCKET).distinct().collect())  # BUCKETS at most
        old = self._files(touched)
        new = delta
        if "_deleted" in delta.columns:
            new = delta.where(~F.coalesce("_deleted", F.lit(False))).drop("_deleted")
        if old:
            stored = self.read(touched)
            if combine:
                new = combine(stored, new)
            else:
                new = null_safe(stored, delta.select(*self.keys), self.keys, "left_anti").unionByName(new)
        elif combine:
            new = combine(new.limit(0), new)
        self._put(new, old)
        return touched

    def _put(self, rows: DataFrame, old: list[str]) -> None:
        """Write ``rows`` beside the table, move them in, and let them take the place of the ``old`` files."""
        if self.manifest.system.exists(self.manifest.hadoop(self.path)):
            self.manifest.clean()
        work = f"{self.path}/_rewriting-{uuid.uuid4().hex}"
        # small buckets share a task, a large one is split over several; a bucket is one file or a few
        self._bucketed(rows).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(work)
        new, made = [], set()
        for name in Manifest(self.spark, work).present():
            folder, file = name.split("/")
            if folder not in made:
                self.manifest.system.mkdirs(self.manifest.path(folder))
                made.add(folder)
            new.append(f"{folder}/{GENERATION}{uuid.uuid4().hex[:8]}-{file}")
            if not self.manifest.system.rename(self.manifest.hadoop(f"{work}/{name}"), self.manifest.path(new[-1])):
                raise OSError(f"{new[-1]} could not be put in place")
        self.manifest.swap(new, old)
        self.manifest.clean()
        self.manifest.system.delete(self.manifest.hadoop(work), True)
