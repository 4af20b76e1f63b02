"""Time buckets that are kept up to date: an invalidation log says which ones to make anew.

What is stored is marked first; a refresh makes exactly the marked buckets from the stored readings and merges
them into a keyed table. A reading may come any time later: its bucket is marked again. Both steps can be repeated
after a failure without changing the outcome.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertide.functions.instants import bucket_window
from embertide.operators.ordered import null_safe
from embertide.operators.readings import in_range
from embertide.session import checked_broadcast
from embertide.sources.keyed import BUCKETS, KeyedTable
from embertide.sources.store import StoreSink, _delete_folder, finished_batches, read_store

KEY = ["device_id", "sensor_type", "bucket"]


class MaintainedBuckets:
    """Average, minimum, maximum and count per device, sensor type and bucket of ``width``.

    ``readings`` is the folder of the stored readings, ``path`` that of the buckets.
    """

    def __init__(self, spark: SparkSession, readings: str, path: str, width: str, buckets: int = BUCKETS):
        self.spark, self.readings, self.path, self.width = spark, readings, path, width
        self.table = KeyedTable(spark, f"{path}/table", KEY, buckets)

    def mark(self, rows: DataFrame, batch_id: int) -> None:
        """Write down the buckets of ``rows``; a repeated micro-batch writes the same."""
        window = bucket_window(self.width, F.col("ts"))
        rows.select("device_id", "sensor_type", window.alias("_w")).distinct().select(
            "device_id", "sensor_type", F.col("_w.start").alias("bucket"), F.col("_w.end").alias("_end"),
        ).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")

    def refresh(self) -> int:
        """Make the marked buckets anew; the number of micro-batches whose marks were used up."""
        batches = finished_batches(self.spark, f"{self.path}/log")
        if not batches:
            return 0
        folders = [f"{self.path}/log/batch={n}" for n in batches]
        marked = self.spark.read.parquet(*folders).distinct()
        first, last = marked.agg(F.min("bucket"), F.max("_end")).first()
        if first is not None:
            one = timedelta(days=1)
            days = self._days(marked)
            stored = in_range(read_store(self.spark, self.readings, days=days), first - one, last + one)
            window = bucket_window(self.width, F.col("ts"))
            placed = stored.withColumn("bucket", window["start"])
            hit = null_safe(placed, checked_broadcast(marked.select(*KEY)), KEY, "left_semi")
            self.table.merge(hit.groupBy(*KEY).agg(
                F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
                F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n")))
        for folder in folders:
            _delete_folder(self.spark, folder)
        return len(batches)

    @staticmethod
    def _days(marked: DataFrame) -> list:
        """The days that marked buckets reach into."""
        reach = F.sequence(F.to_date("bucket"), F.to_date(F.col("_end") - F.expr("INTERVAL 1 MICROSECOND")))
        return [r[0] for r in marked.select(F.explode(reach).alias("day")).distinct().collect()]

    def read(self, start=None, end=None) -> DataFrame | None:
        """The buckets, those that begin in [start, end] where both are given; None before the first refresh."""
        rows = self.table.read()
        if rows is None or start is None or end is None:
            return rows
        return in_range(rows.withColumnRenamed("bucket", "ts"), start, end).withColumnRenamed("ts", "bucket")


class BucketedSink(StoreSink):
    """Stores readings once and keeps their buckets: marks come before the rows, the refresh after them."""

    def __init__(self, path: str, buckets: MaintainedBuckets, keys: tuple[str, ...] = ("id",)):
        super().__init__(path, keys)
        self.buckets = buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.buckets.mark(batch, batch_id)
        super().__call__(batch, batch_id)
        self.buckets.refresh()
