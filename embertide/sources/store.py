"""Day-partitioned tables: idempotent appends, compaction, retention.

``read_store`` gives the live files of every day (see ``manifest``); compaction and retention replace a day's
files in one step, so a reader never meets a row twice or not at all.
"""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.functions.instants import as_datetime
from embertide.operators.alarms import RETENTION_DAYS, split_retention
from embertide.operators.ordered import null_safe
from embertide.sources.manifest import GENERATION, Manifest

# Age at which a day is compacted.
COMPACT_AFTER_DAYS = 7
SORT_KEYS = ("device_id", "sensor_type", "ts")
FILE_BYTES = 256 * 1024 * 1024
MARK = f"{GENERATION}compacted-"  # begins the names of compacted files
PROBED_KEYS = 20_000  # keys of a micro-batch that are looked up by value; with more, all keys of the days are read


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("ts"))


def read_store(
    spark: SparkSession, path: str, schema: T.StructType | None = None, days: list[date] | None = None,
) -> DataFrame:
    """The live rows with their ``day`` partition column; empty when nothing is stored."""
    found = stored_days(spark, path)
    found = found if days is None else [d for d in found if d in set(days)]
    # a day without a manifest is read as a folder; only rewritten days are listed file by file
    names = []
    for day in found:
        folder = f"{path}/day={day.isoformat()}"
        manifest = Manifest(spark, folder)
        if manifest.versions() or any(n.startswith(GENERATION) for n in manifest.present()):
            names += [f"{folder}/{name}" for name in manifest.live()]
        else:
            names.append(folder)
    if not names:
        if schema is None:
            return spark.read.parquet(path)
        return with_day(spark.createDataFrame([], schema))
    reader = spark.read.option("basePath", path)
    return (reader.schema(with_day(spark.createDataFrame([], schema)).schema) if schema else reader).parquet(*names)


def append(df: DataFrame, path: str, probe: str | None = None) -> None:
    """Append by day. Rows keep their task, so a large day is written by many tasks.

    With ``probe``, files have a Bloom filter of that column, by which a look-up skips their row groups.
    """
    writer = with_day(df).write.mode("append").partitionBy("day")
    if probe:
        writer = writer.option(f"parquet.bloom.filter.enabled#{probe}", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(path)


class StoreSink:
    """``foreachBatch`` target that stores every row once, keyed by ``keys``.

    Every micro-batch is checked against the stored keys of the days it touches,
    so a row may come again in any later micro-batch or after a restart, however late. The values of ``probe``
    (one of the keys, its values many) are looked up by value: row groups whose range, dictionary or Bloom filter rules
    all of them out are not read, so what a micro-batch reads follows its own keys, not the size of the
    day. Micro-batches of more than PROBED_KEYS values read the key columns of their days.
    """

    def __init__(
        self, path: str, keys: tuple[str, ...] = ("id",), stamp: str | None = None, probe: str | None = None,
    ):
        self.path, self.keys, self.stamp = path, list(keys), stamp
        self.probe = probe or self.keys[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(self.keys)
        if self.stamp:
            rows = rows.withColumn(self.stamp, F.current_timestamp())
        append(self._unseen(rows), self.path, self.probe)

    def _unseen(self, rows: DataFrame) -> DataFrame:
        known = self.known_keys(rows)
        return rows if known is None else null_safe(rows, known, self.keys, "left_anti")

    def known_keys(self, rows: DataFrame) -> DataFrame | None:
        """Stored keys that rows of the micro-batch may repeat; None where its days hold nothing yet."""
        spark = rows.sparkSession
        present = set(stored_days(spark, self.path))
        if not present:
            return None
        days = sorted(present & {r[0] for r in rows.select(F.to_date("ts")).distinct().collect()})
        if not days:
            return None
        known = read_store(spark, self.path, days=days).where(F.col("day").isin(days))
        values = [r[0] for r in rows.select(self.probe).distinct().limit(PROBED_KEYS + 1).collect()]
        if len(values) <= PROBED_KEYS:
            wanted = F.col(self.probe).isin([v for v in values if v is not None])
            known = known.where(wanted | F.col(self.probe).isNull() if None in values else wanted)
        return known.select(*self.keys)


def store_readings(readings: DataFrame, path: str, checkpoint: str):
    """Streaming sink of readings: every id once, however late it comes."""
    return readings.writeStream.foreachBatch(StoreSink(path, stamp="created_at")).option(
        "checkpointLocation", checkpoint
    )


def store_alarms(alarms: DataFrame, path: str, checkpoint: str):
    """Streaming sink of the alarm history: identical events once, by id and time."""
    return alarms.writeStream.foreachBatch(StoreSink(path, keys=("id", "ts"))).option(
        "checkpointLocation", checkpoint
    )


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days present in the table, by listing its partition folders; none where nothing is stored."""
    system, target = _file_system(spark, path)
    if not system.exists(target):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(target)]
    return sorted(date.fromisoformat(n.removeprefix("day=")) for n in names if re.fullmatch(r"day=\d{4}-\d\d-\d\d", n))


def compact(
    spark: SparkSession,
    path: str,
    now: datetime | str,
    older_than_days: int = COMPACT_AFTER_DAYS,
    files_per_day: int | None = None,
    sort_keys: tuple[str, ...] = SORT_KEYS,
) -> list[date]:
    """Rewrite closed days sorted and zstd-compressed; days already compacted are left alone.

    Rows are range-partitioned on (day, sort keys): a large day or device is
    spread over several tasks and files with tight min/max statistics. Without
    ``files_per_day`` files are about FILE_BYTES large.

    Safe beside a stream that appends: exactly the files live at the start are
    read, their rows are written as new files, which then take their place in one step a day.
    A row appended meanwhile is in a file that was not live at the start, so it stays.
    """
    limit = (as_datetime(now) - timedelta(days=older_than_days)).date()
    listed = {d: _live_files(spark, path, d) for d in stored_days(spark, path) if d < limit}
    listed = {d: files for d, files in listed.items() if any(MARK not in name for name in files)}
    if not listed:
        return []
    old = _files_of(spark, path, listed)
    keys = ["day", *[k for k in sort_keys if k in old.columns]]
    total = sum(size for files in listed.values() for size in files.values())
    tasks = len(listed) * files_per_day if files_per_day else max(len(listed), -(-total // FILE_BYTES))
    ordered = old.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    _replace(spark, path, ordered, listed, MARK, zstd=True)
    return sorted(listed)


def _live_files(spark: SparkSession, path: str, day: date) -> dict[str, int]:
    """Names and sizes of a day's live data files; what a killed rewrite left beside them goes."""
    manifest = Manifest(spark, f"{path}/day={day.isoformat()}")
    if len(manifest.live()) < len(manifest.present()):
        manifest.clean()
    return manifest.live()


def _files_of(spark: SparkSession, path: str, listed: dict[date, dict[str, int]]) -> DataFrame:
    names = [f"{path}/day={d.isoformat()}/{name}" for d, files in listed.items() for name in files]
    return spark.read.option("basePath", path).parquet(*names)


def _replace(
    spark: SparkSession, path: str, rows: DataFrame, listed: dict[date, dict[str, int]], mark: str, zstd: bool = False,
) -> None:
    """Put ``rows`` in the place of the listed files, day by day; files that came later stay.

    The new files are moved beside the old ones first, where they do not count yet; the manifest of the day makes them
    live and the old ones not; then the old ones go. Killed between any two of these steps, no row is doubled or lost,
    and the next run over the day removes what was left over.
    """
    work = f"{path}/_rewriting-{uuid.uuid4().hex}"
    writer = rows.write.option("compression", "zstd") if zstd else rows.write
    writer.partitionBy("day").parquet(work)
    system, _ = _file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for day, files in listed.items():
        folder = f"day={day.isoformat()}"
        manifest = Manifest(spark, f"{path}/{folder}")
        manifest.clean()
        new = []
        for name in Manifest(spark, f"{work}/{folder}").present():
            new.append(f"{mark}{uuid.uuid4().hex[:8]}-{name}")
            if not system.rename(hadoop(f"{work}/{folder}/{name}"), manifest.path(new[-1])):
                raise OSError(f"{path}/{folder}/{new[-1]} could not be put in place")
        manifest.swap(new, list(files))
        manifest.clean()
    _delete_folder(spark, work)


def retain(
    spark: SparkSession, path: str, now: datetime | str, days: int = RETENTION_DAYS
) -> int:
    """Delete rows at or before ``now - days``; return how many were removed.

    Whole days go as folders; the files that the boundary day had at the start are replaced in one step,
    so rows that a stream appends meanwhile stay.
    """
    cutoff = as_datetime(now) - timedelta(days=days)
    boundary = cutoff.date()
    listed = {d: _live_files(spark, path, d) for d in stored_days(spark, path) if d <= boundary}
    listed = {d: files for d, files in listed.items() if files}
    if not listed:
        return 0
    table = _files_of(spark, path, listed)
    removed, kept = split_retention(table, now, days)
    count = removed.count()
    if count == 0:
        return 0
    edge = {d: files for d, files in listed.items() if d == boundary}
    if edge:
        _replace(spark, path, kept.where(F.col("day") == F.lit(boundary)), edge, GENERATION)
        if not _live_files(spark, path, boundary):
            _delete_folder(spark, f"{path}/day={boundary.isoformat()}")
    for day in listed:
        if day < boundary:
            _delete_folder(spark, f"{path}/day={day.isoformat()}")
    return count


def _file_system(spark: SparkSession, folder: str):
    """The file system the path belongs to, local or distributed, and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _delete_folder(spark: SparkSession, folder: str) -> None:
    system, target = _file_system(spark, folder)
    system.delete(target, True)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    system, target = _file_system(spark, folder)
    if not system.exists(target):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(target)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def finished_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the completely written ``batch=N`` folders."""
    done = []
    for number in _batches(spark, folder):
        system, marker = _file_system(spark, f"{folder}/batch={number}/_SUCCESS")
        if system.exists(marker):
            done.append(number)
    return done


def delete_below(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Drop ``batch=N`` folders older than ``batch_id``."""
    for number in _batches(spark, folder):
        if number < batch_id:
            _delete_folder(spark, f"{folder}/batch={number}")
