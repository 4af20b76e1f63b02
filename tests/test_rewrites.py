"""Rewrites that are killed anywhere, look-ups by key, merges of keyed tables."""

import pytest
from pyspark.sql import functions as F

from embertide.operators import devices as dv
from embertide.operators import sync
from embertide.sources import store
from embertide.sources.keyed import KeyedTable
from embertide.sources.manifest import Manifest
from test_streaming import instants, rows_of


class Killed(Exception):
    pass


def kill_at(monkeypatch, step):
    """Make the ``step``-th file system step of a rewrite fail, before or after it was done."""
    count = iter(range(1_000))
    done = {name: getattr(Manifest, name) for name in ("clean", "path", "swap")}

    def wrapped(name):
        def run(self, *args):
            if name != "path" and next(count) == step:
                raise Killed
            out = done[name](self, *args)
            if next(count) == step:
                raise Killed
            return out
        return run

    for name in done:
        monkeypatch.setattr(Manifest, name, wrapped(name))


def small_store(spark, path, parts=3):
    rows = spark.range(60).select(
        "id", (F.lit("2024-01-02").cast("timestamp") + F.make_interval(hours=F.col("id") % 20)).alias("ts"),
        F.lit("d").alias("device_id"))
    for n in range(parts):
        store.append(rows.where(F.col("id") % parts == n).coalesce(1), path)
    return rows


@pytest.mark.parametrize("step", [0, 1, 2, 3, 4, 5, 6, 7])
@pytest.mark.parametrize("kind", ["compact", "retain"])
def test_a_killed_rewrite_neither_doubles_nor_loses_rows(spark, tmp_path, monkeypatch, step, kind):
    path = str(tmp_path / "t")
    rows = small_store(spark, path)
    before = rows_of(rows, "id")
    cutoff = [(i,) for i in range(60) if i % 20 > 6]
    job = (lambda: store.compact(spark, path, "2024-03-01T00:00:00Z", files_per_day=2)) if kind == "compact" else (
        lambda: store.retain(spark, path, "2024-02-01T06:00:00Z"))
    after = before if kind == "compact" else cutoff
    with monkeypatch.context() as patch:
        kill_at(patch, step)
        try:
            job()
        except Killed:
            pass
    assert rows_of(store.read_store(spark, path), "id") in (before, after)
    job()
    assert rows_of(store.read_store(spark, path), "id") == after
    assert rows_of(spark.read.parquet(path), "id") == after  # nothing is left over


def test_rows_appended_during_a_rewrite_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = small_store(spark, path)
    swap = Manifest.swap

    def late(self, new, old):
        store.append(rows.limit(1).withColumn("id", F.lit(1000).cast("long")), path)
        swap(self, new, old)

    with monkeypatch.context() as patch:
        patch.setattr(Manifest, "swap", late)
        store.compact(spark, path, "2024-03-01T00:00:00Z", files_per_day=1)
    assert rows_of(store.read_store(spark, path), "id") == [(i,) for i in range(60)] + [(1000,)]


def scanned(df) -> int:
    """Rows that the scans of a plan gave out."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    plan, total = execution.executedPlan(), 0
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    for n in range(leaves.size()):
        total += leaves.apply(n).metrics().apply("numOutputRows").value()
    return total


def test_what_a_batch_reads_does_not_grow_with_the_day(spark, tmp_path):
    path = str(tmp_path / "t")
    at = F.lit("2024-01-02").cast("timestamp")
    # message ids are hashes, so ranges tell nothing; the filters of the files do
    day = spark.range(20_000).select(F.xxhash64("id").alias("id"), at.alias("ts"))
    sink = store.StoreSink(path)
    probe = day.where(F.col("id") == F.xxhash64(F.lit(7).cast("long")))
    store.append(day.limit(1000).repartition(1), path, "id")
    few = scanned(sink.known_keys(probe))
    for n in range(1, 20):
        store.append(day.where(F.pmod("id", F.lit(20)) == n).coalesce(1), path, "id")
    assert sink.known_keys(probe).count() >= 1
    many = scanned(sink.known_keys(probe))
    assert many <= few + 3000  # at most a stray row group of the twenty, by the filters' false positives
    sink(probe, 1)
    stored = store.read_store(spark, path)
    assert stored.where(F.col("id").isin([r[0] for r in probe.select("id").collect()])).count() == 1 + (
        day.limit(1000).where(F.pmod("id", F.lit(20)) > 0).join(probe, "id").count())


def test_null_keys_and_late_rows_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = store.StoreSink(path)
    def at(hour, ids):
        return spark.createDataFrame([(i, f"2024-01-02 {hour}:00:00") for i in ids], "id long, t string").select(
            "id", F.col("t").cast("timestamp").alias("ts"))
    sink(at("15", [1, 2, None]), 0)
    sink(at("10", [3]), 1)
    sink(at("10", [3, 4]), 2)
    sink(at("15", [None, 2]), 3)
    assert sorted((r.id or 0, r.ts.hour) for r in store.read_store(spark, path).collect()) == [
        (0, 15), (1, 15), (2, 15), (3, 10), (4, 10)]


def test_late_readings_of_a_stream_are_stored(spark, tmp_path):
    """Hours behind the newest reading, in a later micro-batch: stored all the same."""
    source = tmp_path / "in"
    for hours in ((12, 13, 14, 15), (16,), (10,)):
        spark.createDataFrame([(h, f"2024-01-02 {h}:02:00") for h in hours], "id long, t string").select(
            "id", F.lit("d").alias("device_id"), F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode(
            "append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = store.store_readings(stream, str(tmp_path / "t"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(300) and run.exception() is None
    assert rows_of(store.read_store(spark, str(tmp_path / "t")), "id") == [(h,) for h in (10, 12, 13, 14, 15, 16)]


def test_merge_touches_few_files_and_equals_the_whole_merge(spark, inputs, tmp_path):
    alarms = instants(inputs.raised).select("id", "device_id", "severity", "ts")
    table = KeyedTable(spark, str(tmp_path / "k"), ["id"], 200)
    table.replace(alarms)
    assert rows_of(table.read(), "id", "severity") == rows_of(alarms, "id", "severity")
    files = set(table.manifest.live())
    some = alarms.orderBy("id").limit(3)
    delta = some.withColumn("severity", F.lit("LOW")).unionByName(
        some.limit(1).withColumn("id", F.lit(10**9).cast("long")))
    expected = rows_of(sync.merge_by_id(alarms, delta), "id", "severity")
    touched = table.merge(delta)
    assert len(touched) <= 4 and rows_of(table.read(), "id", "severity") == expected
    assert len(files - set(table.manifest.live())) <= 4
    gone = some.limit(1).select("*", F.lit(True).alias("_deleted"))
    table.merge(gone)
    assert rows_of(table.read(), "id") == [r[:1] for r in expected if r[0] != gone.first().id]


@pytest.mark.parametrize("step", [0, 1, 3, 6, 8])
def test_a_killed_merge_shows_old_or_new_rows(spark, tmp_path, monkeypatch, step):
    table = KeyedTable(spark, str(tmp_path / "k"), ["id"], 8)
    table.replace(spark.range(40).withColumn("v", F.lit("old")))
    delta = spark.range(0, 40, 5).withColumn("v", F.lit("new"))
    before = rows_of(table.read(), "id", "v")
    after = sorted((i, "new" if i % 5 == 0 else "old") for i in range(40))
    with monkeypatch.context() as patch:
        kill_at(patch, step)
        try:
            KeyedTable(spark, str(tmp_path / "k"), ["id"], 8).merge(delta)
        except Killed:
            pass
    assert rows_of(table.read(), "id", "v") in (before, after)
    table.merge(delta)
    assert rows_of(table.read(), "id", "v") == after


def test_device_log_merged_into_the_stored_registry(spark, inputs, tmp_path):
    """Change logs merged in parts give the same devices as the whole log."""
    log = instants(inputs.device_log) if "device_log" in dir(type(inputs)) else None
    if log is None:
        rows = [("a", "x", 1, 1), ("b", "y", 1, 2), ("a", "z", 5, 3), ("c", "w", 2, 4), ("b", "v", 0, 5)]
        log = spark.createDataFrame(rows, "device_id string, name string, s long, seq long").select(
            "device_id", "name", F.timestamp_seconds("s").alias("ts"), "seq")
    table = KeyedTable(spark, str(tmp_path / "d"), ["device_id"], 16)

    def newest(stored, new):
        body = [c for c in stored.columns if c != "device_id"]
        return stored.unionByName(new).groupBy("device_id").agg(
            F.max_by(F.struct(*body), F.struct("ts", "seq")).alias("_v")).select(
            "device_id", *[F.col(f"_v.{c}").alias(c) for c in body])

    for part in (0, 1):
        table.merge(log.where(F.col("seq") % 2 == part), newest)
    got = rows_of(table.read(), "device_id", "ts")
    assert got == rows_of(dv.current_devices(log), "device_id", "last_updated")
