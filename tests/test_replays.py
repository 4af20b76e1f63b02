"""Rows that come again, late, early or in unlucky numbers are neither lost nor doubled."""

import math

import pytest
from pyspark.sql import functions as F

from embertide import session
from embertide.functions import scalar
from embertide.operators import ids, percentiles, readings as rd, sync as sy
from embertide.sources import store
from embertide.streaming import flows

READING = "message_id long, device_id string, ts timestamp, pos int, sensor_type string, value double, status string"


def at(second):
    return f"2024-01-01 00:00:{second:02d}"


def frame(spark, rows, schema):
    """Rows whose times are given as text."""
    plain = schema.replace("timestamp", "string")
    df = spark.createDataFrame(rows, plain)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))])


def test_a_row_is_stored_once_whatever_batch_repeats_it(spark, tmp_path):
    data = frame(spark, [(1, at(1)), (2, at(2)), (None, at(2))], "id long, ts timestamp")
    sink = store.StoreSink(str(tmp_path / "t"))
    for batch in (0, 1, 2):
        sink(data, batch)
    store.StoreSink(str(tmp_path / "t"))(data, 7)
    assert store.read_store(spark, str(tmp_path / "t")).count() == 3


def test_a_broken_store_is_an_error(spark, tmp_path):
    (tmp_path / "t" / "day=2024-01-01").mkdir(parents=True)
    (tmp_path / "t" / "day=2024-01-01" / "part-0.parquet").write_text("broken")
    data = frame(spark, [(1, at(1))], "id long, ts timestamp")
    with pytest.raises(Exception):
        store.StoreSink(str(tmp_path / "t"))(data, 0)


def test_ingest_stores_late_readings_by_device_message_and_place(spark, tmp_path):
    rows = [(1, "d1", at(5), 0, "co", 1.0, "accepted"), (1, "d2", at(5), 0, "co", 2.0, "accepted"),
            (2, "d1", at(3), 0, "co", 99.0, "late"), (2, "d1", at(3), 1, "co", 98.0, "late")]
    registry = spark.createDataFrame([("d1", True), ("d2", True)], "device_id string, enabled boolean")
    sink = flows.IngestSink(str(tmp_path / "t"), lambda: registry)
    sink(frame(spark, rows, READING), 0)
    sink(frame(spark, rows[2:], READING), 1)
    kept = store.read_store(spark, str(tmp_path / "t"))
    assert sorted((r.device_id, r.message_id, r.pos) for r in kept.collect()) == [
        ("d1", 1, 0), ("d1", 2, 0), ("d1", 2, 1), ("d2", 1, 0)]


def test_devices_may_share_message_ids(spark):
    rows = [(1, "d1", "2024-01-01", "data", [("temperature", 20.0)]), (1, "d2", "2024-01-01", "data", [("temperature", 30.0)]),
            (2, "d1", "2024-01-02", "data", [("temperature", 20.01)]), (2, "d2", "2024-01-02", "data", [("temperature", 40.0)])]
    messages = spark.createDataFrame(
        rows, "message_id long, device_id string, ts string, type string, readings array<struct<type:string,value:double>>"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = rd.changed_messages(messages, slices=None).collect()
    assert sorted((r.device_id, r.message_id, len(r.readings)) for r in kept) == [("d1", 1, 1), ("d2", 1, 1), ("d2", 2, 1)]
    rate = rd.change_filter_rate(messages, slices=None).first()
    assert (rate.total, rate.filtered) == (4, 1)


def test_ids_beyond_256_in_a_millisecond_take_the_next_free_ones(spark):
    rows = [(k, 1_700_000_000_000) for k in range(600)] + [(600 + k, 1_700_000_000_001) for k in range(300)]
    rows += [(900, 1_700_000_000_010)]
    df = spark.createDataFrame(rows, "k long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    out = ids.assign_ids(df, "ts", F.lit(3), F.lit(1), ["k"]).select(
        "k", "id", scalar.id_millis(F.col("id")).alias("at"), scalar.id_sequence(F.col("id")).alias("seq")).collect()
    assert len({r.id for r in out}) == 901
    by = {r.k: (r.at - 1_700_000_000_000, r.seq) for r in out}
    assert by[255] == (0, 255) and by[256] == (1, 0) and by[600] == (2, 88) and by[900] == (10, 0)


def test_percentiles_treat_nan_alike_at_any_size(spark):
    values = [float(k) for k in range(40)] + [float("nan")] * 3
    df = spark.createDataFrame([("a", v) for v in values] + [("b", float("nan"))], "k string, v double")
    probs = [0.0, 0.5, 0.9, 0.95, 1.0]
    small = {r.k: r for r in percentiles.exact(df, ["k"], "v", probs).collect()}
    large = {r.k: r for r in percentiles.exact(df, ["k"], "v", probs, target_rows=5).collect()}
    for key, row in small.items():
        for name in small["a"].__fields__[1:]:
            x, y = row[name], large[key][name]
            assert (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y), (key, name)


def test_a_small_delta_does_not_shuffle_the_history(spark, inputs):
    merged = sy.merge_by_id(inputs.alarms, inputs.alarms.where("id < 50"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert merged.count() == inputs.alarms.count()


def test_an_action_that_arrives_before_its_alarm_takes_effect(spark, tmp_path):
    alarm = "id long, device_id string, severity string, ts timestamp"
    action = "alarm_id long, action string, actor string, ts timestamp"
    rows = [([], [(1, "RESOLVE", "x", at(9)), (2, "ACK", "y", at(9))]), ([(1, "d", "HIGH", at(1))], []),
            ([(3, "e", "LOW", at(1))], [(3, "ACK", "z", at(1))])]
    for n, (alarms, actions) in enumerate(rows):
        frame(spark, alarms, alarm).coalesce(1).write.parquet(f"{tmp_path}/a/{n}")
        frame(spark, actions, action).coalesce(1).write.parquet(f"{tmp_path}/b/{n}")
    out = []

    def source(name, df):
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
            "recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")

    stream = flows.alarm_life_stream(source("a", frame(spark, [], alarm)), source("b", frame(spark, [], action)))
    query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    assert sorted((r.alarm_id, r.action) for r in out) == [(1, "RAISE"), (1, "RESOLVE"), (3, "ACK"), (3, "RAISE")]


def test_compacting_again_rewrites_nothing(spark, tmp_path):
    path = tmp_path / "t"
    data = frame(spark, [(k, "d", "s", at(k % 60)) for k in range(50)], "id long, device_id string, sensor_type string, ts timestamp")
    for part in (0, 1):
        store.append(data.where(F.col("id") % 2 == part), str(path))
    assert len(store.compact(spark, str(path), "2024-02-01T00:00:00Z")) == 1
    files = sorted(path.rglob("*.parquet"))
    assert store.compact(spark, str(path), "2024-02-01T00:00:00Z") == []
    assert sorted(path.rglob("*.parquet")) == files
    assert spark.read.parquet(str(path)).count() == 50
    store.append(data.limit(3).withColumn("id", F.col("id") + 1000), str(path))
    assert len(store.compact(spark, str(path), "2024-02-01T00:00:00Z")) == 1
    assert spark.read.parquet(str(path)).count() == 53


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
