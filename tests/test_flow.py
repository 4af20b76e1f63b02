"""Alarm flow end to end: live rules, registry gate, restart, distribution, health."""

import pytest
from pyspark.sql import functions as F

from embertide.operators import alarms as al
from embertide.operators import devices as dv
from embertide.operators import readings as rd
from embertide.operators import rules as rl
from embertide.streaming import flows
from test_streaming import as_stream, instants, rows_of

DAY = 86400


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(600)
    assert query.exception() is None


def stored(spark, folder, *columns):
    return rows_of(spark.read.parquet(f"{folder}/history"), *columns)


@pytest.mark.parametrize("target", [5_000_000, 10])
def test_alarm_flow_equals_batch_and_survives_restart(spark, inputs, tmp_path, target):
    readings, rules = instants(inputs.sensor_data), inputs.rules
    work = str(tmp_path / "work")
    stream = as_stream(readings, tmp_path / "in", 3)

    def run():
        sink = flows.AlarmSink(work, lambda: rules, dedup_seconds=DAY, target_rows=target)
        finish(flows.alarm_flow(stream, sink, str(tmp_path / "cp")))

    def expected(rows):
        return al.normalised(al.create_alarms(rl.raised(rl.match_rules(rows, rules), DAY)))

    run()
    first = stored(spark, work, "id", "severity", "message", "ts")
    assert first == rows_of(expected(readings), "id", "severity", "message", "ts")
    topics = spark.read.parquet(f"{work}/topics")
    assert rows_of(topics, "id", "topic") == rows_of(al.fan_out(expected(readings)), "id", "topic")
    # Started again from the checkpoint with nothing new: nothing is repeated.
    run()
    assert stored(spark, work, "id", "severity", "message", "ts") == first
    # New readings after the restart continue from the stored state.
    later = readings.withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS")).withColumn(
        "id", F.col("id") + 1_000_000
    )
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    both = rl.raised(rl.match_rules(readings.unionByName(later), rules), DAY)
    assert stored(spark, work, "id") == rows_of(
        both.select(F.col("id").cast("string").alias("id")), "id"
    )


def small_readings(spark, rows):
    return spark.createDataFrame(rows, "id long, device_id string, s long, value double").select(
        "id", "device_id", F.lit("smoke").alias("sensor_type"), "value", F.lit("ppm").alias("unit"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("ts"), F.lit("{}").alias("metadata"),
    )


def rule(spark, rows):
    """(rule, device, operator, threshold, rate-limit seconds, enabled)"""
    made = spark.createDataFrame(
        rows, "rule_id string, device_id string, operator string, threshold double, "
              "time_window_seconds int, enabled boolean")
    fixed = {"name": "n", "sensor_type": "smoke", "severity": "HIGH", "alarm_type": "FIRE",
             "building_id": "b", "floor_id": "f", "room_id": "r", "zone_id": "z", "metadata": "{}"}
    return made.withColumns({k: F.lit(v) for k, v in fixed.items()})


def test_replayed_batch_repeats_nothing(spark, tmp_path):
    rules = rule(spark, [("r", "d", ">", 5.0, 0, True)])
    batches = [small_readings(spark, [(1, "d", 0, 9.0), (2, "d", 100, 9.0)]),
               small_readings(spark, [(3, "d", 299, 9.0), (4, "d", 300, 9.0)])]
    work = str(tmp_path)
    for replay in range(2):  # the second pass is a restarted process repeating batch 1
        for number, batch in enumerate(batches):
            if number >= replay:
                flows.AlarmSink(work, lambda: rules)(batch, number)
    assert stored(spark, work, "id") == [("1",), ("4",)]
    assert spark.read.parquet(f"{work}/topics").count() == 4


def test_late_rows_go_aside(spark, tmp_path):
    rules = rule(spark, [("r", "d", ">", 5.0, 0, True)])
    sink = flows.AlarmSink(str(tmp_path), lambda: rules)
    sink(small_readings(spark, [(1, "d", 1000, 9.0)]), 0)
    sink(small_readings(spark, [(2, "d", 500, 9.0), (3, "d", 1400, 9.0)]), 1)
    assert stored(spark, str(tmp_path), "id") == [("1",), ("3",)]
    assert rows_of(spark.read.parquet(f"{tmp_path}/late/batch=1"), "id") == [(2,)]


def test_state_is_pruned(spark, tmp_path):
    rules = rule(spark, [("r", "d", ">", 5.0, 60, True), ("q", "e", ">", 5.0, 0, True)])
    sink = flows.AlarmSink(str(tmp_path), lambda: rules)
    sink(small_readings(spark, [(1, "d", 0, 9.0)]), 0)
    sink(small_readings(spark, [(2, "e", 86400, 9.0)]), 1)
    assert rows_of(spark.read.parquet(f"{tmp_path}/state/batch=1"), "rule_id") == [("q",)]


def test_rule_changes_and_registry_take_effect_per_batch(spark, tmp_path):
    tables = {
        0: ([("r", "d1", ">", 5.0, 0, True)], ["d1", "d2"]),
        1: ([("r", "d1", ">", 9.0, 0, True), ("q", "d2", ">", 5.0, 0, True)], ["d1", "d2"]),
        2: ([("q", "d2", ">", 5.0, 0, True)], ["d1"]),
        3: ([("q", "d2", ">", 5.0, 0, False)], ["d1", "d2"]),
    }
    now = {"batch": 0}
    sink = flows.AlarmSink(
        str(tmp_path),
        lambda: rule(spark, tables[now["batch"]][0]),
        lambda: spark.createDataFrame(
            [(d, True) for d in tables[now["batch"]][1]], "device_id string, enabled boolean"
        ),
    )
    for batch in tables:
        now["batch"] = batch
        start = 10_000 * batch
        sink(small_readings(spark, [(10 * batch + 1, "d1", start, 7.0),
                                    (10 * batch + 2, "d2", start, 7.0)]), batch)
    assert stored(spark, str(tmp_path), "id", "rule_id") == [("1", "r"), ("12", "q")]


def test_ingest_flow_equals_batch(spark, inputs, tmp_path):
    messages, registry = instants(inputs.wide_messages), inputs.registry
    stream = as_stream(messages, tmp_path / "in", 2)
    path = str(tmp_path / "t")
    finish(flows.ingest_flow(stream, lambda: registry, path, str(tmp_path / "cp")))
    kept = dv.gate(rd.changed_messages(messages), registry)
    expected = kept.select("message_id", F.posexplode("readings").alias("pos", "r"))
    assert rows_of(spark.read.parquet(path), "message_id", "pos") == rows_of(
        expected, "message_id", "pos"
    )


def test_health_listener(spark, inputs, tmp_path):
    listener = flows.HealthListener("flow")
    spark.streams.addListener(listener)
    try:
        alarms = instants(inputs.alarms)
        stream = flows.observed(
            as_stream(alarms, tmp_path / "in", 2), "flow", F.col("value") <= 100,
            F.col("severity"), F.col("value") > 120,
        )
        finish(
            stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp"))
        )
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        got = listener.summary()
    finally:
        spark.streams.removeListener(listener)
    total, ok = alarms.count(), alarms.where("value <= 100").count()
    assert (got["total"], got["succeeded"], got["batches"]) == (total, ok, 2)
    assert abs(got["success_rate"] - 100.0 * ok / total) < 1e-9
    assert got["active"] == alarms.where("value <= 120").count()
    assert flows.HealthListener("x").summary()["success_rate"] == 0.0
