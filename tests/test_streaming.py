"""Batch/stream parity: the same rows, fed in several micro-batches, give the batch result."""

import pytest
from pyspark.sql import functions as F

from embertide.operators import devices as dv
from embertide.operators import readings as rd
from embertide.operators import rules as rl
from embertide.operators import suppression as sp
from embertide.streaming import flows
from embertide.streaming.processors import Throttle  # noqa: F401

DAY = 86400
GAP = 6 * 3600


def instants(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names or ("ts",)})


def as_stream(df, folder, parts, order="ts"):
    """Write ``df`` as ``parts`` files in time order and read it as a stream."""
    spark = df.sparkSession
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for part in range(parts):
        piece = spark.createDataFrame(rows[part * size:(part + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, spark, tmp_path, name):
    out, checkpoint = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp")
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(out)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_dedup_stream_equals_batch(spark, inputs, tmp_path, parts):
    data = instants(inputs.sensor_data)
    keys = ["device_id", "sensor_type"]
    stream = flows.dedup_stream(as_stream(data, tmp_path / "in", parts), keys, DAY)
    out = run(stream, spark, tmp_path, "dedup")
    batch = rl.deduplicated(data, DAY, None, keys)
    assert rows_of(out.where("status = 'accepted'"), "id") == rows_of(batch, "id")


def test_two_windows_on_one_state_equal_batch(spark, inputs, tmp_path):
    matches = rl.match_rules(instants(inputs.sensor_data), inputs.rules)
    stream = flows.throttle_stream(
        as_stream(matches, tmp_path / "in", 3), rl.ALARM_KEY, ["time_window_seconds", DAY]
    )
    out = run(stream, spark, tmp_path, "two")
    assert rows_of(out, "id", "rule_id") == rows_of(rl.raised(matches, DAY), "id", "rule_id")


def test_change_filter_stream_equals_batch(spark, inputs, tmp_path):
    messages = instants(inputs.wide_messages)
    out = run(
        flows.change_filter_stream(as_stream(messages, tmp_path / "in", 3)), spark, tmp_path, "cf"
    )
    batch = rd.changed_messages(messages)
    assert out.where("status = 'late'").count() == 0
    assert rows_of(out.distinct(), "message_id", "pos") == rows_of(
        batch.select("message_id", F.posexplode("readings").alias("pos", "r")), "message_id", "pos"
    )


def test_liveness_stream_equals_batch(spark, inputs, tmp_path):
    beats = instants(inputs.heartbeats)
    out = run(
        flows.liveness_stream(as_stream(beats, tmp_path / "in", 3), GAP, "1 hour"),
        spark, tmp_path, "live",
    )
    intervals = dv.online_intervals(beats, GAP)
    assert rows_of(out.where("event = 'connected'"), "device_id", "at") == rows_of(
        intervals, "device_id", "online_at"
    )
    # A device's last interval is only closed once the watermark passes its end.
    offline = rows_of(out.where("event = 'disconnected'"), "device_id", "at")
    expected = rows_of(intervals, "device_id", "offline_at")
    assert set(offline) <= set(expected)
    end = beats.agg(F.max("ts")).first()[0]
    closed = rows_of(
        intervals.where(F.col("offline_at") < F.lit(end) - F.expr("INTERVAL 2 HOURS")),
        "device_id", "offline_at",
    )
    assert set(closed) <= set(offline)


def test_suppression_stream_equals_batch(spark, inputs, tmp_path):
    requests = instants(inputs.suppression_requests)
    seconds = 5 * DAY
    out = run(
        flows.suppression_stream(as_stream(requests, tmp_path / "in", 3), seconds),
        spark, tmp_path, "sup",
    )
    batch = sp.decide(requests, seconds)
    columns = ("request_id", "activated_at", "outcome")
    assert rows_of(out, *columns) == rows_of(batch, *columns)


def test_bucket_stream_equals_batch(spark, inputs, tmp_path):
    data = instants(inputs.sensor_data)
    out = run(
        flows.bucket_stream(as_stream(data, tmp_path / "in", 3), "5 hours"), spark, tmp_path, "b"
    )
    done = out.agg(F.max("bucket")).first()[0]
    batch = rd.bucketed(data, "5 hours").where(F.col("bucket") <= F.lit(done))
    columns = ("device_id", "sensor_type", "bucket", "min_value", "n")
    assert rows_of(out, *columns) == rows_of(batch, *columns)


def test_alarm_life_stream(spark, inputs, tmp_path):
    from embertide.operators.alarms import active_alarms

    alarms, actions = instants(inputs.raised), instants(inputs.actions)
    stream = flows.alarm_life_stream(
        as_stream(alarms, tmp_path / "alarms", 1), as_stream(actions, tmp_path / "actions", 1)
    )
    out = run(stream, spark, tmp_path, "life")
    resolved = out.where("action = 'RESOLVE'").select("alarm_id")
    still = out.where("action = 'RAISE'").join(resolved, "alarm_id", "left_anti")
    assert rows_of(still, "alarm_id") == rows_of(active_alarms(alarms, actions), "id")
    acked = out.where("action = 'ACK'").join(resolved, "alarm_id", "left_anti")
    assert rows_of(acked, "alarm_id") == rows_of(
        active_alarms(alarms, actions).where("acknowledged"), "id"
    )


def test_late_rows_are_labelled(spark, tmp_path):
    schema = "id long, k string, ts timestamp"
    folder = str(tmp_path / "in")
    for batch in ([(1, "a", "2024-01-01 01:00:00")],
                  [(2, "a", "2024-01-01 00:59:00"), (3, "a", "2024-01-01 01:04:59"),
                   (4, "a", "2024-01-01 01:05:00")]):
        spark.createDataFrame(batch, "id long, k string, ts string").select(
            "id", "k", F.col("ts").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run(flows.dedup_stream(stream, ["k"], 300), spark, tmp_path, "late")
    assert rows_of(out, "id", "status") == [(1, "accepted"), (2, "late"), (4, "accepted")]


@pytest.mark.parametrize("name", ["throttle", "change", "suppression", "life"])
def test_a_key_larger_than_memory_is_ordered_in_the_state_store(spark, inputs, tmp_path, monkeypatch, name):
    """With a bound of a few rows every key spills; the rows that come out are the same."""
    from embertide.streaming import processors as pr

    if name == "throttle":
        data = instants(inputs.sensor_data).withColumn("k", F.lit("one"))
        make = lambda rows: flows.dedup_stream(rows, ["k"], 3600)
        order, columns = "value", ("id", "status")
    elif name == "change":
        data = instants(inputs.wide_messages).withColumn("device_id", F.lit("one"))
        make, order, columns = flows.change_filter_stream, "message_id", ("message_id", "pos", "status")
    elif name == "suppression":
        data = instants(inputs.suppression_requests).withColumn("device_id", F.lit("one"))
        make = lambda rows: flows.suppression_stream(rows, 3600)
        order, columns = "request_id", ("request_id", "activated_at", "outcome")
    else:
        data = instants(inputs.raised).select("id", "device_id", "severity", "ts").limit(3)
        make, order, columns = None, "id", ("alarm_id", "action", "actor", "ts")
    outs = []
    for bound, part, fan in ((50_000, 1000, 32), (40, 7, 3)):
        monkeypatch.setattr(pr, "HELD_ROWS", bound)
        monkeypatch.setattr(pr, "PART_ROWS", part)
        monkeypatch.setattr(pr, "FAN_IN", fan)
        folder = tmp_path / str(bound)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
        try:
            if make:
                stream = make(as_stream(data, folder / "in", 2, order))
            else:
                acts = data.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(60)))).select(
                    F.col("id").alias("alarm_id"), F.lit("ACK").alias("action"),
                    F.lit("a").alias("actor"),
                    (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"))
                stream = flows.alarm_life_stream(
                    as_stream(data, folder / "a", 2), as_stream(acts, folder / "b", 2, "alarm_id"))
            outs.append(rows_of(run(stream, spark, tmp_path, f"spill{bound}"), *columns))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert outs[0] == outs[1] and outs[0]


def test_presence_stream_equals_liveness_at_several_instants(spark, tmp_path):
    """Beats and other messages in two streams that run apart; connected exactly where the rule says so."""
    import random
    from datetime import datetime, timedelta, timezone

    rng = random.Random(4)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    beats = [(d, start + timedelta(seconds=rng.randint(0, 3000))) for d in "ab" for _ in range(60)]
    other = [(d, start + timedelta(seconds=rng.randint(0, 3000))) for d in "abc" for _ in range(150)]
    end = [(d, start + timedelta(hours=3)) for d in "z"]
    schema = "device_id string, ts timestamp"
    hb, ac = spark.createDataFrame(beats + end, schema), spark.createDataFrame(other + end, schema)
    streams = as_stream(hb, tmp_path / "hb", 2), as_stream(ac, tmp_path / "ac", 5)
    out = run(flows.presence_stream(*streams, watermark="10 minutes"), spark, tmp_path, "presence")
    # of equal times a connection ends before the next one begins
    events = sorted(((r.device_id, r["at"], r.event) for r in out.collect()), key=lambda e: (*e[:2], e[2] == "connected"))
    assert len(events) > 60
    for second in range(5, 3100, 73):
        at = start + timedelta(seconds=second)
        want = {r.device_id: r.connected for r in dv.liveness_at(hb, at, activity=ac).collect()} if second % 5 == 0 else {}
        for device, connected in want.items():
            mine = [e for d, t, e in events if d == device and t.replace(tzinfo=timezone.utc) <= at]
            assert (bool(mine) and mine[-1] == "connected") == bool(connected), (device, second)


@pytest.mark.parametrize("name", ["dedup", "presence", "life"])
def test_state_is_held_by_shard_not_by_key(spark, tmp_path, name):
    """Thousands of keys of one row each are read and written as a shard's, not one by one."""
    n = 6000
    rows = spark.range(n).select(
        "id", F.concat(F.lit("d"), F.col("id")).alias("device_id"), F.lit("LOW").alias("severity"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    actions = live.where("id < 0").select(
        F.col("id").alias("alarm_id"), F.lit("ACK").alias("action"), F.lit("a").alias("actor"), "ts")
    stream = {
        "dedup": lambda: flows.dedup_stream(live, ["device_id"], DAY),
        "presence": lambda: flows.presence_stream(live, live, 10**7, 10**7),
        "life": lambda: flows.alarm_life_stream(live, actions),
    }[name]()
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert query.awaitTermination(300) and query.exception() is None
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 4 * flows.SHARDS
    if name != "presence":
        assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == n


def test_alarms_and_actions_over_several_micro_batches(spark, tmp_path, monkeypatch):
    """Actions wait for their alarm however many others wait too; what follows a RESOLVE has no effect."""
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    monkeypatch.setattr(flows, "SHARDS", 1)
    big = 2**53 + 1
    raised = [[(1, "d", "LOW", at(0)), (big, "d", "LOW", at(0))], [(2, None, "LOW", at(5))],
              [(9, "d", "HIGH", at(0)), (None, "d", "LOW", at(0))]]
    acts = [[(1, "RESOLVE", "x", at(3)), (2, "ACK", "x", at(4)), (2, "ACK", "y", at(6)), (3, "ACK", "x", at(1))],
            [(1, "ACK", "late", at(9)), (3, "RESOLVE", "x", at(2)), (big, "ACK", "z", at(1))],
            [(1, "RESOLVE", "again", at(10)), (2, "RESOLVE", "x", at(8))]]
    for name, schema, parts in (("a", "id long, device_id string, severity string, ts string", raised),
                                ("b", "alarm_id long, action string, actor string, ts string", acts)):
        for part in parts:
            spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(
                1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / name))
    out = run(flows.alarm_life_stream(
        read("a", "id long, device_id string, severity string, ts timestamp"),
        read("b", "alarm_id long, action string, actor string, ts timestamp")), spark, tmp_path, "several")
    found = [tuple(r) for r in out.select(F.coalesce("alarm_id", F.lit(-1)), "action", "actor").collect()]
    want = [(1, "RAISE", None), (1, "RESOLVE", "x"), (2, "RAISE", None), (2, "ACK", "y"), (2, "RESOLVE", "x"),
            (9, "RAISE", None), (-1, "RAISE", None), (big, "RAISE", None), (big, "ACK", "z")]
    assert sorted(found, key=repr) == sorted(want, key=repr)
