"""Sources, sinks and table layout on temporary folders."""

import json

from pyspark.sql import functions as F

from embertide.operators import readings as rd
from embertide.schemas import SENSOR_DATA
from embertide.sources import store, tables, topics
from test_streaming import instants, rows_of


def parquet_files(folder):
    return sorted(p for p in folder.rglob("*.parquet"))


def test_sink_stores_once_and_prunes_days(spark, inputs, tmp_path):
    path = str(tmp_path / "t")
    data = instants(inputs.sensor_data)
    sink = store.StoreSink(path, stamp="created_at")
    sink(data.union(data), 0)
    sink(data, 0)  # the same process repeats the batch
    store.StoreSink(path, stamp="created_at")(data, 0)  # a restarted process does
    table = store.read_store(spark, path)
    assert table.count() == data.count()
    assert table.where("created_at IS NULL").count() == 0
    plan = rd.in_range(table, "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in text and "2024-01-05" in text
    assert "PushedFilters: [IsNotNull(ts)" in text


def test_stream_to_store_from_topic_files(spark, inputs, tmp_path):
    data = instants(inputs.sensor_data)
    folder = tmp_path / "topics" / topics.SENSOR_TOPIC
    for n in range(2):  # every record is delivered twice
        topics.encode(data).coalesce(1).write.mode("append").json(str(folder))
    topic = topics.Topic(topics.SENSOR_TOPIC, "json", str(tmp_path / "topics"), per_trigger=1)
    query = store.store_readings(
        topics.sensor_stream(spark, topic), str(tmp_path / "t"), str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    stored = store.read_store(spark, str(tmp_path / "t"))
    columns = ("id", "device_id", "value", "ts")
    assert rows_of(stored, *columns) == rows_of(data, *columns)


def test_topic_sink_round_trip(spark, inputs, tmp_path):
    alarms = instants(inputs.raised)
    source = tmp_path / "in"
    alarms.write.parquet(str(source))
    stream = spark.readStream.schema(alarms.schema).parquet(str(source))
    topic = topics.Topic(topics.ALARM_TOPIC, "json", str(tmp_path / "topics"))
    query = topic.write(topics.encode(stream), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    records = spark.read.schema(topics.RECORD).json(f"{tmp_path}/topics/{topics.ALARM_TOPIC}")
    back = topics.decode(records, alarms.schema)
    assert rows_of(back, "id", "device_id", "severity", "value", "ts") == rows_of(
        alarms, "id", "device_id", "severity", "value", "ts"
    )
    assert rows_of(records.select("key").distinct(), "key") == rows_of(
        alarms.select("device_id").distinct(), "device_id"
    )


def test_device_messages_accept_both_shapes(spark):
    texts = [
        ("d1", '{"type":"data","timestamp":1625097600000,"readings":[{"type":"co","value":1},'
               '{"type":"smoke","value":2.5}]}'),
        (None, '{"type":"data","deviceId":"d2","sensorType":"temperature","value":24.5,'
               '"timestamp":"2021-07-01T00:00:00Z"}'),
        ("d3", '{"type":"heartbeat"}'),
        ("d4", "not json"),
    ]
    records = spark.createDataFrame(texts, "key string, value string")
    messages = topics.device_messages(records, F.lit("2024-01-01").cast("timestamp"))
    got = {r.device_id: r for r in messages.collect()}
    assert [(x.type, x.value) for x in got["d1"].readings] == [("co", 1.0), ("smoke", 2.5)]
    assert [(x.type, x.value) for x in got["d2"].readings] == [("temperature", 24.5)]
    assert got["d1"].ts == got["d2"].ts and got["d2"].type == "data"
    assert got["d3"].type == "heartbeat" and got["d3"].readings is None
    flat = rd.flatten_messages(messages)
    assert rows_of(flat, "device_id", "pos") == [("d1", 0), ("d1", 1), ("d2", 0)]


def test_decode_drops_bad_records(spark):
    rows = [("d", '{"id":1,"deviceId":"d","value":2,"timestamp":"2024-01-01T00:00:00Z"}'),
            ("d", "{broken"), ("e", '{"id":2,"value":3,"timestamp":1704067200000}'), ("d", None)]
    out = topics.decode(spark.createDataFrame(rows, "key string, value string"), SENSOR_DATA)
    assert rows_of(out, "id", "device_id") == [(1, "d"), (2, "e")]


def test_compaction_keeps_rows_and_replaces_only_closed_days(spark, inputs, tmp_path):
    path = tmp_path / "t"
    data = instants(inputs.sensor_data)
    for n in range(3):
        store.append(data.where(F.col("id") % 3 == n), str(path))
    before = rows_of(spark.read.parquet(str(path)), "id", "ts", "day")
    open_day = set(parquet_files(path / "day=2024-01-25"))
    days = store.compact(spark, str(path), "2024-01-28T00:00:00Z", files_per_day=1)
    assert max(d.isoformat() for d in days) == "2024-01-20"
    assert rows_of(spark.read.parquet(str(path)), "id", "ts", "day") == before
    assert set(parquet_files(path / "day=2024-01-25")) == open_day
    assert all(".zstd." in p.name for p in parquet_files(path / "day=2024-01-05"))
    one = spark.read.parquet(str(parquet_files(path / "day=2024-01-05")[0])).collect()
    keys = [(r.device_id, r.sensor_type, r.ts) for r in one]
    assert keys == sorted(keys)
    assert store.compact(spark, str(path), "2024-01-01T00:00:00Z") == []


def test_retention_boundary(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "2024-01-01 10:00:00"), (2, "2024-01-02 12:00:00"),
            (3, "2024-01-02 12:00:00.000999"), (4, "2024-01-02 12:00:00.001"),
            (5, "2024-01-05 00:00:00")]
    alarms = spark.createDataFrame(rows, "id long, t string").select(
        "id", F.col("t").cast("timestamp").alias("ts")
    )
    store.append(alarms, path)
    assert store.retain(spark, path, "2024-02-01T12:00:00Z") == 3
    assert rows_of(spark.read.parquet(path), "id") == [(4,), (5,)]
    assert [d.isoformat() for d in store.stored_days(spark, path)] == ["2024-01-02", "2024-01-05"]
    assert store.retain(spark, path, "2024-02-01T12:00:00Z") == 0


def test_empty_store(spark, tmp_path):
    empty = store.read_store(spark, str(tmp_path / "none"), SENSOR_DATA)
    assert empty.count() == 0 and "day" in empty.columns


def test_rule_and_threshold_documents(spark, tmp_path):
    body = {"name": "n", "deviceId": "d", "sensorType": "smoke", "operator": ">", "threshold": 5,
            "timeWindowSeconds": 60, "severity": "HIGH", "alarmType": "FIRE", "enabled": True}
    docs = [{"key": "alarm:rule:r:1", "value": json.dumps(body)},
            {"key": "alarm:rule:bad", "value": "{"},
            {"key": "alarm:threshold:d:smoke", "value": "12.5"},
            {"key": "alarm:threshold:d:co", "value": "x"}]
    path = tmp_path / "docs.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    rules = tables.load_rules(spark, str(path)).collect()
    assert [(r.rule_id, r.device_id, r.time_window_seconds, r.enabled) for r in rules] == [
        ("r:1", "d", 60, True)
    ]
    assert rows_of(tables.load_thresholds(spark, str(path)), "device_id", "sensor_type",
                   "threshold") == [("d", "smoke", 12.5)]
