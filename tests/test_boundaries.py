"""Boundary rows for every threshold, window end and error case."""

from datetime import datetime

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from embertide.functions import scalar
from embertide.functions.instants import as_datetime, time_bucket, width_parts
from embertide.operators import alarms as al
from embertide.operators import devices as dv
from embertide.operators import ids
from embertide.operators import metrics as mt
from embertide.operators import percentiles
from embertide.operators import readings as rd
from embertide.operators import rules as rl
from embertide.operators import suppression as sp
from embertide.operators import sync as sy
from test_streaming import rows_of

READINGS = "array<struct<type:string,value:double>>"


def at(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names or ("ts",)})


def messages(spark, rows):
    """(id, device, second, readings)"""
    made = spark.createDataFrame(rows, f"message_id long, device_id string, s long, readings {READINGS}")
    return made.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def alarms(spark, rows):
    """(id, time text, severity, type)"""
    made = spark.createDataFrame(rows, "id long, ts string, severity string, type string")
    return at(made).withColumn("device_id", F.lit("d"))


# --- messages ------------------------------------------------------------------------------


def test_validity_edges(spark):
    cases = [
        ([("temperature", -50.0)], True), ([("temperature", -50.01)], False),
        ([("temperature", 100.0)], True), ([("temperature", 100.01)], False),
        ([("humidity", 0.0)], True), ([("humidity", -0.01)], False),
        ([("humidity", 100.0)], True), ([("humidity", 100.1)], False),
        ([("smoke", 0.0)], True), ([("smoke", -1.0)], False),
        ([("co", 1e9)], True), ([("co", -0.1)], False),
        ([("motion", 1.0)], False), ([("temperature", None)], False), ([(None, 1.0)], False),
        ([], True), (None, False),
        ([("temperature", 20.0), ("humidity", 101.0)], False),
    ]
    df = messages(spark, [(n, "d", n, r) for n, (r, _) in enumerate(cases)])
    got = {r.message_id for r in rd.valid_messages(df).collect()}
    assert got == {n for n, (_, ok) in enumerate(cases) if ok}


@pytest.mark.parametrize("kind,before,after,dropped", [
    ("temperature", 20.0, 20.49, True), ("temperature", 20.0, 20.5, False),
    ("temperature", 20.0, 19.5, False), ("humidity", 40.0, 40.99, True),
    ("humidity", 40.0, 41.0, False), ("smoke", 4.99, 4.0, True), ("smoke", 4.99, 5.0, False),
    ("smoke", 5.0, 4.99, False), ("co", 1.0, 4.9, True), ("co", 6.0, 6.0, False),
])
def test_trivial_change_edges(spark, kind, before, after, dropped):
    df = messages(spark, [(1, "d", 1, [(kind, before)]), (2, "d", 2, [(kind, after)])])
    kept = sorted(r.message_id for r in rd.changed_messages(df).collect())
    assert kept == ([1] if dropped else [1, 2])


def test_change_filter_messages(spark):
    df = messages(spark, [
        (1, "d", 1, [("temperature", 20.0), ("humidity", 40.0)]),
        (2, "d", 2, [("temperature", 20.1), ("humidity", 40.1)]),   # all trivial
        (3, "d", 3, [("temperature", 20.2), ("humidity", 60.0)]),   # one is not
        (4, "d", 4, [("temperature", 500.0)]),                      # invalid: not remembered
        (5, "d", 5, [("temperature", 20.3)]),                       # trivial against 20.2
        (6, "d", 6, []),                                            # empty counts as trivial
        (7, "d", 7, [("temperature", 30.0), ("temperature", 30.1)]),  # same type twice
        (8, "e", 8, [("temperature", 20.3)]),                       # another device
    ])
    assert sorted(r.message_id for r in rd.changed_messages(df).collect()) == [1, 3, 7, 8]
    rate = rd.change_filter_rate(df).first()
    assert (rate.total, rate.filtered, rate.filter_rate) == (8, 4, 50.0)
    placed = {r.message_id: r.readings for r in rd.changed_messages(df).collect()}
    assert [tuple(x) for x in placed[7]] == [("temperature", 30.0), ("temperature", 30.1)]


# --- rules -------------------------------------------------------------------------------------


def test_rule_operators_and_validation(spark):
    readings = spark.createDataFrame(
        [(n, "d", "co", v) for n, v in enumerate((4.0, 5.0, 6.0))],
        "id long, device_id string, sensor_type string, value double",
    )
    rules = spark.createDataFrame(
        [(op, "d", "co", op, 5.0, True) for op in rl.OPERATORS],
        "rule_id string, device_id string, sensor_type string, operator string, "
        "threshold double, enabled boolean",
    )
    assert rows_of(rl.match_rules(readings, rules), "rule_id", "id") == sorted([
        (">", 2), (">=", 1), (">=", 2), ("<", 0), ("<=", 0), ("<=", 1), ("==", 1), ("!=", 0),
        ("!=", 2),
    ])
    off = rules.withColumn("enabled", F.lit(False))
    assert rl.match_rules(readings, off).count() == 0
    assert rl.match_rules(readings, off, respect_enabled=False).count() == 9
    for bad in ("=>", None):
        with pytest.raises(ValueError):
            rl.match_rules(readings, rules.withColumn("operator", F.lit(bad).cast("string")))


def test_rules_beyond_broadcast_bound_join_by_shuffle(spark, inputs, monkeypatch):
    import functools

    small = rl.match_rules(inputs.sensor_data, inputs.rules)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rl, "checked_broadcast", functools.partial(rl.checked_broadcast, max_rows=1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = rl.match_rules(inputs.sensor_data, inputs.rules)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert rows_of(large, "id", "rule_id") == rows_of(small, "id", "rule_id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rule_log_and_thresholds(spark):
    log = at(spark.createDataFrame(
        [("a", "upsert", 1.0, "2024-01-01", 1), ("a", "upsert", 2.0, "2024-01-02", 2),
         ("b", "upsert", 3.0, "2024-01-01", 3), ("b", "delete", None, "2024-01-03", 4),
         ("c", "delete", None, "2024-01-01", 5), ("c", "upsert", 9.0, "2024-01-01", 6)],
        "rule_id string, op string, threshold double, changed_at string, seq long"), "changed_at")
    assert rows_of(rl.current_rules(log), "rule_id", "threshold") == [("a", 2.0), ("c", 9.0)]
    none = spark.createDataFrame([], "device_id string, sensor_type string, threshold double, "
                                     "changed_at timestamp, seq long")
    assert rl.current_thresholds(none).count() == 0


# --- alarms ------------------------------------------------------------------------------------


def test_window_compares_whole_milliseconds(spark):
    df = alarms(spark, [(1, "2024-01-01 00:00:00.000999", "LOW", "GAS"),
                        (2, "2024-01-01 00:00:00.001", "LOW", "GAS"),
                        (3, "2024-01-01 00:00:00.002999", "LOW", "GAS"),
                        (4, "2024-01-01 00:00:00.003", "LOW", "GAS")])
    got = al.between(df, "2024-01-01T00:00:00.001500Z", "2024-01-01T00:00:00.002Z")
    assert [r.id for r in got.collect()] == [2, 3]
    with pytest.raises(ValueError):
        al.between(df, "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z")


def test_cursor_skips_same_millisecond(spark):
    df = alarms(spark, [(1, "2024-01-01 00:00:00.001", "LOW", "GAS"),
                        (2, "2024-01-01 00:00:00.002100", "LOW", "GAS"),
                        (3, "2024-01-01 00:00:00.002200", "LOW", "GAS"),
                        (4, "2024-01-01 00:00:00.003", "LOW", "GAS")])
    page = al.newest(df, 2)
    assert [r.id for r in page.collect()] == [4, 3]
    cursor = al.next_cursor(page).first().cursor
    assert [r.id for r in al.cursor_page(df, cursor, 2).collect()] == [1]
    assert [r.id for r in al.page(df, 1, 2).collect()] == [2, 1]
    assert al.next_cursor(df.limit(0)).first().cursor is None


def test_normalise_severity(spark):
    df = spark.createDataFrame(
        [(1, "low"), (2, "Medium"), (3, "critical"), (4, None)], "id long, severity string"
    ).select("id", "severity", F.lit("d").alias("device_id"), F.lit("FIRE").alias("alarm_type"),
             F.lit("f").alias("floor_id"), F.lit("z").alias("zone_id"),
             F.lit(None).cast("boolean").alias("acknowledged"),
             F.lit(True).alias("resolved"))
    out = {r.id: r for r in al.normalised(df).collect()}
    assert [out[str(n)].severity for n in (1, 2, 3, 4)] == ["LOW", "MEDIUM", "HIGH", "HIGH"]
    assert out["3"].message == "Alarm: FIRE - critical" and out["4"].severity_missing
    assert out["1"].acknowledged is False and out["1"].resolved is True


def test_type_count_is_exact_and_empty_stats(spark):
    df = alarms(spark, [(1, "2024-01-01 00:00:00.9", "HIGH", "SMOKE_DETECTED"),
                        (2, "2024-01-01 00:00:02.1", "low", "smoke")])
    stats = al.stats_summary(df).first()
    assert (stats.total, stats.type_smoke, stats.severity_low, stats.range_seconds) == (2, 1, 1, 2)
    empty = al.stats_summary(df.limit(0)).first()
    assert (empty.total, empty.type_fire, empty.oldest) == (0, 0, None)


def test_newest_100_then_filter_differs_from_newest_of_device(spark):
    rows = [(n, f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}", "LOW" if n > 5 else "HIGH", "GAS")
            for n in range(120)]
    df = alarms(spark, rows)
    high = F.col("severity") == "HIGH"
    assert al.newest_matching(df, high).count() == 0
    assert al.newest(df.where(high), 10).count() == 6


def test_active_alarms(spark):
    df = alarms(spark, [(n, "2024-01-01", "LOW", "GAS") for n in (1, 2, 3)])
    actions = at(spark.createDataFrame(
        [(1, "ACK", "x", "2024-01-02"), (1, "ACK", "y", "2024-01-03"),
         (2, "ACK", "x", "2024-01-02"), (2, "RESOLVE", "x", "2024-01-03"),
         (2, "ACK", "z", "2024-01-04"), (9, "RESOLVE", "x", "2024-01-03")],
        "alarm_id long, action string, actor string, ts string"))
    out = {r.id: r for r in al.active_alarms(df, actions).collect()}
    assert set(out) == {1, 3}
    assert out[1].acknowledged_by == "y" and out[3].acknowledged is False


# --- devices, suppression, sync -----------------------------------------------------------------


def test_liveness_edges(spark):
    beats = spark.createDataFrame(
        [("a", 0), ("a", 29), ("a", 59), ("a", 88), ("b", 60)], "device_id string, s long"
    ).select("device_id", F.timestamp_seconds("s").alias("ts"))
    got = dv.online_intervals(beats)
    span = got.select("device_id", F.unix_seconds("online_at").alias("a"),
                      F.unix_seconds("offline_at").alias("b"), "heartbeats")
    # exactly 30 s of silence ends an interval
    assert rows_of(span, "device_id", "a", "b", "heartbeats") == [
        ("a", 0, 59, 2), ("a", 59, 118, 2), ("b", 60, 90, 1)
    ]
    live = dv.liveness_at(beats, datetime(1970, 1, 1, 0, 1, 30))
    assert rows_of(live, "device_id", "connected") == [("a", True), ("b", False)]
    idle = dv.liveness_at(beats, datetime(1970, 1, 1, 0, 1, 38), activity=beats)
    assert rows_of(idle, "device_id", "connected") == [("a", False), ("b", False)]
    assert dv.connected_count(live).first()[0] == 1


def test_device_change_log(spark):
    new = spark.createDataFrame([("a",), ("b",)], "device_id string")
    registered = dv.registration(new, "2024-01-01T00:00:00Z").withColumn("seq", F.lit(1))
    off = dv.status_change(registered.where("device_id = 'a'"), "2024-01-02T00:00:00Z", enabled=False)
    log = registered.unionByName(off.withColumn("seq", F.lit(2)))
    assert rows_of(dv.current_devices(log), "device_id", "enabled", "last_updated") == [
        ("a", False, datetime(2024, 1, 2)), ("b", True, datetime(2024, 1, 1))]


def test_manual_alarm(spark):
    reading = spark.createDataFrame(
        [(1, "d", 9.0, "ppm", None)], "id long, device_id string, value double, unit string, metadata string"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    alarm = al.manual_alarms(reading, "FIRE", "HIGH", "seen by guard", room_id="lab-1").first()
    assert (alarm.alarm_type, alarm.room_id, alarm.zone_id, alarm.notes, alarm.acknowledged) == (
        "FIRE", "lab-1", None, "seen by guard", False)


def test_suppression_edges(spark):
    rows = [(1, 0, "gas"), (2, 10, "gas"), (3, 20, "foam"), (4, 1799, "gas"), (5, 1800, "foam"),
            (6, 1801, "gas")]
    requests = spark.createDataFrame(rows, "request_id long, s long, suppression_type string").select(
        "request_id", F.lit("d").alias("device_id"), F.lit("z").alias("zone_id"),
        "suppression_type", F.col("request_id").cast("int").alias("intensity"),
        F.timestamp_seconds("s").alias("ts"))
    decided = sp.decide(requests)
    assert rows_of(decided, "request_id", "outcome") == [
        (1, "activated"), (2, "updated"), (3, "rejected"), (4, "updated"), (5, "activated"),
        (6, "rejected"),
    ]
    now = sp.current(decided, datetime(1970, 1, 1, 0, 29, 59)).first()
    assert (now.suppression_type, now.suppression_intensity) == ("gas", 4)
    assert sp.current(decided, datetime(1970, 1, 1, 1, 0, 0)).count() == 0
    devices = spark.createDataFrame(
        [("d", True, True), ("x", True, True)], "device_id string, enabled boolean, connected boolean")
    status = {r.device_id: r for r in sp.full_status(devices, decided, datetime(1970, 1, 1, 1)).collect()}
    assert status["d"].counter_total_activations == 2 and not status["d"].suppression_active
    assert status["d"].last_activation_details == (
        '{"timestamp":1800000,"type":"foam","zone":"z","intensity":5}')
    assert status["x"].counter_total_activations is None
    closed = devices.withColumn("enabled", F.lit(False))
    assert sp.eligible(requests, closed).count() == 0
    assert sp.history(decided, 1).first().request_id == 5


def test_sync_marker_and_defaults(spark):
    log = at(spark.createDataFrame(
        [("a", "snapshot", "2024-01-01 00:00:00"), ("a", "pull", "2024-01-01 05:00:00")],
        "client_id string, kind string, ts string"))
    markers = sy.sync_markers(log)
    assert sy.marker_of(markers, "a") == datetime(2024, 1, 1) and sy.marker_of(markers, "b") is None
    df = alarms(spark, [(1, "2024-01-01 00:30:00", "LOW", "GAS"), (2, "2024-01-01 01:30:00", "LOW", "GAS"),
                        (3, "2024-01-01 02:00:00", "LOW", "GAS")])
    assert [r.id for r in sy.snapshot(df, "2024-01-01T02:00:00Z").collect()] == [2, 3]
    assert [r.id for r in sy.snapshot(df, "2024-01-01T02:00:00Z", "2024-01-01T00:00:00Z", 1).collect()] == [1]
    assert [r.id for r in sy.delta(df, "2024-01-01T02:00:00Z", "2024-01-01T00:00:00Z").collect()] == [1, 2, 3]
    reusable = sy.reusable_snapshots(log, "2024-01-01T00:04:59Z")
    assert reusable.count() == 1 and sy.reusable_snapshots(log, "2024-01-01T00:05:00Z").count() == 0
    merged = sy.merge_by_id(df, df.where("id = 1").withColumn("severity", F.lit("HIGH")))
    assert rows_of(merged, "id", "severity") == [(1, "HIGH"), (2, "LOW"), (3, "LOW")]


# --- metrics -------------------------------------------------------------------------------------


def test_counter_and_rates(spark):
    ops = spark.createDataFrame(
        [("d", "c", "INC", 5, 1), ("d", "c", "SET", 10, 2), ("d", "c", "INC", 1, 3),
         ("d", "e", "INC", 7, 4)],
        "device_id string, counter_name string, op string, amount long, seq long")
    assert rows_of(mt.counter_values(ops), "counter_name", "value") == [("c", 11), ("e", 7)]
    assert mt.counter_value(ops, "d", "none").first().value == 0
    samples = spark.createDataFrame(
        [("s", 0, 10.0), ("s", 10, 15.0), ("s", 20, 3.0)], "series string, s long, value double"
    ).select("series", F.timestamp_seconds("s").alias("ts"), "value")
    rate = mt.counter_rates(samples).first()
    assert (rate.increase, rate.per_second) == (8.0, 0.4)
    one = mt.counter_rates(samples.limit(1)).first()
    assert (one.increase, one.per_second) == (0.0, 0.0)


def test_health_of_nothing(spark):
    empty = spark.createDataFrame([], "b long, severity string, ok boolean")
    out = mt.flow_health(empty, F.col("ok"), "b", "severity", F.col("ok")).first()
    assert (out.total, out.success_rate, out.average_batch) == (0, 0.0, 0.0)


@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.one_of(st.integers(0, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=300))
def test_exact_percentiles_by_bracketing(spark, values):
    probs = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0)], "k string, v double")
    got = {r.k: r for r in percentiles.exact(df, ["k"], "v", probs, target_rows=3).collect()}
    exact = {r.k: r for r in percentiles.exact(df, ["k"], "v", probs).collect()}
    for key in ("g", "h"):
        assert list(got[key].asDict().values())[1:] == pytest.approx(
            list(exact[key].asDict().values())[1:], rel=1e-9, abs=1e-9)


# --- functions --------------------------------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(0, 1023), st.integers(0, 31),
                               st.integers(0, 255)), min_size=1, max_size=30))
def test_id_round_trip(spark, rows):
    df = spark.createDataFrame(
        [(ms + scalar.ID_EPOCH_MS, m, k, s) for ms, m, k, s in rows], "ms long, m int, k int, s int")
    packed = df.withColumn("id", scalar.encode_id(*[F.col(c) for c in ("ms", "m", "k", "s")]))
    i = F.col("id")
    back = packed.select("ms", "m", "k", "s", scalar.id_millis(i), scalar.id_machine(i),
                         scalar.id_kind(i), scalar.id_sequence(i), "id")
    for r in back.collect():
        assert tuple(r[:4]) == tuple(r[4:8])
        assert r.id == ((r.ms - scalar.ID_EPOCH_MS) << 23) | (r.m << 13) | (r.k << 8) | r.s


@pytest.mark.parametrize("kind,count,fails", [(-1, 1, True), (31, 256, False), (32, 1, True), (1, 257, False)])
def test_id_limits(spark, kind, count, fails):
    df = spark.range(count).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    made = ids.assign_ids(df.withColumnRenamed("id", "n"), "ts", F.lit(1), F.lit(kind), ["n"])
    if fails:
        with pytest.raises(PySparkException):
            made.collect()
    else:
        assert made.select("id").distinct().count() == count


@settings(max_examples=20, deadline=None)
@given(us=st.integers(-10**15, 4 * 10**15), width=st.sampled_from(
    ["1 second", "5 minutes", "1 hour", "5 hours", "1 day", "3 days", "7 days", "2 weeks",
     "1 month", "3 months", "1 year"]))
def test_bucket_equals_duckdb(spark, us, width):
    got = spark.range(1).select(
        time_bucket(width, F.timestamp_micros(F.lit(us)), True).alias("b")).first().b
    want = duckdb.sql(f"SELECT time_bucket(INTERVAL '{width}', make_timestamp({us}))").fetchall()[0][0]
    assert got == want


def test_bad_widths_and_instants():
    for bad in ("0 days", "1 fortnight", "day"):
        with pytest.raises(ValueError):
            width_parts(bad)
    assert as_datetime("2024-01-01T02:00:00+02:00") == datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        as_datetime("yesterday")


def test_json_and_text(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "value string")
    assert [r.a for r in scalar.from_document(df, "value", df.sparkSession.createDataFrame([], "a long").schema).collect()] == [1]
    bad = scalar.from_document(df, "value", spark.createDataFrame([], "a long").schema, "only")
    assert bad.count() == 2
    kept = df.select(scalar.json_or_null(F.col("value")).alias("v")).collect()
    assert [r.v for r in kept] == ['{"a": 1}', None, None]
    text = spark.range(1).select(scalar.percent_text(F.lit(12.345)), scalar.key_head(F.lit("a:b:c"))).first()
    assert tuple(text) == ("12.35%", "a")
    rooms = spark.createDataFrame([("Data kitchen",), ("LAB 1",), ("Hall",), (None,)], "r string")
    assert [r[0] for r in rooms.select(scalar.suppression_agent(F.col("r"))).collect()] == [
        "gas", "foam", "water", "water"]
