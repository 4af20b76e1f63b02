"""Registered queries over topics, stored tables and sketches, next to the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.instants import time_bucket
from embertide.operators import devices as dv, ids, metrics as mt, percentiles, rules as rl, sync as sy
from embertide.operators import alarms as al
from embertide.plans.inputs import with_inputs
from embertide.plans.queries import (
    _HOLDS, _THRESHOLDS, BOUNDS, END, HOURS_6, IN_WINDOW, START, _finished, _live, ntz, query, rounded,
)
from embertide.schemas import RAISED_ALARM
from embertide.session import scratch
from embertide.sources import store, tables, topics
from embertide.sources.buckets import BucketedSink, MaintainedBuckets
from embertide.sources.keyed import KeyedTable
from embertide.streaming import flows

HOURS_2 = 2 * 3600


def instants(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names or ("ts",)})


def _halves(df: DataFrame, key: str) -> list[DataFrame]:
    """The rows in two parts by a hash, each over the whole span of time."""
    part = F.pmod(F.xxhash64(key), F.lit(2))
    return [df.where(part == n) for n in (0, 1)]


# --- topics ---------------------------------------------------------------------------------------------


def _topic(i, rows: DataFrame, name: str) -> topics.Topic:
    """Rows as the records of a file topic."""
    topic = topics.Topic(name, "json", scratch(i.spark, "topics"))
    topics.encode(rows).write.json(f"{topic.location}/{name}")
    return topic


@query("s1_sensor_topic", with_inputs(
    "SELECT id, device_id, sensor_type, value, unit, ts FROM sensor_data", "sensor_data"))
def _(i):
    topic = _topic(i, instants(i.sensor_data), topics.SENSOR_TOPIC)
    read = _finished(topics.sensor_stream(i.spark, topic))
    return ntz(read.select("id", "device_id", "sensor_type", "value", "unit", "ts"), "ts")


@query("s2_alarm_topic", with_inputs(
    "SELECT id, device_id, severity, value, ts FROM raised", "raised"))
def _(i):
    topic = _topic(i, instants(i.raised), topics.ALARM_TOPIC)
    read = _finished(topics.alarm_stream(i.spark, topic))
    return ntz(read.select("id", "device_id", "severity", "value", "ts"), "ts")


@query("s6_keyed_topic", with_inputs(
    "SELECT device_id AS key, id, severity, value, ts FROM raised", "raised"))
def _(i):
    topic = topics.Topic(topics.ALARM_TOPIC, "json", scratch(i.spark, "topics"))
    rows = _live(i).raised
    run = topic.write(topics.encode(rows), scratch(i.spark, "checkpoint"))
    run.trigger(availableNow=True).start().awaitTermination()
    records = i.spark.read.schema(topics.RECORD).json(f"{topic.location}/{topic.name}")
    back = topics.decode(records, RAISED_ALARM)
    keys = records.select("key", F.get_json_object("value", "$.id").cast("long").alias("id"))
    return ntz(back.join(keys, "id").select("key", "id", "severity", "value", "ts"), "ts")


@query("s11_rule_documents", with_inputs(
    """SELECT rule_id, device_id, sensor_type, operator, threshold, time_window_seconds, severity, enabled
    FROM rules""", "rules"))
def _(i):
    rules, path = i.rules, scratch(i.spark, "rules")
    named = [F.col(c).alias(topics._camel(c)) for c in rules.columns if c != "rule_id"]
    rules.select(
        F.concat(F.lit(tables.RULE_PREFIX), "rule_id").alias("key"), F.to_json(F.struct(*named)).alias("value")
    ).write.json(path)
    return tables.load_rules(i.spark, path).select(
        "rule_id", "device_id", "sensor_type", "operator", "threshold", "time_window_seconds", "severity", "enabled")


# --- stored tables ------------------------------------------------------------------------------------------


@query("s9_compacted_store", with_inputs(
    "SELECT id, device_id, sensor_type, value, ts FROM sensor_data", "sensor_data"))
def _(i):
    folder = scratch(i.spark, "store")
    for part in _halves(i.sensor_data.select("id", "device_id", "sensor_type", "value", "ts"), "id"):
        store.append(part, folder)
    store.compact(i.spark, folder, END)
    store.append(i.sensor_data.select("id", "device_id", "sensor_type", "value", "ts").limit(0), folder)
    return store.read_store(i.spark, folder).drop("day")


@query("s12_retained_store", with_inputs(
    f"SELECT id, device_id, severity, ts FROM alarms WHERE epoch_us(ts) // 1000 > epoch_us(TIMESTAMP '{START[:10]} {START[11:19]}') // 1000",
    "alarms"))
def _(i):
    folder = scratch(i.spark, "store")
    store.append(i.alarms.select("id", "device_id", "severity", "ts"), folder)
    store.retain(i.spark, folder, START, 0)
    return store.read_store(i.spark, folder).drop("day")


@query("r5_maintained_buckets", with_inputs(
    """SELECT device_id, sensor_type, time_bucket(INTERVAL 5 HOUR, ts) AS bucket, round(avg(value), 6) AS avg_value,
    min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM sensor_data GROUP BY 1, 2, 3""",
    "sensor_data"))
def _(i):
    # The second micro-batch reaches back over the whole span of time, so its rows are up to weeks late.
    folder = scratch(i.spark, "buckets")
    kept = MaintainedBuckets(i.spark, f"{folder}/readings", folder, "5 hours", 64)
    sink = BucketedSink(f"{folder}/readings", kept)
    for number, part in enumerate(_halves(instants(i.sensor_data.select("id", "device_id", "sensor_type", "value", "ts")), "id")):
        sink(part, number)
    return rounded(ntz(kept.read(), "bucket"), "avg_value")


@query("j9_stored_merge", with_inputs(
    f"""SELECT id, device_id, type, CASE WHEN {IN_WINDOW} THEN 'LOW' ELSE severity END AS severity,
    value, ts FROM alarms""", "alarms"))
def _(i):
    rows = i.alarms.select("id", "device_id", "type", "severity", "value", "ts")
    table = KeyedTable(i.spark, scratch(i.spark, "alarms"), ["id"], 64)
    table.replace(rows)
    table.merge(sy.latest_by_id(al.in_window(rows, START, END).withColumn("severity", F.lit("LOW"))))
    return table.read()


@query("p13_stored_registry", with_inputs(
    """SELECT device_id, active, enabled, ts AS last_updated FROM device_changes QUALIFY
    row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) = 1""", "device_changes"))
def _(i):
    table = KeyedTable(i.spark, scratch(i.spark, "devices"), ["device_id"], 64)
    for part in _halves(i.device_changes, "seq"):
        table.merge(part, dv.newer_devices)
    return table.read().select("device_id", "active", "enabled", F.col("ts").alias("last_updated"))


@query("p14_stored_thresholds", with_inputs(
    "SELECT device_id, sensor_type, t AS threshold FROM newest", "threshold_changes", extra=_THRESHOLDS))
def _(i):
    table = KeyedTable(i.spark, scratch(i.spark, "thresholds"), rl.SENSOR_KEY, 64)
    for part in _halves(i.threshold_changes, "seq"):
        table.merge(part, rl.newer_thresholds)
    return table.read().select(*rl.SENSOR_KEY, "threshold")


# --- live changes -----------------------------------------------------------------------------------------------


@query("r10_live_registry", with_inputs(
    """SELECT s.id::VARCHAR AS id, s.rule_id, s.device_id, s.ts FROM (SELECT s.id, r.rule_id, s.device_id, s.ts,
      r.time_window_seconds AS w FROM sensor_data s JOIN rules r ON s.device_id = r.device_id
      AND s.sensor_type = r.sensor_type AND """ + _HOLDS + """ WHERE r.enabled) s
    SEMI JOIN (SELECT device_id FROM registry WHERE enabled) USING (device_id)""", "sensor_data", "rules", "registry"))
def _(i):
    # rules without windows and no de-duplication: every match of a registered device is one alarm
    folder = scratch(i.spark, "alarms")
    sink = flows.AlarmSink(
        folder, lambda: i.rules.withColumn("time_window_seconds", F.lit(0)), lambda: i.registry, dedup_seconds=0)
    flows.alarm_flow(_live(i).sensor_data, sink, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ntz(store.read_store(i.spark, f"{folder}/history").select("id", "rule_id", "device_id", "ts"), "ts")


@query("r11_live_rules", with_inputs(
    f"""SELECT s.id::VARCHAR AS id, r.rule_id, s.ts FROM sensor_data s JOIN changed r
    ON s.device_id = r.device_id AND s.sensor_type = r.sensor_type AND {_HOLDS} WHERE r.enabled""",
    "sensor_data", "rules", "threshold_changes",
    extra=_THRESHOLDS + """, changed AS (SELECT r.* REPLACE (coalesce(n.t, r.threshold) AS threshold) FROM rules r
      LEFT JOIN newest n USING (device_id, sensor_type))"""))
def _(i):
    # The rules change after the flow was made and before the readings come: only the new thresholds count.
    folder, now = scratch(i.spark, "alarms"), {"rules": i.rules.where("false")}
    sink = flows.AlarmSink(folder, lambda: now["rules"], dedup_seconds=0)
    run = flows.alarm_flow(_live(i).sensor_data, sink, f"{folder}/checkpoint")
    now["rules"] = rl.apply_thresholds(i.rules, i.threshold_changes).withColumn("time_window_seconds", F.lit(0))
    run.trigger(availableNow=True).start().awaitTermination()
    return ntz(store.read_store(i.spark, f"{folder}/history").select("id", "rule_id", "ts"), "ts")


@query("r12_repeated_batches", with_inputs(
    "SELECT id, device_id, type, severity, value, ts FROM alarms", "alarms"))
def _(i):
    # every micro-batch comes twice, the second time to a sink that knows nothing of the first
    folder, rows = scratch(i.spark, "store"), i.alarms.select("id", "device_id", "type", "severity", "value", "ts")
    for number, part in enumerate(_halves(rows, "id")):
        for _ in range(2):
            store.StoreSink(folder, ("id", "ts"))(part, number)
    return store.read_store(i.spark, folder).drop("day")


_PRESENCE = f"""beats AS (SELECT device_id, ts FROM sensor_data WHERE sensor_type = 'temperature'),
    m AS (SELECT device_id, ts, true AS beat FROM beats UNION ALL SELECT device_id, ts, false FROM sensor_data),
    w AS (SELECT least((SELECT max(ts) FROM beats), (SELECT max(ts) FROM sensor_data)) - INTERVAL 10 MINUTE AS wm),
    r AS (SELECT m.*, epoch_us(ts) // {HOURS_2 * 1_000_000} AS slot FROM m),
    ready AS (SELECT r.*, wm FROM r, w WHERE make_timestamp((slot + 1) * {HOURS_2 * 1_000_000}) <= wm),
    waiting AS (SELECT device_id, min(slot) AS slot FROM r, w
      WHERE make_timestamp((slot + 1) * {HOURS_2 * 1_000_000}) > wm GROUP BY 1),
    s AS (SELECT *, max(CASE WHEN beat THEN ts END) OVER (PARTITION BY device_id ORDER BY ts, NOT beat
      ROWS UNBOUNDED PRECEDING) AS lb FROM ready),
    a AS (SELECT *, coalesce(lb + INTERVAL {HOURS_6} SECOND > ts, false) AS alive,
      least(lb + INTERVAL {HOURS_6} SECOND, ts + INTERVAL {HOURS_2} SECOND) AS ends FROM s),
    x AS (SELECT *, lag(alive) OVER o AS was, lag(ends) OVER o AS old, lead(ts) OVER o AS nxt FROM a
      WINDOW o AS (PARTITION BY device_id ORDER BY ts, NOT beat))"""


@query("r4_stream_presence", with_inputs(
    f"""SELECT device_id, 'connected' AS event, ts AS at FROM x
    WHERE alive AND (was IS NULL OR NOT was OR old <= ts)
    UNION ALL SELECT x.device_id, 'disconnected', ends FROM x LEFT JOIN waiting q ON q.device_id = x.device_id
    WHERE alive AND (CASE WHEN nxt IS NOT NULL THEN ends <= nxt ELSE ends <= wm AND (q.slot IS NULL
      OR ends <= make_timestamp(q.slot * {HOURS_2 * 1_000_000})) END)""", "sensor_data", extra=_PRESENCE))
def _(i):
    # Temperature readings are the heartbeats, all readings the traffic; the two are streams of their own.
    beats = _live(i).sensor_data.where("sensor_type = 'temperature'")
    return ntz(_finished(flows.presence_stream(beats, _live(i).sensor_data, HOURS_6, HOURS_2)), "at")


# --- sketches and rates -------------------------------------------------------------------------------------------


@query("a10_sketch_rollup_within_bound", with_inputs(
    "SELECT severity, type, true AS close FROM alarms GROUP BY 1, 2", "alarms"))
def _(i):
    # Hourly sketches merged over the whole time: the share of rows below an estimate is off by 1 % at most, or one row.
    keys, probs = ["severity", "type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rolled = percentiles.rollup(i.alarms, keys, "value", "ts", "1 hour")
    near = percentiles.from_rollup(rolled, keys, list(probs.values())).drop("n")
    shares = i.alarms.join(near, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("value") < F.col(c)).alias(f"{c}_below") for c in probs],
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_upto") for c in probs])
    slack = F.col("n") * 0.01 + 1
    fits = [(F.col(f"{c}_below") <= p * F.col("n") + slack) & (F.col(f"{c}_upto") >= p * F.col("n") - slack)
            for c, p in probs.items()]
    return shares.select(*keys, (fits[0] & fits[1] & fits[2]).alias("close"))


_SIX, _DAY = 21_600_000_000, 86_400_000_000
_EDGES = f"""le AS (SELECT unnest([5, 10, 25, 50, 100, 250, 'inf'::DOUBLE]) AS le),
    sampled AS (SELECT event_type AS series, le, ts, event_id, sum((value <= le)::INT) OVER (PARTITION BY event_type,
      le, epoch_us(ts) // {_DAY} ORDER BY ts, event_id)::DOUBLE AS value FROM events, le),
    grown AS (SELECT series, le, epoch_us(ts) AS us, value, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value
      ELSE value - p END AS g FROM (SELECT *, lag(value) OVER (PARTITION BY series, le ORDER BY ts, value) AS p FROM sampled)),
    spread AS (SELECT *, ceil(us / {_SIX}::DOUBLE)::BIGINT + k AS e FROM grown, (SELECT unnest([0, 1, 2, 3]) AS k)),
    wins AS (SELECT series, le, e, min({{'us': us, 'value': value, 'g': g}}) AS f, max(us) AS l, sum(g) AS all_g, count(*) AS n
      FROM spread GROUP BY 1, 2, 3 HAVING count(*) > 1),
    shape AS (SELECT *, all_g - f.g AS growth, (l - f.us)::DOUBLE AS span, (l - f.us)::DOUBLE / (n - 1) AS dist,
      (f.us - (e * {_SIX} - {_DAY}))::DOUBLE AS head, (e * {_SIX} - l)::DOUBLE AS tail FROM wins WHERE l > f.us),
    shape2 AS (SELECT *, least(head, coalesce(CASE WHEN growth > 0 AND f.value >= 0 THEN span * f.value / growth END, head)) AS head2
      FROM shape),
    rates AS (SELECT series, e, le, growth * (span + CASE WHEN head2 < dist * 1.1 THEN head2 ELSE dist / 2 END
      + CASE WHEN tail < dist * 1.1 THEN tail ELSE dist / 2 END) / span / 86400.0::DOUBLE AS r FROM shape2),
    summed AS (SELECT e, le, sum(r) AS r FROM rates GROUP BY 1, 2),
    level AS (SELECT e, le, max(r) OVER (PARTITION BY e ORDER BY le ROWS UNBOUNDED PRECEDING) AS c FROM summed),
    shaped AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below,
      max(c) OVER (PARTITION BY e) AS total, max(le) OVER (PARTITION BY e) AS top FROM level
      WINDOW w AS (PARTITION BY e ORDER BY le))"""


@query("a13_windowed_quantile", f"""WITH {_EDGES}
    SELECT make_timestamp(e * {_SIX}) AS window_end, prob, round(min(CASE WHEN le = 'inf'::DOUBLE THEN lo
      ELSE lo + (le - lo) * (prob * total - below) / (c - below) END), 6) AS quantile
    FROM shaped, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS prob)
    WHERE c >= prob * total AND below < prob * total AND total > 0 AND top = 'inf'::DOUBLE GROUP BY 1, 2""")
def _(i):
    # Counters of values up to each bound, set back every midnight, so that most windows hold a reset.
    events = i.table("events").withColumn("le", F.explode(F.array(*[F.lit(b) for b in (*BOUNDS, float("inf"))])))
    day = Window.partitionBy("event_type", "le", F.to_date("ts")).orderBy("ts", "event_id")
    samples = events.select(
        F.col("event_type").alias("series"), "le", "ts",
        F.sum((F.col("value") <= F.col("le")).cast("int")).over(day).cast("double").alias("value"))
    found = mt.windowed_quantiles(samples, (0.5, 0.95), seconds=86400, step_seconds=21600)
    return rounded(ntz(found, "window_end"), "quantile")


# --- ids --------------------------------------------------------------------------------------------------------------


@query("f2_crowded_ids", """WITH rows AS (SELECT event_id, epoch_us(time_bucket(INTERVAL 7 DAY, ts)) // 1000 AS ms,
      row_number() OVER (PARTITION BY epoch_us(time_bucket(INTERVAL 7 DAY, ts)) // 1000 ORDER BY event_id) - 1 AS k
      FROM events),
    counts AS (SELECT ms, count(*) AS n FROM rows GROUP BY 1),
    befores AS (SELECT ms, coalesce(sum(n) OVER (ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM counts),
    firsts AS (SELECT ms, s + max(ms * 256 - s) OVER (ORDER BY ms) AS first FROM befores)
    SELECT event_id, ((((first + k) // 256)::BIGINT - 1672531200000) << 23) | (7 << 13) | (1 << 8)
      | ((first + k) % 256)::BIGINT AS id FROM rows JOIN firsts USING (ms)""")
def _(i):
    # One machine, and all rows of a week in one millisecond: groups that are numbered in many tasks.
    events = i.table("events").withColumn("_week", time_bucket("7 days", F.col("ts")))
    made = ids.assign_ids(events, "_week", F.lit(7), F.lit(1), ["event_id"], hot_rows=1000)
    return made.select("event_id", "id")
