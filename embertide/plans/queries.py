"""Registered queries, each next to the SQL that must give the same rows.

Every query runs over whole tables. Floating-point aggregates are rounded to
six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertide.functions import scalar
from embertide.functions.instants import instant, time_bucket
from embertide.operators import (
    alarms as al, devices as dv, ids, metrics as mt, percentiles, readings as rd, rules as rl,
    suppression as sp, sync as sy,
)
from embertide.operators.ordered import SHAPE, first_anchored, hot_slices
from embertide.plans.inputs import Inputs, StreamedInputs, with_inputs
from embertide.session import configure, scratch
from embertide.sources.store import StoreSink
from embertide.streaming import flows

DEVICE, SENSOR = "device-7", "temperature"
START, END = "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z"
NOW = "2024-01-25T00:00:00Z"
_START, _END, _NOW = (
    f"TIMESTAMP '{v}'" for v in ("2024-01-05 00:00:00", "2024-01-20 12:00:00",
                                 "2024-01-25 00:00:00")
)
DAY = 86400
HOURS_6 = 6 * 3600
DAYS_5 = 5 * DAY
IN_WINDOW = (
    f"epoch_us(ts)//1000 BETWEEN epoch_us({_START})//1000 AND epoch_us({_END})//1000"
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def registered() -> dict[str, tuple[Query, str | None]]:
    from embertide.plans import stored_queries  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def query(name: str, oracle: str | None = None):
    """Register a function of the inputs; it may use ``inputs.spark``."""

    def add(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Inputs(configure(spark), folder))

        run.__name__ = name
        _QUERIES[name] = (run, oracle)
        return build

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


# --- readings ---------------------------------------------------------------------------


@query("p1_device_readings", with_inputs(
    f"SELECT * FROM sensor_data WHERE device_id = '{DEVICE}'", "sensor_data"))
def _(i):
    return rd.of_device(i.sensor_data, DEVICE)


@query("p2_sensor_readings", with_inputs(
    f"SELECT * FROM sensor_data WHERE device_id = '{DEVICE}' AND sensor_type = '{SENSOR}'",
    "sensor_data"))
def _(i):
    return rd.of_sensor(i.sensor_data, DEVICE, SENSOR)


@query("p3_device_range", with_inputs(
    f"SELECT * FROM sensor_data WHERE device_id = '{DEVICE}' AND ts BETWEEN {_START} AND {_END}",
    "sensor_data"))
def _(i):
    return rd.of_device_between(i.sensor_data, DEVICE, START, END)


@query("a1_value_summary", with_inputs(
    f"""SELECT round(avg(value), 6) AS avg_value, max(value) AS max_value, min(value) AS min_value
    FROM sensor_data WHERE device_id = '{DEVICE}' AND sensor_type = '{SENSOR}'
    AND ts BETWEEN {_START} AND {_END}""", "sensor_data"))
def _(i):
    return rounded(rd.value_summary(i.sensor_data, DEVICE, SENSOR, START, END), "avg_value")


def _bucket_sql(bucket: str, where: str = "") -> str:
    return with_inputs(
        f"""SELECT device_id, sensor_type, {bucket} AS bucket, round(avg(value), 6) AS avg_value,
        min(value) AS min_value, max(value) AS max_value, count(*) AS n
        FROM sensor_data {where} GROUP BY 1, 2, 3""", "sensor_data")


@query("a2_time_bucket", _bucket_sql("time_bucket(INTERVAL 1 HOUR, ts)"))
def _(i):
    return rounded(rd.bucketed(i.sensor_data, "1 hour"), "avg_value")


@query("a2_time_bucket_device", _bucket_sql(
    "time_bucket(INTERVAL 5 HOUR, ts)",
    f"WHERE device_id = '{DEVICE}' AND sensor_type = '{SENSOR}' "
    f"AND ts BETWEEN {_START} AND {_END}"))
def _(i):
    return rounded(
        rd.bucketed(i.sensor_data, "5 hours", START, END, DEVICE, SENSOR), "avg_value"
    )


@query("f3_time_bucket_widths", with_inputs(
    """SELECT time_bucket(INTERVAL 7 DAY, ts) AS week, time_bucket(INTERVAL 5 HOUR, ts) AS hours,
    time_bucket(INTERVAL 3 DAY, ts) AS days, time_bucket(INTERVAL 1 MONTH, ts) AS month,
    count(*) AS n FROM sensor_data GROUP BY 1, 2, 3, 4""", "sensor_data"))
def _(i):
    ts = F.col("ts")
    return i.sensor_data.groupBy(
        time_bucket("7 days", ts, True).alias("week"),
        time_bucket("5 hours", ts, True).alias("hours"),
        time_bucket("3 days", ts, True).alias("days"),
        time_bucket("1 month", ts, True).alias("month"),
    ).agg(F.count(F.lit(1)).alias("n"))


_VALID = """CASE {t} WHEN 'temperature' THEN {v} BETWEEN -50 AND 100
    WHEN 'humidity' THEN {v} BETWEEN 0 AND 100 WHEN 'smoke' THEN {v} >= 0
    WHEN 'co' THEN {v} >= 0 ELSE false END"""
_FLAT = """flat AS (SELECT message_id, device_id, ts, generate_subscripts(readings, 1) - 1 AS pos,
    unnest(readings) AS r FROM {messages}),
    ok AS (SELECT message_id FROM flat GROUP BY 1 HAVING bool_and(""" + _VALID.format(
    t="r.type", v="r.value") + """)),
    valid AS (SELECT flat.*, r.type AS sensor_type, r.value AS value FROM flat
      SEMI JOIN ok USING (message_id)),
    compared AS (SELECT *, lag(value) OVER (PARTITION BY device_id, sensor_type
      ORDER BY ts, message_id, pos) AS previous FROM valid),
    judged AS (SELECT message_id, bool_and(previous IS NOT NULL AND CASE sensor_type
      WHEN 'temperature' THEN abs(value - previous) < 0.5
      WHEN 'humidity' THEN abs(value - previous) < 1.0
      ELSE value < 5 AND previous < 5 END) AS trivial FROM compared GROUP BY 1)"""


@query("s3_flatten_messages", with_inputs(
    """SELECT message_id, device_id, ts, pos::INT AS pos, r.type AS sensor_type, r.value AS value
    FROM (SELECT message_id, device_id, ts, generate_subscripts(readings, 1) - 1 AS pos,
    unnest(readings) AS r FROM wide_messages)""", "wide_messages"))
def _(i):
    return rd.flatten_messages(i.wide_messages)


@query("p10_valid_messages", with_inputs(
    "SELECT m.message_id, m.device_id, m.ts FROM wide_messages m SEMI JOIN ok USING (message_id)",
    "wide_messages", extra=_FLAT.format(messages="wide_messages")))
def _(i):
    return rd.valid_messages(i.wide_messages).select("message_id", "device_id", "ts")


_CHANGED = """SELECT m.message_id, m.device_id, m.ts, len(m.readings)::INT AS n FROM {m} m
    SEMI JOIN (SELECT message_id FROM judged WHERE NOT trivial) k USING (message_id)"""


@query("w1_change_filter", with_inputs(
    _CHANGED.format(m="messages"), "messages", extra=_FLAT.format(messages="messages")))
def _(i):
    slices = hot_slices(i.sensor_data, ["device_id", "sensor_type"], "ts")
    kept = rd.changed_messages(i.messages, slices)
    return kept.select("message_id", "device_id", "ts", F.size("readings").alias("n"))


@query("w1_change_filter_sliced", with_inputs(
    _CHANGED.format(m="wide_messages"), "wide_messages",
    extra=_FLAT.format(messages="wide_messages")))
def _(i):
    # Two readings per message; keys above 20 readings take the time-sliced path.
    keys = ["device_id", "sensor_type"]
    slices = hot_slices(rd.flatten_messages(i.wide_messages), keys, "ts", 20, 3600)
    kept = rd.changed_messages(i.wide_messages, slices)
    return kept.select("message_id", "device_id", "ts", F.size("readings").alias("n"))


@query("a16_change_filter_rate", with_inputs(
    """SELECT t.total, t.total - k.kept AS filtered,
    round((t.total - k.kept) * 100.0::DOUBLE / t.total, 6) AS filter_rate
    FROM (SELECT count(*) AS total FROM messages) t,
    (SELECT count(*) AS kept FROM judged WHERE NOT trivial) k""",
    "messages", extra=_FLAT.format(messages="messages")))
def _(i):
    slices = hot_slices(i.sensor_data, ["device_id", "sensor_type"], "ts")
    return rounded(rd.change_filter_rate(i.messages, slices), "filter_rate")


# --- rules ------------------------------------------------------------------------------------

_HOLDS = """CASE r.operator WHEN '>' THEN s.value > r.threshold WHEN '>=' THEN s.value >= r.threshold
    WHEN '<' THEN s.value < r.threshold WHEN '<=' THEN s.value <= r.threshold
    WHEN '==' THEN s.value = r.threshold WHEN '!=' THEN s.value <> r.threshold END"""
_MATCHES = f"""matches AS (SELECT s.id, s.device_id, s.sensor_type, s.value, s.unit, s.ts,
    r.rule_id, r.name, r.operator, r.threshold, r.time_window_seconds, r.severity, r.alarm_type,
    r.building_id, r.floor_id, r.room_id, r.zone_id, r.metadata AS rule_metadata
    FROM sensor_data s JOIN rules r ON s.device_id = r.device_id
    AND s.sensor_type = r.sensor_type AND {_HOLDS} WHERE r.enabled)"""


def _chain(name: str, source: str, key: str, window: str) -> str:
    """Accepted (key, ts) of a first-anchored window, as a recursive CTE."""
    return f"""{name} AS (
      SELECT {key} AS k, min(ts) AS ts FROM {source} GROUP BY 1
      UNION ALL
      SELECT f.k, min(m.ts) FROM {name} f JOIN (SELECT {key} AS k, ts, {window} AS w
        FROM {source}) m ON m.k = f.k AND m.ts >= f.ts + to_seconds(m.w) AND m.ts > f.ts
      GROUP BY f.k, f.ts)"""


def _matches(i: Inputs) -> DataFrame:
    return rl.match_rules(i.sensor_data, i.rules)


def _rule_slices(i: Inputs, key: list[str]) -> DataFrame | None:
    """Slices of the rules whose sensor is large.

    Readings per sensor bound the matches per rule and are cheap to count.
    """
    slices = hot_slices(i.sensor_data, rl.SENSOR_KEY, "ts")
    if slices is None:
        return None
    return slices.join(i.rules.select(*rl.ALARM_KEY), rl.SENSOR_KEY).select(*key, *SHAPE)


_MATCH_COLUMNS = ("id", "rule_id", "device_id", "sensor_type", "ts", "value", "threshold",
                  "severity")


@query("j1_rule_match", with_inputs(
    f"SELECT {', '.join(_MATCH_COLUMNS)} FROM matches", "sensor_data", "rules", extra=_MATCHES))
def _(i):
    return _matches(i).select(*_MATCH_COLUMNS)


@query("w3_rate_limit", with_inputs(
    f"""SELECT {', '.join(_MATCH_COLUMNS)} FROM matches m SEMI JOIN limited l
    ON m.rule_id = l.k AND m.ts = l.ts""", "sensor_data", "rules", recursive=True,
    extra=f"{_MATCHES}, {_chain('limited', 'matches', 'rule_id', 'time_window_seconds')}"))
def _(i):
    slices = _rule_slices(i, ["rule_id"])
    return rl.rate_limited(_matches(i), slices).select(*_MATCH_COLUMNS)


_USER_TYPE = "device_id || '|' || sensor_type"
_DEDUP = f"""SELECT id, device_id, sensor_type, ts FROM sensor_data m SEMI JOIN kept
    ON {_USER_TYPE} = kept.k AND m.ts = kept.ts"""
_DEDUP_SQL = with_inputs(_DEDUP, "sensor_data", recursive=True,
                         extra=_chain("kept", "sensor_data", _USER_TYPE, str(DAY)))


@query("w2_dedup", _DEDUP_SQL)
def _(i):
    keys = ["device_id", "sensor_type"]
    slices = hot_slices(i.sensor_data, keys, "ts")
    return rl.deduplicated(i.sensor_data, DAY, slices, keys).select(
        "id", "device_id", "sensor_type", "ts"
    )


@query("w2_dedup_sliced", _DEDUP_SQL)
def _(i):
    # The same result through time slices for every key above 12 readings.
    keys = ["device_id", "sensor_type"]
    slices = hot_slices(i.sensor_data, keys, "ts", target_rows=12, slot_seconds=3600)
    return rl.deduplicated(i.sensor_data, DAY, slices, keys).select(
        "id", "device_id", "sensor_type", "ts"
    )


_RAISED_EXTRA = f"""{_MATCHES}, {_chain('limited', 'matches', 'rule_id', 'time_window_seconds')},
    first_pass AS (SELECT m.* FROM matches m SEMI JOIN limited l
      ON m.rule_id = l.k AND m.ts = l.ts),
    {_chain('kept', 'first_pass', 'rule_id', str(DAY))},
    new_alarms AS (SELECT m.* FROM first_pass m SEMI JOIN kept ON m.rule_id = kept.k
      AND m.ts = kept.ts)"""


def _raised(i: Inputs) -> DataFrame:
    return rl.raised(_matches(i), DAY, _rule_slices(i, rl.ALARM_KEY))


@query("r1_alarm_flow", with_inputs(
    """SELECT topic, id::VARCHAR AS id, device_id, alarm_type AS type,
    CASE WHEN severity IN ('HIGH', 'MEDIUM', 'LOW') THEN severity ELSE 'HIGH' END AS severity,
    'Alarm: ' || alarm_type || ' - ' || severity AS message, value, ts,
    'Triggered by rule: ' || name AS notes
    FROM (SELECT *, unnest(['all', lower(CASE WHEN severity IN ('HIGH', 'MEDIUM', 'LOW')
      THEN severity ELSE 'HIGH' END)]) AS topic FROM new_alarms)""",
    "sensor_data", "rules", recursive=True, extra=_RAISED_EXTRA))
def alarm_flow(i):
    """Flagship: match rules, rate-limit, de-duplicate, create, normalise, fan out."""
    made = al.normalised(al.create_alarms(_raised(i)))
    return al.fan_out(made).select(
        "topic", "id", "device_id", "type", "severity", "message", "value", "ts", "notes"
    )


@query("p5_create_alarms", with_inputs(
    """SELECT id, device_id, alarm_type, severity, value, unit, ts, building_id, floor_id,
    room_id, zone_id, false AS acknowledged, false AS resolved,
    'Triggered by rule: ' || name AS notes, rule_metadata AS metadata FROM matches""",
    "sensor_data", "rules", extra=_MATCHES))
def _(i):
    return al.create_alarms(_matches(i)).drop(
        "location_x", "location_y", "location_z", "acknowledged_at", "acknowledged_by",
        "resolved_at", "resolved_by",
    )


@query("p6_notifications", with_inputs(
    """SELECT m.rule_id || ':' || m.id AS id, m.ts, m.rule_id, m.name AS rule_name, m.device_id,
    m.sensor_type, m.value, m.threshold, m.operator, m.alarm_type, m.severity, m.building_id,
    m.floor_id, m.room_id, m.zone_id, d.location_x, d.location_y, d.location_z
    FROM matches m JOIN devices d USING (device_id)""",
    "sensor_data", "rules", "devices", extra=_MATCHES))
def _(i):
    places = i.devices.select("device_id", "location_x", "location_y", "location_z")
    placed = _matches(i).join(places, "device_id")
    return al.notifications(placed, scalar.composite_key(F.col("rule_id"), F.col("id")))


@query("p14_current_rules", with_inputs(
    """SELECT rule_id, threshold, changed_at FROM (SELECT *, row_number() OVER (
    PARTITION BY rule_id ORDER BY changed_at DESC, seq DESC) AS n FROM rule_log)
    WHERE n = 1 AND op <> 'delete'""", "rule_log"))
def _(i):
    return rl.current_rules(i.rule_log)


@query("p14_rule_by_id", with_inputs(
    "SELECT * FROM rules WHERE rule_id = 'rule-7'", "rules"))
def _(i):
    return rl.rule_by_id(i.rules, "rule-7")


_THRESHOLDS = """newest AS (SELECT device_id, sensor_type, threshold AS t FROM (SELECT *,
    row_number() OVER (PARTITION BY device_id, sensor_type ORDER BY changed_at DESC, seq DESC)
    AS n FROM threshold_changes) WHERE n = 1)"""


@query("j5_threshold_lookup", with_inputs(
    """SELECT s.id, s.device_id, s.sensor_type, s.value, t.t AS threshold FROM sensor_data s
    LEFT JOIN newest t USING (device_id, sensor_type)""",
    "sensor_data", "threshold_changes", extra=_THRESHOLDS))
def _(i):
    return rl.with_threshold(
        i.sensor_data.select("id", "device_id", "sensor_type", "value"),
        rl.current_thresholds(i.threshold_changes),
    )


@query("j6_threshold_update", with_inputs(
    """SELECT r.* REPLACE (coalesce(t.t, r.threshold) AS threshold) FROM rules r
    LEFT JOIN newest t USING (device_id, sensor_type)""",
    "rules", "threshold_changes", extra=_THRESHOLDS))
def _(i):
    return rl.apply_thresholds(i.rules, i.threshold_changes)


# --- alarms: shape ----------------------------------------------------------------------------


@query("p7_normalise", with_inputs(
    """SELECT id::VARCHAR AS id, device_id, alarm_type AS type,
    CASE WHEN upper(severity) IN ('HIGH', 'MEDIUM', 'LOW') THEN upper(severity) ELSE 'HIGH' END
      AS severity,
    'Alarm: ' || alarm_type || ' - ' || severity AS message, floor_id || ' - ' || zone_id
      AS location, false AS acknowledged, false AS resolved, value, ts
    FROM raised""", "raised"))
def _(i):
    return al.normalised(i.raised).select(
        "id", "device_id", "type", "severity", "message", "location", "acknowledged", "resolved",
        "value", "ts",
    )


@query("p8_suppression_agent", with_inputs(
    """SELECT room_id, CASE WHEN lower(room_id) LIKE '%server%' OR lower(room_id) LIKE '%data%'
    THEN 'gas' WHEN lower(room_id) LIKE '%kitchen%' THEN 'foam' WHEN lower(room_id) LIKE '%lab%'
    THEN 'foam' ELSE 'water' END AS agent, count(*) AS n FROM devices GROUP BY 1, 2""",
    "devices"))
def _(i):
    return i.devices.groupBy(
        "room_id", scalar.suppression_agent(F.col("room_id")).alias("agent")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("p9_suppression_trigger", with_inputs(
    """SELECT id AS request_id, device_id, zone_id, CASE WHEN lower(room_id) LIKE '%server%'
    OR lower(room_id) LIKE '%data%' THEN 'gas' WHEN lower(room_id) LIKE '%kitchen%'
    OR lower(room_id) LIKE '%lab%' THEN 'foam' ELSE 'water' END AS suppression_type,
    100 AS intensity, ts FROM raised WHERE upper(severity) = 'HIGH'
    AND upper(alarm_type) = 'FIRE'""", "raised"))
def _(i):
    return al.suppression_requests(i.raised)


@query("s7_severity_fan_out", with_inputs(
    """SELECT id, device_id, severity, ts, unnest(['all', lower(severity)]) AS topic FROM alarms""",
    "alarms"))
def _(i):
    return al.fan_out(i.alarms.select("id", "device_id", "severity", "ts"))


# --- alarms: history ---------------------------------------------------------------------------


@query("p4_alarm_window", with_inputs(f"SELECT * FROM alarms WHERE {IN_WINDOW}", "alarms"))
def _(i):
    return al.between(i.alarms, START, END)


@query("p12_by_severity", with_inputs(
    "SELECT * FROM alarms WHERE lower(severity) = lower('medium')", "alarms"))
def _(i):
    return al.of_severity(i.alarms, "medium")


@query("p12_by_type", with_inputs(
    "SELECT * FROM alarms WHERE lower(type) = lower('Fire')", "alarms"))
def _(i):
    return al.of_type(i.alarms, "Fire")


@query("t1_newest", with_inputs(
    "SELECT * FROM alarms ORDER BY ts DESC, id DESC LIMIT 10", "alarms"))
def _(i):
    return al.newest(i.alarms)


@query("t2_newest_of_device", with_inputs(
    f"SELECT * FROM alarms WHERE device_id = '{DEVICE}' ORDER BY ts DESC, id DESC LIMIT 10",
    "alarms"))
def _(i):
    return al.newest(al.of_device(i.alarms, DEVICE))


@query("t2_newest_of_severity", with_inputs(
    "SELECT * FROM alarms WHERE severity = 'HIGH' ORDER BY ts DESC, id DESC LIMIT 10", "alarms"))
def _(i):
    return al.newest(al.of_severity(i.alarms, "high"))


@query("t2_newest_per_device", with_inputs(
    """SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, id DESC)::INT
    AS position FROM alarms QUALIFY position <= 3""", "alarms"))
def _(i):
    return al.newest_per(i.alarms, "device_id", 3)


@query("t2_newest_per_type", with_inputs(
    """SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC)::INT
    AS position FROM alarms QUALIFY position <= 10""", "alarms"))
def _(i):
    return al.newest_per(i.alarms, "type", 10)


@query("w4_page", with_inputs(
    "SELECT * FROM alarms ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100", "alarms"))
def _(i):
    return al.page(i.alarms, 2, 50)


@query("w4_total", with_inputs("SELECT count(*) AS n FROM alarms", "alarms"))
def _(i):
    return i.alarms.agg(F.count(F.lit(1)).alias("n"))


@query("t3_time_page", with_inputs(
    f"""SELECT * FROM alarms WHERE epoch_us(ts)//1000 BETWEEN epoch_us({_START})//1000
    AND epoch_us({_START} + INTERVAL 1 HOUR)//1000 ORDER BY ts, id LIMIT 20""", "alarms"))
def _(i):
    return al.time_page(i.alarms, START, 20)


@query("t4_cursor_page", with_inputs(
    f"""SELECT * FROM alarms WHERE epoch_us(ts)//1000 < epoch_us({_END})//1000
    ORDER BY ts DESC, id DESC LIMIT 25""", "alarms"))
def _(i):
    return al.cursor_page(i.alarms, END, 25)


@query("t4_next_cursor", with_inputs(
    f"""SELECT make_timestamp((min(epoch_us(ts))//1000)*1000) AS cursor FROM (SELECT * FROM alarms
    WHERE epoch_us(ts)//1000 < epoch_us({_END})//1000 ORDER BY ts DESC, id DESC LIMIT 25)""",
    "alarms"))
def _(i):
    return ntz(al.next_cursor(al.cursor_page(i.alarms, END, 25)), "cursor")


@query("t5_newest_100_then_filter", with_inputs(
    """SELECT * FROM (SELECT * FROM alarms ORDER BY ts DESC, id DESC LIMIT 100)
    WHERE lower(severity) = 'high' ORDER BY ts DESC, id DESC LIMIT 10""", "alarms"))
def _(i):
    return al.newest_matching(i.alarms, scalar.same_text(F.col("severity"), "HIGH"))


@query("t6_snapshot_cap", with_inputs(
    f"SELECT * FROM alarms WHERE {IN_WINDOW} ORDER BY ts, id LIMIT 1000", "alarms"))
def _(i):
    return al.snapshot_rows(i.alarms, START, END)


@query("t7_recent_list", with_inputs(
    """SELECT * FROM (SELECT * FROM alarms ORDER BY ts DESC, id DESC LIMIT 100)
    WHERE severity = 'MEDIUM'""", "alarms"))
def _(i):
    return sy.client_list(i.alarms, "MEDIUM")


@query("t8_time_bounds", with_inputs(
    "SELECT min(ts) AS oldest, max(ts) AS newest FROM alarms", "alarms"))
def _(i):
    return al.time_bounds(i.alarms)


@query("w7_buffer", with_inputs(
    "SELECT * FROM alarms ORDER BY ts DESC, id DESC LIMIT 1000", "alarms"))
def _(i):
    return al.buffered(i.alarms)


@query("u1_unique_events", with_inputs(
    "SELECT DISTINCT * FROM (SELECT * FROM alarms UNION ALL SELECT * FROM alarms)", "alarms"))
def _(i):
    return al.unique_alarms(i.alarms.union(i.alarms))


@query("s12_retention", with_inputs(
    f"""SELECT count(*) FILTER (WHERE epoch_us(ts)//1000 <= c) AS removed,
    count(*) FILTER (WHERE epoch_us(ts)//1000 > c) AS remaining
    FROM alarms, (SELECT epoch_us(TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY)//1000 AS c)""",
    "alarms"))
def _(i):
    return al.retention_report(i.alarms, "2024-02-10T00:00:00Z")


@query("s12_retained_rows", with_inputs(
    """SELECT * FROM alarms WHERE epoch_us(ts)//1000 >
    epoch_us(TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY)//1000""", "alarms"))
def _(i):
    return al.split_retention(i.alarms, "2024-02-10T00:00:00Z")[1]


# --- alarms: counts -----------------------------------------------------------------------------


@query("a3_count_window", with_inputs(
    f"SELECT count(*) AS n FROM alarms WHERE {IN_WINDOW}", "alarms"))
def _(i):
    return al.count_in_window(i.alarms, START, END)


for _key in ("device_id", "severity", "type"):

    @query(f"a3_count_by_{_key}", with_inputs(
        f"SELECT {_key}, count(*) AS n FROM alarms GROUP BY 1", "alarms"))
    def _(i, key=_key):
        return al.counts_by(i.alarms, key)


@query("a4_stats_summary", with_inputs(
    """SELECT count(*) AS total,
    count(*) FILTER (WHERE lower(severity) = 'high') AS severity_high,
    count(*) FILTER (WHERE lower(severity) = 'medium') AS severity_medium,
    count(*) FILTER (WHERE lower(severity) = 'low') AS severity_low,
    count(*) FILTER (WHERE lower(type) = 'fire') AS type_fire,
    count(*) FILTER (WHERE lower(type) = 'smoke') AS type_smoke,
    count(*) FILTER (WHERE lower(type) = 'gas') AS type_gas,
    min(ts) AS oldest, max(ts) AS newest,
    epoch_us(max(ts))//1000000 - epoch_us(min(ts))//1000000 AS range_seconds FROM alarms""",
    "alarms"))
def _(i):
    return al.stats_summary(i.alarms)


@query("a5_recent_stats", with_inputs(
    """SELECT severity, type, (grouping(severity) * 2 + grouping(type))::INT AS level,
    count(*) AS n FROM (SELECT * FROM alarms ORDER BY ts DESC, id DESC LIMIT 1000)
    GROUP BY GROUPING SETS ((severity), (type), ())""", "alarms"))
def _(i):
    return al.recent_stats(i.alarms)


@query("j7_active_alarms", with_inputs(
    """SELECT a.* EXCLUDE (acknowledged), k.ts IS NOT NULL AS acknowledged,
    k.ts AS acknowledged_at, k.actor AS acknowledged_by
    FROM (SELECT id, device_id, type, severity, ts, false AS acknowledged FROM alarms) a
    LEFT JOIN (SELECT alarm_id, max(ts) AS ts, max_by(actor, ts) AS actor FROM actions
      WHERE action = 'ACK' GROUP BY 1) k ON a.id = k.alarm_id
    WHERE a.id NOT IN (SELECT alarm_id FROM actions WHERE action = 'RESOLVE')""",
    "alarms", "actions"))
def _(i):
    return al.active_alarms(
        i.alarms.select("id", "device_id", "type", "severity", "ts"), i.actions
    )


# --- devices -------------------------------------------------------------------------------------


@query("p11_device_by_id", with_inputs(
    f"SELECT * FROM devices WHERE device_id = '{DEVICE}'", "devices"))
def _(i):
    return dv.by_id(i.devices, DEVICE)


@query("p11_devices", with_inputs("SELECT * FROM devices", "devices"))
def _(i):
    return i.devices


@query("p11_devices_on_floor", with_inputs(
    "SELECT * FROM devices WHERE floor_id = 'floor-2'", "devices"))
def _(i):
    return dv.on_floor(i.devices, "floor-2")


@query("p11_devices_in_zone", with_inputs(
    "SELECT * FROM devices WHERE zone_id = 'floor-1-east'", "devices"))
def _(i):
    return dv.in_zone(i.devices, "floor-1-east")


@query("p11_usable_devices", with_inputs(
    "SELECT * FROM devices WHERE active AND enabled", "devices"))
def _(i):
    return dv.active(dv.enabled(i.devices))


@query("p13_device_upsert", with_inputs(
    """SELECT device_id, active, enabled, ts AS last_updated FROM device_changes QUALIFY
    row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) = 1""",
    "device_changes"))
def _(i):
    return dv.current_devices(i.device_changes)


@query("j2_known_devices", with_inputs(
    "SELECT * FROM sensor_data SEMI JOIN registry USING (device_id)", "sensor_data", "registry"))
def _(i):
    return dv.known(i.sensor_data, i.registry)


@query("j2_unknown_devices", with_inputs(
    "SELECT * FROM sensor_data ANTI JOIN registry USING (device_id)", "sensor_data", "registry"))
def _(i):
    return dv.unknown(i.sensor_data, i.registry)


@query("j2_filter_rate", with_inputs(
    """SELECT count(*) AS lookups, count(*) FILTER (WHERE r.device_id IS NULL) AS filtered,
    round(count(*) FILTER (WHERE r.device_id IS NULL) * 100.0::DOUBLE / count(*), 6) AS filter_rate
    FROM sensor_data s LEFT JOIN registry r USING (device_id)""", "sensor_data", "registry"))
def _(i):
    return rounded(dv.registry_filter_rate(i.sensor_data, i.registry), "filter_rate")


@query("j3_enabled_gate", with_inputs(
    """SELECT * FROM sensor_data SEMI JOIN (SELECT device_id FROM registry WHERE enabled) r
    USING (device_id)""", "sensor_data", "registry"))
def _(i):
    return dv.gate(i.sensor_data, i.registry)


_RANK = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


@query("j4_status_board", with_inputs(
    f"""SELECT device_id, active, coalesce(r, 0)::INT AS alarm_rank,
    CASE coalesce(r, 0) WHEN 3 THEN 'alarm_high' WHEN 2 THEN 'alarm_medium'
    WHEN 1 THEN 'alarm_low' ELSE CASE WHEN active THEN 'active' ELSE 'inactive' END END AS status
    FROM devices LEFT JOIN (SELECT device_id, max({_RANK}) AS r FROM alarms GROUP BY 1)
    USING (device_id)""", "devices", "alarms"))
def _(i):
    return dv.status_board(i.devices, i.alarms)


_INTERVALS = f"""marked AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w
    >= {HOURS_6 * 1_000_000}, true)::INT AS opens FROM heartbeats
    WINDOW w AS (PARTITION BY device_id ORDER BY ts)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY device_id ORDER BY ts) AS k FROM marked)"""


@query("w5_online_intervals", with_inputs(
    f"""SELECT device_id, min(ts) AS online_at, max(ts) AS last_heartbeat,
    max(ts) + INTERVAL {HOURS_6} SECOND AS offline_at, count(*) AS heartbeats
    FROM numbered GROUP BY device_id, k""", "heartbeats", extra=_INTERVALS))
def _(i):
    return dv.online_intervals(i.heartbeats, HOURS_6)


_LIVE = f"""SELECT device_id, max(ts) AS last_heartbeat,
    max(ts) > {_NOW} - INTERVAL {HOURS_6} SECOND AS connected
    FROM heartbeats WHERE ts <= {_NOW} GROUP BY 1"""


@query("w5_liveness_at", with_inputs(_LIVE, "heartbeats"))
def _(i):
    return dv.liveness_at(i.heartbeats, NOW, HOURS_6)


@query("a17_connected_count", with_inputs(
    f"SELECT count(*) FILTER (WHERE connected) AS connected_devices FROM ({_LIVE})",
    "heartbeats"))
def _(i):
    return dv.connected_count(dv.liveness_at(i.heartbeats, NOW, HOURS_6))


@query("a19_last_connection", with_inputs(
    """SELECT device_id, max(ts) AS last_connected, arg_max(enabled, (ts, seq)) AS connected
    FROM device_changes GROUP BY 1""", "device_changes"))
def _(i):
    return dv.last_connection(i.device_changes.withColumnRenamed("enabled", "connected"))


# --- suppression ----------------------------------------------------------------------------------

_DECISIONS = f"""eligible AS (SELECT * FROM suppression_requests SEMI JOIN
      (SELECT device_id FROM suppression_devices WHERE enabled AND connected) USING (device_id)),
    {_chain('starts', 'eligible', 'device_id', str(DAYS_5))},
    decisions AS (SELECT e.*, s.ts AS activated_at,
      CASE WHEN e.ts = s.ts THEN 'activated' WHEN e.suppression_type = o.suppression_type
      THEN 'updated' ELSE 'rejected' END AS outcome
      FROM eligible e ASOF JOIN starts s ON e.device_id = s.k AND e.ts >= s.ts
      JOIN eligible o ON o.device_id = s.k AND o.ts = s.ts),
    acts AS (SELECT * FROM decisions WHERE outcome = 'activated')"""


def _decisions(i: Inputs) -> DataFrame:
    requests = sp.eligible(i.suppression_requests, i.suppression_devices)
    slices = hot_slices(i.suppression_requests, ["device_id"], "ts")
    return sp.decide(requests, DAYS_5, slices)


def _suppression(body: str) -> str:
    return with_inputs(body, "suppression_requests", "suppression_devices", recursive=True,
                       extra=_DECISIONS)


@query("w8_suppression", _suppression("SELECT * FROM decisions"))
def _(i):
    return _decisions(i)


@query("w8_suppression_sliced", _suppression("SELECT * FROM decisions"))
def _(i):
    # The same result through time slices for every device above two requests.
    requests = sp.eligible(i.suppression_requests, i.suppression_devices)
    slices = hot_slices(requests, ["device_id"], "ts", target_rows=2, slot_seconds=3600)
    return sp.decide(requests, DAYS_5, slices)


@query("w6_activation_history", _suppression(
    """SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, request_id DESC)::INT
    AS position FROM acts QUALIFY position <= 100"""))
def _(i):
    return sp.history(_decisions(i))


_COUNTERS = """SELECT device_id, count(*) AS total_activations,
    count(*) FILTER (WHERE suppression_type = 'water') AS water_activations,
    count(*) FILTER (WHERE suppression_type = 'foam') AS foam_activations,
    count(*) FILTER (WHERE suppression_type = 'gas') AS gas_activations,
    max(ts) AS last_activation FROM acts {where} GROUP BY 1"""


@query("a9_suppression_counters", _suppression(_COUNTERS.format(where="")))
def _(i):
    return sp.counters(_decisions(i))


@query("j8_full_status", _suppression(
    f"""SELECT d.*, c.suppression_type, c.suppression_zone_id, c.suppression_intensity,
    c.suppression_activated_at, c.suppression_last_updated,
    k.total_activations AS counter_total_activations,
    k.water_activations AS counter_water_activations,
    k.foam_activations AS counter_foam_activations, k.gas_activations AS counter_gas_activations,
    k.last_activation AS counter_last_activation, h.details AS last_activation_details,
    c.suppression_type IS NOT NULL AS suppression_active
    FROM suppression_devices d
    LEFT JOIN (SELECT device_id,
      max(suppression_type) FILTER (WHERE outcome = 'activated') AS suppression_type,
      max(zone_id) FILTER (WHERE outcome = 'activated') AS suppression_zone_id,
      arg_max(intensity, ts) AS suppression_intensity,
      max(ts) FILTER (WHERE outcome = 'activated') AS suppression_activated_at,
      max(ts) AS suppression_last_updated
      FROM decisions WHERE outcome <> 'rejected' AND ts <= {_NOW}
      AND activated_at > {_NOW} - INTERVAL {DAYS_5} SECOND GROUP BY 1) c USING (device_id)
    LEFT JOIN ({_COUNTERS.format(where=f"WHERE ts <= {_NOW}")}) k USING (device_id)
    LEFT JOIN (SELECT device_id, arg_max('{{"timestamp":' || (epoch_us(ts)//1000) || ',"type":"'
      || suppression_type || '","zone":"' || zone_id || '","intensity":' || intensity || '}}', ts)
      AS details FROM acts WHERE ts <= {_NOW} GROUP BY 1) h USING (device_id)"""))
def _(i):
    return sp.full_status(i.suppression_devices, _decisions(i), NOW, DAYS_5)


# --- metrics ----------------------------------------------------------------------------------------


@query("a6_distinct_per_rule", with_inputs(
    "SELECT rule_id, count(DISTINCT id) AS n FROM new_alarms GROUP BY 1",
    "sensor_data", "rules", recursive=True, extra=_RAISED_EXTRA))
def _(i):
    return mt.distinct_events(_raised(i))


@query("a6_sketch_within_bound", with_inputs(
    """SELECT device_id AS rule_id, true AS close FROM sensor_data GROUP BY 1""", "sensor_data"))
def _(i):
    # The sketch may err by its published bound; the check is against the exact count.
    events = i.sensor_data.withColumnRenamed("device_id", "rule_id")
    sketched = mt.sketch_counts(mt.distinct_sketches(events)).withColumnRenamed("n", "estimate")
    off = F.abs(F.col("estimate") - F.col("n")) / F.col("n")
    return mt.distinct_events(events).join(sketched, "rule_id").select(
        "rule_id", (off <= 0.1).alias("close")
    )


@query("u2_sketch_union", with_inputs(
    "SELECT true AS close, count(*) AS n FROM sensor_data", "sensor_data"))
def _(i):
    events = i.sensor_data.withColumnRenamed("device_id", "rule_id")
    union = mt.sketch_union(mt.distinct_sketches(events)).select(F.col("n").alias("estimate"))
    exact = events.agg(F.count_distinct("id").alias("n"))
    both = exact.select("n", F.lit(0).cast("long").alias("estimate")).unionByName(
        union.select(F.lit(0).cast("long").alias("n"), "estimate")
    ).agg(F.sum("n").alias("n"), F.sum("estimate").alias("estimate"))
    off = F.abs(F.col("estimate") - F.col("n")) / F.col("n")
    return both.select((off <= 0.1).alias("close"), "n")


@query("a7_dedup_rate", with_inputs(
    f"""SELECT accepted, live_keys, total,
    round((accepted - live_keys) * 100.0::DOUBLE / accepted, 6) AS reference_rate,
    round((total - accepted) * 100.0::DOUBLE / total, 6) AS drop_rate FROM (
    SELECT (SELECT count(*) FROM kept WHERE ts <= {_NOW}) AS accepted,
    (SELECT count(DISTINCT k) FROM kept WHERE ts <= {_NOW}
      AND ts > {_NOW} - INTERVAL {DAY} SECOND) AS live_keys,
    (SELECT count(*) FROM sensor_data WHERE ts <= {_NOW}) AS total)""",
    "sensor_data", recursive=True, extra=_chain("kept", "sensor_data", _USER_TYPE, str(DAY))))
def _(i):
    keys = ["device_id", "sensor_type"]
    data = i.sensor_data.select("id", *keys, "ts")
    accepted = rl.deduplicated(data, DAY, hot_slices(data, keys, "ts"), keys)
    return rounded(
        mt.dedup_rates(data, accepted, keys, NOW, DAY), "reference_rate", "drop_rate"
    )


@query("a8_counters", with_inputs(
    """SELECT c.device_id, c.counter_name,
    (coalesce(max(base), 0) + coalesce(sum(amount) FILTER (WHERE op = 'INC'
      AND (last_set IS NULL OR seq > last_set)), 0))::BIGINT AS value FROM counter_ops c
    LEFT JOIN (SELECT device_id, counter_name, max(seq) AS last_set, arg_max(amount, seq) AS base
      FROM counter_ops WHERE op = 'SET' GROUP BY 1, 2) s USING (device_id, counter_name)
    GROUP BY 1, 2""", "counter_ops"))
def _(i):
    return mt.counter_values(i.counter_ops)


def _rounded_probs(value: str) -> str:
    return ", ".join(
        f"round(quantile_cont({value}, {p}), 6) AS {n}"
        for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))
    )


@query("a10_latency_percentiles", with_inputs(
    f"""SELECT severity, type, {_rounded_probs('latency_ms')} FROM latencies GROUP BY 1, 2""",
    "latencies"))
def _(i):
    out = percentiles.exact(i.latencies, ["severity", "type"], "latency_ms", mt.LATENCY_PROBS)
    return rounded(out, "p50", "p95", "p99")


@query("a10_latency_sketch_within_bound", with_inputs(
    "SELECT severity, type, true AS close FROM latencies GROUP BY 1, 2", "latencies"))
def _(i):
    # The share of rows below each estimate must match its probability to 1 / ACCURACY,
    # give or take one row.
    keys = ["severity", "type"]
    near = mt.latency_percentiles(i.latencies, keys)
    placed = i.latencies.join(near, keys)
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    shares = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("latency_ms") < F.col(c)).alias(f"{c}_below") for c in names],
        *[F.count_if(F.col("latency_ms") <= F.col(c)).alias(f"{c}_upto") for c in names],
    )
    slack = F.col("n") / percentiles.ACCURACY + 1
    fits = [
        (F.col(f"{c}_below") <= p * F.col("n") + slack)
        & (F.col(f"{c}_upto") >= p * F.col("n") - slack)
        for c, p in names.items()
    ]
    return shares.select(*keys, (fits[0] & fits[1] & fits[2]).alias("close"))


@query("a11_event_rate", with_inputs(
    """SELECT severity, overall, make_timestamp((step + k) * 60000000) AS window_end,
    sum(n)::BIGINT AS n, round(sum(n) / 300.0::DOUBLE, 6) AS per_second FROM (
      SELECT severity, false AS overall, epoch_us(ts) // 60000000 AS step, count(*) AS n
      FROM alarms GROUP BY 1, 3
      UNION ALL SELECT NULL, true, epoch_us(ts) // 60000000, count(*) FROM alarms GROUP BY 3)
    CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1, 2, 3""", "alarms"))
def _(i):
    return rounded(ntz(mt.event_rates(i.alarms, "severity"), "window_end"), "per_second")


@query("a12_counter_rate", with_inputs(
    """SELECT series, sum(grown) AS increase, round((max(us) - min(us)) / 1e6, 6) AS span_seconds,
    round(sum(grown) / ((max(us) - min(us)) / 1e6), 6) AS per_second FROM (
      SELECT series, epoch_us(ts) AS us, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value
      ELSE value - p END AS grown FROM (SELECT *, lag(value) OVER (PARTITION BY series
      ORDER BY ts, value) AS p FROM counter_samples)) GROUP BY 1""", "counter_samples"))
def _(i):
    samples = i.counter_samples
    slices = hot_slices(samples, ["series"], "ts", target_rows=500, slot_seconds=3600)
    return rounded(mt.counter_rates(samples, slices), "span_seconds", "per_second")


BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("a12_windowed_rate", with_inputs(
    """SELECT series, make_timestamp((step + k) * 60000000) AS window_end, sum(grown) AS increase,
    round(sum(grown) / 300.0::DOUBLE, 6) AS per_second FROM (
      SELECT series, epoch_us(ts) // 60000000 AS step, sum(CASE WHEN p IS NULL THEN 0 WHEN value < p
      THEN value ELSE value - p END) AS grown FROM (SELECT *, lag(value) OVER (PARTITION BY series
      ORDER BY ts, value) AS p FROM counter_samples) GROUP BY 1, 2)
    CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1, 2""", "counter_samples"))
def _(i):
    return rounded(ntz(mt.windowed_counter_rates(i.counter_samples), "window_end"), "per_second")


@query("a13_histogram_quantile", """WITH edges AS (SELECT unnest(
      [5, 10, 25, 50, 100, 250, 'inf'::DOUBLE]) AS le),
    counted AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS c
      FROM events, edges GROUP BY 1, 2),
    shaped AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below,
      max(c) OVER (PARTITION BY event_type) AS total FROM counted
      WINDOW w AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, prob, round(CASE WHEN le = 'inf'::DOUBLE THEN lo
      ELSE lo + (le - lo) * (prob * total - below) / (c - below) END, 6) AS quantile
    FROM shaped, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS prob)
    WHERE c >= prob * total AND below < prob * total""")
def _(i):
    buckets = mt.histogram(i.table("events"), "event_type", "value", BOUNDS)
    return rounded(mt.histogram_quantiles(buckets, "event_type", (0.5, 0.95)), "quantile")


@query("a14_distribution_counts", with_inputs(
    """SELECT device_id, severity, type, (grouping(device_id) = 1) AS per_severity, count(*) AS n
    FROM alarms GROUP BY GROUPING SETS ((severity), (device_id, severity, type))""", "alarms"))
def _(i):
    return mt.distribution_counts(i.alarms)


@query("a14_failures_by_reason", with_inputs(
    """SELECT outcome AS reason, count(*) AS n FROM operations WHERE outcome <> 'success'
    GROUP BY 1""", "operations"))
def _(i):
    reason = F.nullif(F.col("outcome"), F.lit("success"))
    return mt.failure_counts(i.operations.withColumn("reason", reason))


@query("a15_flow_health", with_inputs(
    """SELECT count(*) AS total, count(*) FILTER (WHERE value <= 200) AS succeeded,
    count(DISTINCT date_trunc('hour', ts)) AS batches,
    count(*) FILTER (WHERE severity = 'HIGH') AS severity_high,
    count(*) FILTER (WHERE severity = 'MEDIUM') AS severity_medium,
    count(*) FILTER (WHERE severity = 'LOW') AS severity_low,
    count(*) FILTER (WHERE value <= 120) AS active,
    round(count(*) FILTER (WHERE value <= 200) * 100.0::DOUBLE / count(*), 6) AS success_rate,
    round(count(*)::DOUBLE / count(DISTINCT date_trunc('hour', ts)), 6) AS average_batch
    FROM alarms""", "alarms"))
def _(i):
    rows = i.alarms.withColumn("batch", F.date_trunc("hour", "ts"))
    health = mt.flow_health(
        rows, F.col("value") <= 200, "batch", "severity", F.col("value") > 120
    )
    return rounded(health, "success_rate", "average_batch")


@query("a18_sync_statistics", with_inputs(
    """SELECT count(*) FILTER (WHERE kind = 'push') AS pushes,
    count(*) FILTER (WHERE kind = 'pull') AS pulls,
    count(*) FILTER (WHERE kind = 'snapshot') AS snapshots,
    count(DISTINCT client_id) FILTER (WHERE kind = 'snapshot') AS active_clients,
    max(ts) FILTER (WHERE kind = 'push') AS last_update FROM sync_log""", "sync_log"))
def _(i):
    return mt.sync_statistics(i.sync_log)


@query("a20_operation_counts", with_inputs(
    "SELECT operation, outcome, count(*) AS n FROM operations GROUP BY 1, 2", "operations"))
def _(i):
    return mt.operation_counts(i.operations)


@query("a20_operation_latency", with_inputs(
    f"SELECT operation, {_rounded_probs('latency_ms')} FROM operations GROUP BY 1",
    "operations"))
def _(i):
    # Groups above 200 rows take the bracketing path for large groups.
    out = percentiles.exact(
        i.operations, ["operation"], "latency_ms", mt.LATENCY_PROBS, target_rows=200
    )
    return rounded(out, "p50", "p95", "p99")


# --- synchronisation ---------------------------------------------------------------------------------

CLIENT = "c7"
_MARKER = f"(SELECT max(ts) FROM sync_log WHERE kind = 'snapshot' AND client_id = '{CLIENT}' AND ts <= {_START})"
_SINCE = f"""epoch_us(ts)//1000 BETWEEN epoch_us({_MARKER})//1000 AND epoch_us({_NOW})//1000"""


def _marker(i: Inputs):
    log = i.sync_log.where(F.col("ts") <= instant(START))
    return sy.marker_of(sy.sync_markers(log), CLIENT)


@query("r8_snapshot", with_inputs(
    f"SELECT * FROM alarms WHERE {_SINCE} ORDER BY ts, id LIMIT 1000", "alarms", "sync_log"))
def _(i):
    return sy.snapshot(i.alarms, NOW, _marker(i))


@query("r8_reused_snapshot", with_inputs(
    """SELECT * FROM alarms WHERE epoch_us(ts)//1000
    BETWEEN epoch_us((SELECT asked FROM given) - INTERVAL 1 HOUR)//1000
    AND epoch_us((SELECT asked FROM given))//1000 ORDER BY ts, id LIMIT 1000""", "alarms", "sync_log",
    extra="""given AS (SELECT max(ts) AS asked FROM sync_log WHERE client_id = 'c7'
      AND kind = 'snapshot')"""))
def _(i):
    # asked again two minutes after the client's last snapshot
    given = sy.marker_of(sy.sync_markers(i.sync_log), "c7")
    return sy.client_snapshot(i.alarms, i.sync_log, "c7", given + timedelta(minutes=2))


@query("r8_delta", with_inputs(
    f"SELECT * FROM alarms WHERE {_SINCE}", "alarms", "sync_log"))
def _(i):
    return sy.delta(i.alarms, NOW, _marker(i))


@query("r8_sync_markers", with_inputs(
    """SELECT client_id, max(ts) AS last_snapshot FROM sync_log WHERE kind = 'snapshot'
    GROUP BY 1""", "sync_log"))
def _(i):
    return sy.sync_markers(i.sync_log)


@query("r9_periodic_snapshot", with_inputs(
    f"""SELECT *, 'periodic-snapshot' AS kind FROM alarms WHERE epoch_us(ts)//1000
    BETWEEN epoch_us({_NOW} - INTERVAL 1 HOUR)//1000 AND epoch_us({_NOW})//1000
    ORDER BY ts, id LIMIT 1000""", "alarms"))
def _(i):
    return sy.periodic_snapshot(i.alarms, NOW)


@query("j9_delta_merge", with_inputs(
    f"""SELECT id, device_id, type, CASE WHEN {IN_WINDOW} THEN 'LOW' ELSE severity END AS severity,
    value, ts FROM alarms""", "alarms"))
def _(i):
    incoming = al.in_window(i.alarms, START, END).withColumn("severity", F.lit("LOW"))
    return sy.merge_by_id(i.alarms, incoming)


# --- functions ----------------------------------------------------------------------------------------


@query("f1_decode_ids", with_inputs(
    """SELECT event_id, make_timestamp(((id >> 23) + 1672531200000) * 1000) AS ts,
    ((id >> 13) & 1023)::INT AS machine, ((id >> 8) & 31)::INT AS kind, (id & 255)::INT AS sequence
    FROM packed_ids""", "packed_ids"))
def _(i):
    packed = F.col("id")
    return ntz(i.packed_ids.select(
        "event_id",
        F.timestamp_millis(scalar.id_millis(packed)).alias("ts"),
        scalar.id_machine(packed).alias("machine"),
        scalar.id_kind(packed).alias("kind"),
        scalar.id_sequence(packed).alias("sequence"),
    ), "ts")


@query("f2_encode_ids", """SELECT event_id, ((epoch_us(ts)//1000 - 1672531200000) << 23)
    | ((user_id % 1024) << 13) | (1 << 8) | (row_number() OVER (PARTITION BY epoch_us(ts)//1000,
    user_id % 1024 ORDER BY event_id) - 1) AS id FROM events""")
def _(i):
    numbered = ids.assign_ids(
        i.table("events"), "ts", F.col("user_id") % 1024, F.lit(1), ["event_id"]
    )
    return numbered.select("event_id", "id")


@query("f4_case_folding", with_inputs(
    """SELECT lower(type) AS type, upper(severity) AS severity,
    lower(type) = lower('FIRE') AS fire, count(*) AS n FROM alarms GROUP BY 1, 2, 3""", "alarms"))
def _(i):
    kind = F.col("type")
    return i.alarms.groupBy(
        F.lower(kind).alias("type"), F.upper("severity").alias("severity"),
        scalar.same_text(kind, "FIRE").alias("fire"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("f7_severity_rank", with_inputs(
    f"SELECT severity, {_RANK} AS rank, count(*) AS n FROM rules GROUP BY 1, 2", "rules"))
def _(i):
    return i.rules.groupBy(
        "severity", scalar.severity_rank(F.col("severity")).alias("rank")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("f8_epochs", """SELECT event_id, epoch_us(ts)//1000 AS ms, epoch_us(ts)//1000000 AS s,
    make_timestamp((epoch_us(ts)//1000)*1000) AS back,
    abs(value - 50) AS distance FROM events""")
def _(i):
    ms = scalar.millis(F.col("ts"))
    return ntz(i.table("events").select(
        "event_id",
        ms.alias("ms"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"),
        F.timestamp_millis(ms).alias("back"),
        F.abs(F.col("value") - 50).alias("distance"),
    ), "back")


@query("f9_json_round_trip", with_inputs(
    "SELECT id, device_id, severity, value FROM alarms", "alarms"))
def _(i):
    picked = i.alarms.select("id", "device_id", "severity", "value")
    return scalar.from_document(scalar.to_document(picked), "value", picked.schema)


@query("f10_alarm_text", with_inputs(
    """SELECT a.id, CASE a.type WHEN 'SMOKE_DETECTED' THEN 'Smoke detected by ' ELSE 'Alarm '
    || a.type || ' triggered by ' END || d.name || ' in ' || d.zone_id AS message,
    d.floor_id || ' - ' || d.zone_id AS location FROM alarms a JOIN devices d USING (device_id)""",
    "alarms", "devices"))
def _(i):
    where = i.devices.select("device_id", "name", "floor_id", "zone_id")
    return i.alarms.select("id", "device_id", "type").join(where, "device_id").select(
        "id",
        scalar.alarm_text(F.col("type"), F.col("name"), F.col("zone_id")).alias("message"),
        scalar.location_text(F.col("floor_id"), F.col("zone_id")).alias("location"),
    )


@query("f11_composite_keys", with_inputs(
    """SELECT id, concat_ws(':', rule_id, device_id, sensor_type) AS key, rule_id AS head
    FROM matches""", "sensor_data", "rules", extra=_MATCHES))
def _(i):
    parts = [F.col(c) for c in ("rule_id", "device_id", "sensor_type")]
    keyed = _matches(i).select("id", scalar.composite_key(*parts).alias("key"))
    return keyed.withColumn("head", scalar.key_head(F.col("key")))


@query("f13_metadata_json", """SELECT event_id, props AS metadata,
    (props::JSON->>'$.k')::BIGINT AS k FROM events""")
def _(i):
    return i.table("events").select(
        "event_id",
        scalar.json_or_null(F.col("props")).alias("metadata"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


# --- streams ---------------------------------------------------------------------------------------------
#
# The events table is read as a stream and run to its end; the result is what
# the stream wrote. Event times are instants there, so they are cast on both ways.


def _live(i: Inputs) -> StreamedInputs:
    return StreamedInputs(i.spark, i.folder)


def _finished(stream: DataFrame) -> DataFrame:
    """Run a stream over all available input and read back its output."""
    folder = scratch(stream.sparkSession, "stream")
    writer = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    )
    # a stream fixes its state partitions at the first start; these tables need few
    name = "spark.sql.shuffle.partitions"
    configured = stream.sparkSession.conf.get(name)
    stream.sparkSession.conf.set(name, str(min(int(configured), 16)))
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        stream.sparkSession.conf.set(name, configured)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _stored(i: Inputs, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Store all rows in two micro-batches and once more after a restart; what is stored in the end."""
    folder = scratch(i.spark, "store")
    sink = StoreSink(folder, keys)
    for batch in (0, 1):
        sink(rows, batch)
    StoreSink(folder, keys)(rows, 1)
    return i.spark.read.parquet(folder).drop("day")


@query("s5_store_readings", with_inputs(
    "SELECT id, device_id, sensor_type, value, ts FROM sensor_data", "sensor_data"))
def _(i):
    return _stored(i, i.sensor_data.select("id", "device_id", "sensor_type", "value", "ts"), ("id",))


@query("s8_history_store", with_inputs(
    "SELECT id, device_id, type, severity, value, ts FROM alarms", "alarms"))
def _(i):
    return _stored(i, i.alarms.select("id", "device_id", "type", "severity", "value", "ts"), ("id", "ts"))


@query("r1_stream_alarms", with_inputs(
    """SELECT topic, id::VARCHAR AS id, rule_id, device_id,
    CASE WHEN severity IN ('HIGH', 'MEDIUM', 'LOW') THEN severity ELSE 'HIGH' END AS severity, ts
    FROM (SELECT *, unnest(['all', lower(CASE WHEN severity IN ('HIGH', 'MEDIUM', 'LOW')
      THEN severity ELSE 'HIGH' END)]) AS topic FROM new_alarms)""",
    "sensor_data", "rules", recursive=True, extra=_RAISED_EXTRA))
def _(i):
    folder = scratch(i.spark, "alarms")
    sink = flows.AlarmSink(folder, lambda: i.rules, dedup_seconds=DAY)
    run = flows.alarm_flow(_live(i).sensor_data, sink, f"{folder}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    topics = i.spark.read.parquet(f"{folder}/topics")
    return ntz(topics.select("topic", "id", "rule_id", "device_id", "severity", "ts"), "ts")


@query("r2_stream_change_filter", with_inputs(
    """SELECT v.message_id, v.device_id, v.ts, v.pos::INT AS pos, v.sensor_type, v.value
    FROM valid v SEMI JOIN (SELECT message_id FROM judged WHERE NOT trivial) k
    USING (message_id)""", "wide_messages", extra=_FLAT.format(messages="wide_messages")))
def _(i):
    kept = _finished(flows.change_filter_stream(_live(i).wide_messages))
    return ntz(kept.where("status = 'accepted'").drop("status"), "ts")


@query("r3_stream_dedup", _DEDUP_SQL)
def _(i):
    data = _live(i).sensor_data.select("id", "device_id", "sensor_type", "ts")
    kept = _finished(flows.dedup_stream(data, ["device_id", "sensor_type"], DAY))
    return ntz(kept.where("status = 'accepted'").drop("status"), "ts")


@query("r4_stream_liveness", with_inputs(
    f"""SELECT device_id, 'connected' AS event, online_at AS at FROM spans
    UNION ALL SELECT device_id, 'disconnected', offline_at FROM spans
    WHERE NOT newest OR offline_at <= (SELECT max(ts) FROM heartbeats) - INTERVAL 10 MINUTE""",
    "heartbeats", extra=_INTERVALS + f""", spans AS (SELECT device_id, min(ts) AS online_at,
      max(ts) + INTERVAL {HOURS_6} SECOND AS offline_at,
      k = max(k) OVER (PARTITION BY device_id) AS newest FROM numbered GROUP BY device_id, k)"""))
def _(i):
    # A device's last interval closes once the watermark (10 minutes behind) has passed its end.
    return ntz(_finished(flows.liveness_stream(_live(i).heartbeats, HOURS_6)), "at")


@query("r5_stream_buckets", with_inputs(
    """SELECT device_id, sensor_type, time_bucket(INTERVAL 5 HOUR, ts) AS bucket,
    round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value,
    count(*) AS n FROM sensor_data GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL 5 HOUR, ts)
    + INTERVAL 5 HOUR <= (SELECT max(ts) FROM sensor_data) - INTERVAL 10 MINUTE""",
    "sensor_data"))
def _(i):
    # Buckets are written once the watermark (10 minutes behind) has passed their end.
    out = _finished(flows.bucket_stream(_live(i).sensor_data, "5 hours"))
    return rounded(ntz(out, "bucket"), "avg_value")


@query("r6_stream_suppression", with_inputs(
    """SELECT request_id, device_id, zone_id, suppression_type, intensity, ts, activated_at,
    outcome FROM decisions""", "suppression_requests", "suppression_devices", recursive=True,
    extra=_DECISIONS))
def _(i):
    requests = sp.eligible(_live(i).suppression_requests, i.suppression_devices)
    return ntz(_finished(flows.suppression_stream(requests, DAYS_5)), "ts", "activated_at")


@query("r7_stream_alarm_life", with_inputs(
    """SELECT a.id AS alarm_id, a.device_id, a.severity, c.action, c.actor, c.ts FROM raised a
    JOIN (SELECT id AS alarm_id, 'RAISE' AS action, NULL AS actor, ts FROM raised
      UNION ALL SELECT alarm_id, action, actor, ts FROM actions) c ON a.id = c.alarm_id""",
    "raised", "actions"))
def _(i):
    live = _live(i)
    return ntz(_finished(flows.alarm_life_stream(live.raised, live.actions)), "ts")
