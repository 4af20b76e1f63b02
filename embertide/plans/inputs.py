"""The library's input tables derived from the driver tables.

Every table is a per-row expression over a whole driver table (plus a join to
the device table where named), so its size follows the data. ``INPUT_SQL``
states the same tables for the oracle; the two must be changed together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embertide.functions.scalar import encode_id, millis, suppression_agent

# Fixed values shared by both sides.
SENSOR_OF_EVENT = {
    "click": ("temperature", "C"),
    "view": ("humidity", "%"),
    "error": ("smoke", "ppm"),
    "purchase": ("co", "ppm"),
    "signup": ("motion", "none"),
}
ALARM_OF_EVENT = {
    "error": "FIRE",
    "click": "SMOKE",
    "view": "GAS",
    "purchase": "SMOKE_DETECTED",
    "signup": "fire",
}
ROOM_OF_EVENT = {
    "error": "Server-1",
    "click": "Kitchen A",
    "view": "lab-2",
    "signup": "data-hall",
}
ROOM_OF_SEGMENT = {
    "AUTOMOBILE": "Server-1",
    "BUILDING": "data-hall",
    "FURNITURE": "Kitchen A",
    "MACHINERY": "lab-2",
}
SYNC_OF_EVENT = {"click": "push", "view": "pull"}


def _of(column: Column, table: dict, default=None) -> Column:
    case = None
    for key, value in table.items():
        case = F.when(column == key, value) if case is None else case.when(column == key, value)
    return case if default is None else case.otherwise(default)


def _pick(number: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


class Inputs:
    """Lazily built input tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def sensor_data(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("device-"), F.col("user_id")).alias("device_id"),
            _of(kind, {k: v[0] for k, v in SENSOR_OF_EVENT.items()}).alias("sensor_type"),
            "value",
            _of(kind, {k: v[1] for k, v in SENSOR_OF_EVENT.items()}).alias("unit"),
            "ts",
            F.col("props").alias("metadata"),
        )

    @property
    def messages(self) -> DataFrame:
        """One reading per message."""
        return self.sensor_data.select(
            F.col("id").alias("message_id"),
            "device_id",
            "ts",
            F.lit("data").alias("type"),
            F.array(F.struct(F.col("sensor_type").alias("type"), "value")).alias("readings"),
        )

    @property
    def wide_messages(self) -> DataFrame:
        """Two readings per message: the event's own and a temperature."""
        return self.sensor_data.select(
            F.col("id").alias("message_id"),
            "device_id",
            "ts",
            F.lit("data").alias("type"),
            F.array(
                F.struct(F.col("sensor_type").alias("type"), F.col("value").alias("value")),
                F.struct(F.lit("temperature").alias("type"), (F.col("value") / 10).alias("value")),
            ).alias("readings"),
        )

    @property
    def devices(self) -> DataFrame:
        key = F.col("c_custkey")
        floor = F.col("c_nationkey") % 3 + 1
        return self.table("customer").select(
            F.concat(F.lit("device-"), key).alias("device_id"),
            F.col("c_name").alias("name"),
            _pick(key, "smoke", "temperature", "fire", "motion").alias("type"),
            (key % 40 - 20).cast("double").alias("location_x"),
            (floor * 5).cast("double").alias("location_y"),
            (key % 30 - 15).cast("double").alias("location_z"),
            (F.col("c_acctbal") > 0).alias("active"),
            (F.col("c_mktsegment") != "HOUSEHOLD").alias("enabled"),
            F.concat(F.lit("floor-"), floor).alias("floor_id"),
            F.concat(
                F.lit("floor-"), floor, F.lit("-"),
                _pick(key, "north", "south", "east", "west", "central"),
            ).alias("zone_id"),
            _of(F.col("c_mktsegment"), ROOM_OF_SEGMENT).alias("room_id"),
        )

    @property
    def registry(self) -> DataFrame:
        """Devices outside one room; those inside are unknown to the gate. Some are disabled."""
        return self.devices.where(~F.col("room_id").eqNullSafe("Kitchen A"))

    @property
    def device_changes(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.concat(F.lit("device-"), F.col("o_custkey")).alias("device_id"),
            (status != "F").alias("active"),
            (status != "P").alias("enabled"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_orderkey").alias("seq"),
        )

    @property
    def rules(self) -> DataFrame:
        key = F.col("c_custkey")
        floor = F.col("c_nationkey") % 3 + 1
        return self.table("customer").select(
            F.concat(F.lit("rule-"), key).alias("rule_id"),
            F.concat(F.lit("Rule for "), F.col("c_name")).alias("name"),
            F.concat(F.lit("device-"), key).alias("device_id"),
            _pick(key, "temperature", "humidity", "smoke", "co").alias("sensor_type"),
            _pick(F.floor(key / 4), ">", ">=", "<", "<=", "==", "!=").alias("operator"),
            (key % 5 * 25 + 20).cast("double").alias("threshold"),
            F.element_at(
                F.array(F.lit(0), F.lit(86400), F.lit(172800)),
                (F.floor(key / 24) % 3 + 1).cast("int"),
            ).alias("time_window_seconds"),
            _pick(F.floor(key / 2), "HIGH", "MEDIUM", "LOW", "critical").alias("severity"),
            _pick(key, "FIRE", "SMOKE", "GAS").alias("alarm_type"),
            F.lit("building-1").alias("building_id"),
            F.concat(F.lit("floor-"), floor).alias("floor_id"),
            _of(F.col("c_mktsegment"), ROOM_OF_SEGMENT).alias("room_id"),
            F.concat(
                F.lit("floor-"), floor, F.lit("-"),
                _pick(key, "north", "south", "east", "west", "central"),
            ).alias("zone_id"),
            (key % 10 != 0).alias("enabled"),
            F.lit("{}").alias("metadata"),
        )

    @property
    def rule_log(self) -> DataFrame:
        return self.table("orders").select(
            F.concat(F.lit("rule-"), F.col("o_custkey")).alias("rule_id"),
            F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"),
            F.col("o_totalprice").alias("threshold"),
            F.col("o_orderdate").alias("changed_at"),
            F.col("o_orderkey").alias("seq"),
        )

    @property
    def threshold_changes(self) -> DataFrame:
        key = F.col("o_custkey")
        return self.table("orders").where(F.col("o_orderpriority") == "1-URGENT").select(
            F.concat(F.lit("device-"), key).alias("device_id"),
            _pick(key, "temperature", "humidity", "smoke", "co").alias("sensor_type"),
            (F.col("o_totalprice") / 5000).alias("threshold"),
            F.col("o_orderdate").alias("changed_at"),
            F.col("o_orderkey").alias("seq"),
        )

    @property
    def raised(self) -> DataFrame:
        """First-stage alarms: events above 60."""
        kind = F.col("event_type")
        value = F.col("value")
        none = F.lit(None)
        return self.table("events").where(value > 60).select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("device-"), F.col("user_id")).alias("device_id"),
            _of(kind, ALARM_OF_EVENT).alias("alarm_type"),
            F.when(value > 150, "HIGH").when(value > 100, "MEDIUM").otherwise("LOW")
            .alias("severity"),
            "value",
            _of(kind, {k: v[1] for k, v in SENSOR_OF_EVENT.items()}).alias("unit"),
            "ts",
            F.concat(F.lit("floor-"), F.col("user_id") % 3 + 1).alias("floor_id"),
            _of(kind, ROOM_OF_EVENT).alias("room_id"),
            F.concat(F.lit("zone-"), F.col("user_id") % 5).alias("zone_id"),
            none.cast("boolean").alias("acknowledged"),
            none.cast("boolean").alias("resolved"),
            F.col("props").alias("metadata"),
        )

    @property
    def alarms(self) -> DataFrame:
        """Alarm history rows."""
        return self.raised.select(
            F.col("id"), "device_id", F.col("alarm_type").alias("type"), "severity", "value", "ts"
        )

    @property
    def actions(self) -> DataFrame:
        """Acknowledge at +10 min (clicks and views), resolve at +1 h (above 120)."""
        alarms = self.raised
        actor = F.concat(F.lit("op-"), F.length("device_id"))
        acks = alarms.where(F.col("unit").isin("C", "%")).select(
            F.col("id").alias("alarm_id"), F.lit("ACK").alias("action"), actor.alias("actor"),
            (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"),
        )
        done = alarms.where(F.col("value") > 120).select(
            F.col("id").alias("alarm_id"), F.lit("RESOLVE").alias("action"), actor.alias("actor"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        )
        return acks.unionByName(done)

    @property
    def heartbeats(self) -> DataFrame:
        return self.sensor_data.select("device_id", "ts")

    @property
    def suppression_requests(self) -> DataFrame:
        return self.raised.where(F.col("severity") == "HIGH").select(
            F.col("id").alias("request_id"),
            "device_id",
            "zone_id",
            suppression_agent(F.col("room_id")).alias("suppression_type"),
            F.floor(F.col("value")).cast("int").alias("intensity"),
            "ts",
        )

    @property
    def suppression_devices(self) -> DataFrame:
        return self.devices.select("device_id", "name", "enabled", F.col("active").alias("connected"))

    @property
    def counter_ops(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("device-"), F.col("user_id")).alias("device_id"),
            F.col("event_type").alias("counter_name"),
            F.when(F.col("value") > 150, "SET").otherwise("INC").alias("op"),
            F.floor("value").alias("amount"),
            F.col("event_id").alias("seq"),
        )

    @property
    def counter_samples(self) -> DataFrame:
        """A per-event-type counter that rises each minute and resets daily."""
        seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            F.col("event_type").alias("series"), "ts",
            F.floor(seconds % 86400 / 60).cast("double").alias("value"),
        )

    @property
    def latencies(self) -> DataFrame:
        return self.raised.select(
            "severity", F.col("alarm_type").alias("type"), F.col("value").alias("latency_ms")
        )

    @property
    def sync_log(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("c"), F.col("user_id") % 20).alias("client_id"),
            _of(F.col("event_type"), SYNC_OF_EVENT, "snapshot").alias("kind"),
            "ts",
        )

    @property
    def operations(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("operation"),
            F.when(F.col("value") > 100, "fallback").otherwise("success").alias("outcome"),
            F.col("value").alias("latency_ms"),
        )

    @property
    def packed_ids(self) -> DataFrame:
        """One id per event from its time, device and event number."""
        return self.table("events").select(
            "event_id",
            encode_id(
                millis(F.col("ts")), F.col("user_id") % 1024, F.lit(1), F.col("event_id") % 256
            ).alias("id"),
        )


class StreamedInputs(Inputs):
    """The same tables with ``events`` read as a stream and its time as an instant."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        schema = super().table(name).schema
        events = (
            self.spark.readStream.schema(schema)
            .option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1000)
            .parquet(self.folder)
        )
        return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _case(column: str, table: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    tail = f" ELSE '{default}'" if default else ""
    return f"CASE {column} {whens}{tail} END"


def _nth(number: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number}) % {len(values)} + 1]"


_SENSOR = _case("event_type", {k: v[0] for k, v in SENSOR_OF_EVENT.items()})
_UNIT = _case("event_type", {k: v[1] for k, v in SENSOR_OF_EVENT.items()})
_DEVICE = "'device-' || user_id"
_FLOOR = "'floor-' || (c_nationkey % 3 + 1)"
_ZONE = f"{_FLOOR} || '-' || {_nth('c_custkey', 'north', 'south', 'east', 'west', 'central')}"
_ROOM = _case("c_mktsegment", ROOM_OF_SEGMENT)
_AGENT = (
    "CASE WHEN lower(room_id) LIKE '%server%' OR lower(room_id) LIKE '%data%' THEN 'gas' "
    "WHEN lower(room_id) LIKE '%kitchen%' OR lower(room_id) LIKE '%lab%' THEN 'foam' "
    "ELSE 'water' END"
)

INPUT_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "sensor_data": ((), f"""
        SELECT event_id AS id, {_DEVICE} AS device_id, {_SENSOR} AS sensor_type, value,
               {_UNIT} AS unit, ts, props AS metadata FROM events"""),
    "messages": (("sensor_data",), """
        SELECT id AS message_id, device_id, ts,
               [{'type': sensor_type, 'value': value}] AS readings FROM sensor_data"""),
    "wide_messages": (("sensor_data",), """
        SELECT id AS message_id, device_id, ts,
               [{'type': sensor_type, 'value': value},
                {'type': 'temperature', 'value': value / 10}] AS readings FROM sensor_data"""),
    "devices": ((), f"""
        SELECT 'device-' || c_custkey AS device_id, c_name AS name,
               {_nth('c_custkey', 'smoke', 'temperature', 'fire', 'motion')} AS type,
               (c_custkey % 40 - 20)::DOUBLE AS location_x,
               ((c_nationkey % 3 + 1) * 5)::DOUBLE AS location_y,
               (c_custkey % 30 - 15)::DOUBLE AS location_z,
               c_acctbal > 0 AS active, c_mktsegment <> 'HOUSEHOLD' AS enabled,
               {_FLOOR} AS floor_id, {_ZONE} AS zone_id, {_ROOM} AS room_id FROM customer"""),
    "registry": (("devices",), "SELECT * FROM devices WHERE room_id IS DISTINCT FROM 'Kitchen A'"),
    "device_changes": ((), """
        SELECT 'device-' || o_custkey AS device_id, o_orderstatus <> 'F' AS active,
               o_orderstatus <> 'P' AS enabled, o_orderdate AS ts, o_orderkey AS seq
        FROM orders"""),
    "rules": ((), f"""
        SELECT 'rule-' || c_custkey AS rule_id, 'Rule for ' || c_name AS name,
               'device-' || c_custkey AS device_id,
               {_nth('c_custkey', 'temperature', 'humidity', 'smoke', 'co')} AS sensor_type,
               {_nth('c_custkey // 4', '>', '>=', '<', '<=', '==', '!=')} AS operator,
               (c_custkey % 5 * 25 + 20)::DOUBLE AS threshold,
               [0, 86400, 172800][c_custkey // 24 % 3 + 1] AS time_window_seconds,
               {_nth('c_custkey // 2', 'HIGH', 'MEDIUM', 'LOW', 'critical')} AS severity,
               {_nth('c_custkey', 'FIRE', 'SMOKE', 'GAS')} AS alarm_type,
               'building-1' AS building_id, {_FLOOR} AS floor_id, {_ROOM} AS room_id,
               {_ZONE} AS zone_id, c_custkey % 10 <> 0 AS enabled, '{{}}' AS metadata
        FROM customer"""),
    "rule_log": ((), """
        SELECT 'rule-' || o_custkey AS rule_id,
               CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END AS op,
               o_totalprice AS threshold, o_orderdate AS changed_at, o_orderkey AS seq
        FROM orders"""),
    "threshold_changes": ((), f"""
        SELECT 'device-' || o_custkey AS device_id,
               {_nth('o_custkey', 'temperature', 'humidity', 'smoke', 'co')} AS sensor_type,
               o_totalprice / 5000 AS threshold, o_orderdate AS changed_at, o_orderkey AS seq
        FROM orders WHERE o_orderpriority = '1-URGENT'"""),
    "raised": ((), f"""
        SELECT event_id AS id, {_DEVICE} AS device_id,
               {_case('event_type', ALARM_OF_EVENT)} AS alarm_type,
               CASE WHEN value > 150 THEN 'HIGH' WHEN value > 100 THEN 'MEDIUM' ELSE 'LOW' END
                 AS severity,
               value, {_UNIT} AS unit, ts, 'floor-' || (user_id % 3 + 1) AS floor_id,
               {_case('event_type', ROOM_OF_EVENT)} AS room_id,
               'zone-' || (user_id % 5) AS zone_id, props AS metadata
        FROM events WHERE value > 60"""),
    "alarms": (("raised",), """
        SELECT id, device_id, alarm_type AS type, severity, value, ts FROM raised"""),
    "actions": (("raised",), """
        SELECT id AS alarm_id, 'ACK' AS action, 'op-' || length(device_id) AS actor,
               ts + INTERVAL 10 MINUTE AS ts FROM raised WHERE unit IN ('C', '%')
        UNION ALL
        SELECT id, 'RESOLVE', 'op-' || length(device_id), ts + INTERVAL 1 HOUR
        FROM raised WHERE value > 120"""),
    "heartbeats": (("sensor_data",), "SELECT device_id, ts FROM sensor_data"),
    "suppression_requests": (("raised",), f"""
        SELECT id AS request_id, device_id, zone_id, {_AGENT} AS suppression_type,
               floor(value)::INT AS intensity, ts FROM raised WHERE severity = 'HIGH'"""),
    "suppression_devices": (("devices",), """
        SELECT device_id, name, enabled, active AS connected FROM devices"""),
    "counter_ops": ((), f"""
        SELECT {_DEVICE} AS device_id, event_type AS counter_name,
               CASE WHEN value > 150 THEN 'SET' ELSE 'INC' END AS op,
               floor(value)::BIGINT AS amount, event_id AS seq FROM events"""),
    "counter_samples": ((), """
        SELECT event_type AS series, ts,
               floor((epoch_us(ts) // 1000000) % 86400 / 60)::DOUBLE AS value FROM events"""),
    "latencies": (("raised",), """
        SELECT severity, alarm_type AS type, value AS latency_ms FROM raised"""),
    "sync_log": ((), f"""
        SELECT 'c' || (user_id % 20) AS client_id,
               {_case('event_type', SYNC_OF_EVENT, 'snapshot')} AS kind, ts FROM events"""),
    "operations": ((), """
        SELECT event_type AS operation,
               CASE WHEN value > 100 THEN 'fallback' ELSE 'success' END AS outcome,
               value AS latency_ms FROM events"""),
    "packed_ids": ((), """
        SELECT event_id,
               ((epoch_us(ts) // 1000 - 1672531200000) << 23) | ((user_id % 1024) << 13)
                 | (1 << 8) | (event_id % 256) AS id
        FROM events"""),
}


def with_inputs(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """Oracle text: the named input tables, optional extra CTEs, then the query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in INPUT_SQL[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({INPUT_SQL[name][1].strip()})" for name in ordered]
    if extra:
        parts.append(extra.strip())
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {', '.join(parts)} {body.strip()}" if parts else body.strip()
