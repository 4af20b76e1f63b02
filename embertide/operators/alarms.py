"""Alarms: creation, normal form, fan-out, history queries, paging, counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.instants import Instant, as_datetime, floor_millis, instant
from embertide.functions.scalar import (
    known_severity, location_text, millis, same_text, suppression_agent,
)

# Limits of the history views.
RETENTION_DAYS = 30
BUFFER_ROWS = 1000
SCAN_ROWS = 100
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
TYPES = ("FIRE", "SMOKE", "GAS")
FULL_INTENSITY = 100
ALL_TOPIC = "all"

_MS = timedelta(milliseconds=1)


def _newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("id").desc()]


# --- creation and normal form ----------------------------------------------------


def create_alarms(
    matches: DataFrame, id_column: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Alarm rows from rule matches; the alarm carries the reading's time."""
    def place(name: str) -> Column:
        return F.col(name) if name in matches.columns else F.lit(None).cast("double")

    none = F.lit(None)
    return matches.select(
        (F.col("id") if id_column is None else id_column).alias("id"),
        "device_id",
        "alarm_type",
        "severity",
        "value",
        "unit",
        "ts",
        *[place(c).alias(c) for c in ("location_x", "location_y", "location_z")],
        "building_id",
        "floor_id",
        "room_id",
        "zone_id",
        F.lit(False).alias("acknowledged"),
        none.cast("timestamp").alias("acknowledged_at"),
        none.cast("string").alias("acknowledged_by"),
        F.lit(False).alias("resolved"),
        none.cast("timestamp").alias("resolved_at"),
        none.cast("string").alias("resolved_by"),
        F.concat(F.lit("Triggered by rule: "), F.col("name")).alias("notes"),
        F.col("rule_metadata" if "rule_metadata" in matches.columns else "metadata")
        .alias("metadata"),
        *keep,
    )


def manual_alarms(
    readings: DataFrame,
    alarm_type: str,
    severity: str,
    notes: str | None = None,
    id_column: Column | None = None,
    **place: str,
) -> DataFrame:
    """Alarms raised by hand on readings; ``place`` gives building, floor, room and zone ids."""
    named = {c: place.get(c) for c in ("building_id", "floor_id", "room_id", "zone_id")}
    filled = readings.withColumns({
        **{c: F.lit(v).cast("string") for c, v in named.items()},
        "alarm_type": F.lit(alarm_type), "severity": F.lit(severity), "name": F.lit(""),
    })
    return create_alarms(filled, id_column).withColumn("notes", F.lit(notes).cast("string"))


def notifications(matches: DataFrame, id_column: Column | None = None) -> DataFrame:
    """Rule and reading columns of a notification; random ids unless given."""
    return matches.select(
        (F.uuid() if id_column is None else id_column).alias("id"),
        F.col("ts"),
        "rule_id",
        F.col("name").alias("rule_name"),
        "device_id",
        "sensor_type",
        "value",
        "threshold",
        "operator",
        "alarm_type",
        "severity",
        "building_id",
        "floor_id",
        "room_id",
        "zone_id",
        "location_x",
        "location_y",
        "location_z",
    )


def normalised(alarms: DataFrame) -> DataFrame:
    """History form: text id, known severity, message, flags never null."""
    kept = [
        c for c in alarms.columns
        if c not in ("id", "alarm_type", "severity", "acknowledged", "resolved")
    ]
    return alarms.select(
        F.col("id").cast("string").alias("id"),
        F.col("alarm_type").alias("type"),
        known_severity(F.col("severity")).alias("severity"),
        F.col("severity").isNull().alias("severity_missing"),
        F.concat(
            F.lit("Alarm: "), F.col("alarm_type"), F.lit(" - "),
            F.coalesce("severity", F.lit("null")),
        ).alias("message"),
        location_text(F.col("floor_id"), F.col("zone_id")).alias("location"),
        F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"),
        F.coalesce("resolved", F.lit(False)).alias("resolved"),
        *kept,
    )


def fan_out(alarms: DataFrame) -> DataFrame:
    """Each alarm once for the common topic and once for its severity's topic."""
    return alarms.withColumn(
        "topic", F.explode(F.array(F.lit(ALL_TOPIC), F.lower("severity")))
    )


def needs_suppression(severity: Column, alarm_type: Column) -> Column:
    return (F.upper(severity) == "HIGH") & (F.upper(alarm_type) == "FIRE")


def suppression_requests(alarms: DataFrame) -> DataFrame:
    """Requests raised by high fire alarms, at full intensity."""
    return alarms.where(needs_suppression(F.col("severity"), F.col("alarm_type"))).select(
        F.col("id").alias("request_id"),
        "device_id",
        "zone_id",
        suppression_agent(F.col("room_id")).alias("suppression_type"),
        F.lit(FULL_INTENSITY).alias("intensity"),
        "ts",
    )


# --- history windows and lists -----------------------------------------------------


def unique_alarms(alarms: DataFrame) -> DataFrame:
    """An identical event is stored once."""
    return alarms.dropDuplicates()


def _from_ms(ts: Column, value: datetime | str) -> Column:
    return ts >= instant(floor_millis(value))


def _until_ms(ts: Column, value: datetime | str) -> Column:
    # Same as comparing whole milliseconds, but on the bare column, so it pushes down.
    return ts < instant(floor_millis(value) + _MS)


def in_window(alarms: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Alarms in ``[start, end]`` at millisecond precision, unordered."""
    if as_datetime(start) > as_datetime(end):
        raise ValueError("start is after end")
    ts = F.col("ts")
    kept = alarms.where(_from_ms(ts, start) & _until_ms(ts, end))
    if "day" in alarms.columns:
        days = [as_datetime(v).date() for v in (start, end)]
        kept = kept.where(F.col("day").between(F.lit(days[0]), F.lit(days[1])))
    return kept


def between(alarms: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Alarms in ``[start, end]``, oldest first."""
    return in_window(alarms, start, end).orderBy("ts", "id")


def of_severity(alarms: DataFrame, severity: str) -> DataFrame:
    return alarms.where(same_text(F.col("severity"), severity))


def of_type(alarms: DataFrame, alarm_type: str) -> DataFrame:
    return alarms.where(same_text(F.col("type"), alarm_type))


def of_device(alarms: DataFrame, device_id: str) -> DataFrame:
    return alarms.where(F.col("device_id") == device_id)


def newest(alarms: DataFrame, count: int = 10) -> DataFrame:
    return alarms.orderBy(*_newest()).limit(count)


def newest_per(alarms: DataFrame, key: str, count: int = 10) -> DataFrame:
    """Newest ``count`` per key; rows are cut per task before the shuffle."""
    window = Window.partitionBy(key).orderBy(*_newest())
    return alarms.withColumn("position", F.row_number().over(window)).where(
        F.col("position") <= count
    )


def page(alarms: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0), newest first."""
    return alarms.orderBy(*_newest()).offset(number * size).limit(size)


def time_page(alarms: DataFrame, start: datetime | str, size: int) -> DataFrame:
    """First ``size`` alarms of the hour from ``start``, oldest first."""
    end = as_datetime(start) + timedelta(hours=1)
    return in_window(alarms, start, end).orderBy("ts", "id").limit(size)


def cursor_page(alarms: DataFrame, cursor: datetime | str, size: int) -> DataFrame:
    """Newest ``size`` alarms strictly older, in milliseconds, than the cursor.

    Alarms in the cursor's own millisecond are skipped. The next cursor is the
    last row's time.
    """
    return newest(alarms.where(F.col("ts") < instant(floor_millis(cursor))), size)


def next_cursor(page_rows: DataFrame) -> DataFrame:
    return page_rows.agg(F.timestamp_millis(millis(F.min("ts"))).alias("cursor"))


def buffered(alarms: DataFrame, size: int = BUFFER_ROWS) -> DataFrame:
    """The capped buffer: the newest ``size`` alarms overall."""
    return newest(alarms, size)


def newest_matching(
    alarms: DataFrame, wanted: Column, count: int = 10, scan: int = SCAN_ROWS
) -> DataFrame:
    """First ``count`` matches among the newest ``scan`` alarms, nothing older."""
    return newest(newest(alarms, scan).where(wanted), count)


def snapshot_rows(
    alarms: DataFrame, start: datetime | str, end: datetime | str, cap: int = BUFFER_ROWS
) -> DataFrame:
    """Oldest ``cap`` alarms of a window."""
    return in_window(alarms, start, end).orderBy("ts", "id").limit(cap)


def time_bounds(alarms: DataFrame) -> DataFrame:
    return alarms.agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def split_retention(
    alarms: DataFrame, now: datetime | str, days: int = RETENTION_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(removed, kept): removed are at or before ``now - days``, in milliseconds."""
    cutoff = as_datetime(now) - timedelta(days=days)
    old = _until_ms(F.col("ts"), cutoff)
    return alarms.where(old), alarms.where(~old)


def retention_report(
    alarms: DataFrame, now: datetime | str, days: int = RETENTION_DAYS
) -> DataFrame:
    old = _until_ms(F.col("ts"), as_datetime(now) - timedelta(days=days))
    return alarms.agg(
        F.count_if(old).alias("removed"), F.count_if(~old).alias("remaining")
    )


# --- counts ---------------------------------------------------------------------------


def count_in_window(alarms: DataFrame, start: Instant, end: Instant) -> DataFrame:
    return in_window(alarms, start, end).agg(F.count(F.lit(1)).alias("n"))


def counts_by(alarms: DataFrame, key: str) -> DataFrame:
    return alarms.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stats_summary(
    alarms: DataFrame,
    severities: tuple[str, ...] = SEVERITIES,
    types: tuple[str, ...] = TYPES,
) -> DataFrame:
    """Total, zero-filled counts per listed severity and type, and the time range."""
    counted = [
        F.count_if(same_text(F.col("severity"), s)).alias(f"severity_{s.lower()}")
        for s in severities
    ] + [F.count_if(same_text(F.col("type"), t)).alias(f"type_{t.lower()}") for t in types]
    return alarms.agg(
        F.count(F.lit(1)).alias("total"),
        *counted,
        F.min("ts").alias("oldest"),
        F.max("ts").alias("newest"),
    ).withColumn(
        "range_seconds",
        F.unix_seconds(F.col("newest").cast("timestamp"))
        - F.unix_seconds(F.col("oldest").cast("timestamp")),
    )


def recent_stats(alarms: DataFrame, size: int = BUFFER_ROWS) -> DataFrame:
    """Total, per-severity and per-type counts of the newest ``size`` alarms."""
    recent = newest(alarms, size)
    return (
        recent.groupingSets(
            [[F.col("severity")], [F.col("type")], []], F.col("severity"), F.col("type")
        )
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
        .select("severity", "type", F.col("level").cast("int").alias("level"), "n")
    )


# --- acknowledge and resolve -----------------------------------------------------------


def active_alarms(alarms: DataFrame, actions: DataFrame) -> DataFrame:
    """Alarms not resolved, with their latest acknowledgement."""
    latest = actions.groupBy("alarm_id").agg(
        F.bool_or(F.col("action") == "RESOLVE").alias("_resolved"),
        F.max_by(
            F.when(F.col("action") == "ACK", F.struct("ts", "actor")),
            F.when(F.col("action") == "ACK", F.struct("ts", "actor")),
        ).alias("_ack"),
    )
    kept = [
        c for c in alarms.columns
        if c not in ("acknowledged", "acknowledged_at", "acknowledged_by")
    ]
    joined = alarms.join(latest, alarms["id"] == latest["alarm_id"], "left")
    return joined.where(~F.coalesce("_resolved", F.lit(False))).select(
        *kept,
        F.col("_ack").isNotNull().alias("acknowledged"),
        F.col("_ack.ts").alias("acknowledged_at"),
        F.col("_ack.actor").alias("acknowledged_by"),
    )
