"""Devices: lookups, current state, registry gates, status board, liveness."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.instants import as_datetime, instant
from embertide.functions.scalar import micros, ratio, severity_rank
from embertide.session import checked_broadcast

# Heartbeat life time and read-idle limit in seconds.
HEARTBEAT_SECONDS = 30
IDLE_SECONDS = 10


def by_id(devices: DataFrame, device_id: str) -> DataFrame:
    return devices.where(F.col("device_id") == device_id)


def on_floor(devices: DataFrame, floor_id: str) -> DataFrame:
    return devices.where(F.col("floor_id") == floor_id)


def in_zone(devices: DataFrame, zone_id: str) -> DataFrame:
    return devices.where(F.col("zone_id") == zone_id)


def active(devices: DataFrame) -> DataFrame:
    return devices.where("active")


def enabled(devices: DataFrame) -> DataFrame:
    return devices.where("enabled")


def current_devices(changes: DataFrame) -> DataFrame:
    """Latest row per device from a change log; ``last_updated`` is its time."""
    body = [c for c in changes.columns if c not in ("device_id", "ts", "seq")]
    return (
        changes.groupBy("device_id")
        .agg(F.max_by(F.struct(*body, "ts"), F.struct("ts", "seq")).alias("_v"))
        .select(
            "device_id",
            *[F.col(f"_v.{c}").alias(c) for c in body],
            F.col("_v.ts").alias("last_updated"),
        )
    )


def newer_devices(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored rows of a change log and further changes: the latest row per device, for ``KeyedTable.merge``."""
    rows = stored.unionByName(changes)
    body = [c for c in rows.columns if c != "device_id"]
    return rows.groupBy("device_id").agg(F.max_by(F.struct(*body), F.struct("ts", "seq")).alias("_v")).select(
        "device_id", *[F.col(f"_v.{c}").alias(c) for c in body])


def registration(devices: DataFrame, now: datetime | str) -> DataFrame:
    """Change-log rows that register devices: enabled, registered at ``now``."""
    return devices.withColumns(
        {"enabled": F.lit(True), "registration_date": instant(now), "ts": instant(now)}
    )


def status_change(devices: DataFrame, now: datetime | str, **flags: bool) -> DataFrame:
    """Change-log rows that set flags (``enabled``, ``active``) on devices."""
    return devices.withColumns(
        {**{name: F.lit(value) for name, value in flags.items()}, "ts": instant(now)}
    )


# --- registry gates ---------------------------------------------------------------------


def known(messages: DataFrame, registry: DataFrame) -> DataFrame:
    return messages.join(
        checked_broadcast(registry.select("device_id")), "device_id", "left_semi"
    )


def unknown(messages: DataFrame, registry: DataFrame) -> DataFrame:
    return messages.join(
        checked_broadcast(registry.select("device_id")), "device_id", "left_anti"
    )


def gate(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """Messages of registered and enabled devices."""
    return known(messages, enabled(registry))


def registry_filter_rate(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """Lookups, lookups of unregistered devices and their share in percent.

    Messages are counted per device before the registry is joined.
    """
    per_device = messages.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    marked = per_device.join(
        registry.select("device_id").distinct().withColumn("_known", F.lit(True)),
        "device_id",
        "left",
    )
    return marked.agg(
        F.sum("n").alias("lookups"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias(
            "filtered"
        ),
    ).withColumn("filter_rate", ratio(F.col("filtered"), F.col("lookups"), 100.0))


# --- status board --------------------------------------------------------------------------


def status_board(devices: DataFrame, alarms: DataFrame) -> DataFrame:
    """Device with its display class: highest alarm severity, else active / inactive."""
    worst = alarms.groupBy("device_id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    rank = F.coalesce("rank", F.lit(0))
    return devices.join(worst, "device_id", "left").select(
        "device_id",
        "active",
        rank.alias("alarm_rank"),
        F.when(rank == 3, "alarm_high")
        .when(rank == 2, "alarm_medium")
        .when(rank == 1, "alarm_low")
        .when(F.col("active"), "active")
        .otherwise("inactive")
        .alias("status"),
    )


# --- liveness ---------------------------------------------------------------------------------


def online_intervals(heartbeats: DataFrame, gap_seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Connected intervals per device: a heartbeat keeps it online for ``gap_seconds``.

    Heartbeats sharing one gap-wide slot are always in one interval, so they are
    merged before the shuffle; a device then has at most one row per slot.
    """
    us = micros(F.col("ts"))
    gap_us = gap_seconds * 1_000_000
    slots = heartbeats.groupBy("device_id", F.floor(us / F.lit(gap_us)).alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")
    )
    ordered = Window.partitionBy("device_id").orderBy("slot")
    silent = micros(F.col("first")) - micros(F.lag("last").over(ordered)) >= gap_us
    numbered = slots.withColumn("_new", F.coalesce(silent, F.lit(True)).cast("int")).withColumn(
        "_interval", F.sum("_new").over(ordered)
    )
    return (
        numbered.groupBy("device_id", "_interval")
        .agg(
            F.min("first").alias("online_at"),
            F.max("last").alias("last_heartbeat"),
            F.sum("n").alias("heartbeats"),
        )
        .select(
            "device_id",
            "online_at",
            "last_heartbeat",
            (F.col("last_heartbeat") + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias(
                "offline_at"
            ),
            "heartbeats",
        )
    )


def liveness_at(
    heartbeats: DataFrame,
    as_of: datetime | str,
    ttl_seconds: int = HEARTBEAT_SECONDS,
    activity: DataFrame | None = None,
    idle_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """Per device: last heartbeat and whether it is connected at ``as_of``.

    With ``activity`` (any inbound message) a device silent for
    ``idle_seconds`` is disconnected as well.
    """
    at = as_datetime(as_of)

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("ts") <= instant(at)).groupBy("device_id").agg(
            F.max("ts").alias(name)
        )

    status = last(heartbeats, "last_heartbeat")
    alive = F.col("last_heartbeat") > instant(at - timedelta(seconds=ttl_seconds))
    if activity is not None:
        status = status.join(last(activity, "_seen"), "device_id", "left")
        seen = F.greatest("last_heartbeat", "_seen")
        alive = alive & (seen > instant(at - timedelta(seconds=idle_seconds)))
    return status.select("device_id", "last_heartbeat", alive.alias("connected"))


def connected_count(liveness: DataFrame) -> DataFrame:
    return liveness.agg(F.count_if("connected").alias("connected_devices"))


def last_connection(connections: DataFrame) -> DataFrame:
    """Last connection time and state per device."""
    return connections.groupBy("device_id").agg(
        F.max("ts").alias("last_connected"),
        F.max_by("connected", F.struct("ts", "seq")).alias("connected"),
    )
