"""Fire-suppression state per device."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.instants import as_datetime, instant
from embertide.operators.ordered import AUTO, Slices, anchored_by
from embertide.session import checked_broadcast

# Expiry of an activation, length of the kept history, agents.
EXPIRY_SECONDS = 1800
HISTORY_ROWS = 100
AGENTS = ("water", "foam", "gas")


def eligible(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """Requests of devices that exist, are enabled and connected."""
    usable = devices.where("enabled AND connected").select("device_id")
    return requests.join(checked_broadcast(usable), "device_id", "left_semi")


def decide(
    requests: DataFrame, seconds: int = EXPIRY_SECONDS, slices: Slices = AUTO
) -> DataFrame:
    """Outcome of every request: ``activated``, ``updated`` or ``rejected``.

    An activation blocks its device for ``seconds`` and is never extended, so
    activations are the first-anchored rows per device. While active, a request
    of the same type updates the intensity and any other is rejected.
    """
    judged = anchored_by(
        requests, ["device_id"], "ts", "request_id", seconds, "suppression_type", slices
    )
    same = F.col("suppression_type") == F.col("anchor_suppression_type")
    return judged.select(
        *requests.columns,
        F.col("anchor_ts").alias("activated_at"),
        F.when(F.col("accepted"), "activated").when(same, "updated").otherwise("rejected").alias(
            "outcome"
        ),
    )


def activations(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("outcome") == "activated")


def history(decisions: DataFrame, keep: int = HISTORY_ROWS) -> DataFrame:
    """Last ``keep`` activations per device, newest first."""
    window = Window.partitionBy("device_id").orderBy(
        F.col("ts").desc(), F.col("request_id").desc()
    )
    return (
        activations(decisions)
        .withColumn("position", F.row_number().over(window))
        .where(F.col("position") <= keep)
    )


def counters(decisions: DataFrame) -> DataFrame:
    """Per device: activations in total and per type, and the last one."""
    return activations(decisions).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("total_activations"),
        *[
            F.count_if(F.col("suppression_type") == agent).alias(f"{agent}_activations")
            for agent in AGENTS
        ],
        F.max("ts").alias("last_activation"),
    )


def _current(at: datetime, seconds: int) -> dict:
    """Aggregates over a device's decisions up to ``at``: the suppression that is active then, else nulls."""
    live = (F.col("outcome") != "rejected") & (F.col("activated_at") > instant(at - timedelta(seconds=seconds)))
    started = live & (F.col("outcome") == "activated")
    return {
        "suppression_type": F.max(F.when(started, F.col("suppression_type"))),
        "suppression_zone_id": F.max(F.when(started, F.col("zone_id"))),
        "suppression_intensity": F.max_by(
            F.when(live, F.col("intensity")), F.when(live, F.struct("ts", "request_id"))),
        "suppression_activated_at": F.max(F.when(started, F.col("ts"))),
        "suppression_last_updated": F.max(F.when(live, F.col("ts"))),
    }


def current(
    decisions: DataFrame, as_of: datetime | str, seconds: int = EXPIRY_SECONDS
) -> DataFrame:
    """Suppression active at ``as_of``: type, zone, latest intensity."""
    at = as_datetime(as_of)
    found = decisions.where(F.col("ts") <= instant(at)).groupBy("device_id").agg(
        *[c.alias(n) for n, c in _current(at, seconds).items()])
    return found.where(F.col("suppression_last_updated").isNotNull())


def full_status(
    devices: DataFrame,
    decisions: DataFrame,
    as_of: datetime | str,
    seconds: int = EXPIRY_SECONDS,
) -> DataFrame:
    """Device with suppression, counter and last-history columns; the decisions are read once."""
    at = as_datetime(as_of)
    started = F.col("outcome") == "activated"
    total = F.count_if(started)
    details = F.to_json(F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("suppression_type").alias("type"),
        F.col("zone_id").alias("zone"), "intensity"))
    columns = _current(at, seconds) | {
        "counter_total_activations": total,
        **{f"counter_{agent}_activations": F.count_if(started & (F.col("suppression_type") == agent)) for agent in AGENTS},
        "counter_last_activation": F.max(F.when(started, F.col("ts"))),
        "last_activation_details": F.max_by(
            F.when(started, details), F.when(started, F.struct("ts", "request_id"))),
    }
    found = decisions.where(F.col("ts") <= instant(at)).groupBy("device_id").agg(
        *[c.alias(n) for n, c in columns.items()])
    return devices.join(found, "device_id", "left").withColumn(
        "suppression_active", F.col("suppression_type").isNotNull())
