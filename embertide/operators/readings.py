"""Sensor readings: message shapes, validity, change filter, lookups, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertide.functions.instants import Instant, instant, time_bucket
from embertide.functions.scalar import ratio
from embertide.operators.ordered import AUTO, Slices, lag_by

# Accepted range and trivial-change rule per sensor type.
VALID_RANGE = {
    "temperature": (-50.0, 100.0),
    "humidity": (0.0, 100.0),
    "smoke": (0.0, None),
    "co": (0.0, None),
}
TRIVIAL_DELTA = {"temperature": 0.5, "humidity": 1.0}
TRIVIAL_LEVEL = {"smoke": 5.0, "co": 5.0}


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("ts").desc(), F.col("id").desc())


def in_range(df: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Rows in ``[start, end]``; also prunes ``day`` partitions when the table has them."""
    low, high = instant(start), instant(end)
    kept = df.where(F.col("ts").between(low, high))
    if "day" in df.columns:
        kept = kept.where(F.col("day").between(low.cast("date"), high.cast("date")))
    return kept


def of_device(data: DataFrame, device_id: str) -> DataFrame:
    return _newest_first(data.where(F.col("device_id") == device_id))


def of_sensor(data: DataFrame, device_id: str, sensor_type: str) -> DataFrame:
    wanted = (F.col("device_id") == device_id) & (F.col("sensor_type") == sensor_type)
    return _newest_first(data.where(wanted))


def of_device_between(data: DataFrame, device_id: str, start: Instant, end: Instant) -> DataFrame:
    return _newest_first(in_range(data.where(F.col("device_id") == device_id), start, end))


def value_summary(
    data: DataFrame, device_id: str, sensor_type: str, start: Instant, end: Instant
) -> DataFrame:
    """One row: average, maximum and minimum value; nulls when nothing matches."""
    wanted = (F.col("device_id") == device_id) & (F.col("sensor_type") == sensor_type)
    return in_range(data.where(wanted), start, end).agg(
        F.avg("value").alias("avg_value"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
    )


def bucketed(
    data: DataFrame,
    width: str,
    start: Instant | None = None,
    end: Instant | None = None,
    device_id: str | None = None,
    sensor_type: str | None = None,
) -> DataFrame:
    """Average, minimum, maximum and count per device, sensor type and time bucket."""
    if device_id is not None:
        data = data.where(F.col("device_id") == device_id)
    if sensor_type is not None:
        data = data.where(F.col("sensor_type") == sensor_type)
    if start is not None and end is not None:
        data = in_range(data, start, end)
    ntz = data.schema["ts"].dataType.typeName() == "timestamp_ntz"
    return data.groupBy(
        "device_id", "sensor_type", time_bucket(width, F.col("ts"), ntz).alias("bucket")
    ).agg(
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("n"),
    )


# --- messages ------------------------------------------------------------------


def flatten_messages(messages: DataFrame) -> DataFrame:
    """One row per reading, with its position in the message."""
    return messages.select(
        "message_id", "device_id", "ts", F.posexplode("readings").alias("pos", "reading")
    ).select(
        "message_id",
        "device_id",
        "ts",
        "pos",
        F.col("reading.type").alias("sensor_type"),
        F.col("reading.value").alias("value"),
    )


def reading_is_valid(sensor_type: Column, value: Column) -> Column:
    checks = F.lit(False)
    for kind, (low, high) in VALID_RANGE.items():
        inside = value >= low if high is None else value.between(low, high)
        checks = checks | ((sensor_type == kind) & inside)
    return F.coalesce(checks, F.lit(False))


def message_is_valid(readings: Column) -> Column:
    """Readings must be present and all valid; an empty array is valid."""
    return F.coalesce(
        F.forall(readings, lambda r: reading_is_valid(r["type"], r["value"])), F.lit(False)
    )


def valid_messages(messages: DataFrame) -> DataFrame:
    return messages.where(message_is_valid(F.col("readings")))


def change_is_trivial(sensor_type: Column, value: Column, previous: Column) -> Column:
    """Against the previous valid value; a first reading is never trivial."""
    case = F.lit(False)
    for kind, delta in TRIVIAL_DELTA.items():
        case = case | ((sensor_type == kind) & (F.abs(value - previous) < delta))
    for kind, level in TRIVIAL_LEVEL.items():
        case = case | ((sensor_type == kind) & (value < level) & (previous < level))
    return previous.isNotNull() & case


def judge_messages(messages: DataFrame, slices: Slices = AUTO) -> DataFrame:
    """Valid messages with readings, plus ``trivial``: all readings are trivial changes.

    Devices number their own messages, so (device_id, message_id) identifies one. ``slices`` are the large (device_id, sensor_type) keys. Readings are collected
    as a set, so copies of one message collapse before the shuffle.
    """
    flat = flatten_messages(valid_messages(messages))
    compared = lag_by(
        flat, ["device_id", "sensor_type"], ["ts", "message_id", "pos"], "value", "previous",
        slices,
    )
    trivial = change_is_trivial(F.col("sensor_type"), F.col("value"), F.col("previous"))
    return compared.groupBy("device_id", "message_id").agg(
        F.any_value("ts").alias("ts"),
        F.array_sort(
            F.collect_set(F.struct("pos", F.col("sensor_type").alias("type"), "value"))
        ).alias("placed"),
        F.bool_and(trivial).alias("trivial"),
    )


def changed_messages(messages: DataFrame, slices: Slices = AUTO) -> DataFrame:
    """Messages that are valid and hold a non-trivial change.

    A message without readings counts as all-trivial and is dropped.
    """
    return judge_messages(messages, slices).where(~F.col("trivial")).select(
        "message_id",
        "device_id",
        "ts",
        F.transform("placed", lambda r: F.struct(r["type"], r["value"])).alias("readings"),
    )


def change_filter_rate(messages: DataFrame, slices: Slices = AUTO) -> DataFrame:
    """Total and dropped messages and the dropped share in percent."""
    kept = judge_messages(messages, slices).agg(F.count_if(~F.col("trivial")).alias("kept"))
    total = messages.agg(F.count(F.lit(1)).alias("total"))
    both = total.select("total", F.lit(0).cast("long").alias("kept")).unionByName(
        kept.select(F.lit(0).cast("long").alias("total"), "kept")
    )
    return both.agg(F.sum("total").alias("total"), F.sum("kept").alias("kept")).select(
        "total",
        (F.col("total") - F.col("kept")).alias("filtered"),
        ratio(F.col("total") - F.col("kept"), F.col("total"), 100.0).alias("filter_rate"),
    )
