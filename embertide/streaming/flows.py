"""Streaming flows built from the operators and the stateful processors.

All flows work on event time. Buckets and liveness close by a watermark; the other
flows have one on the time of arrival only, so that no row is dropped: what is older than
the state of its key is labelled ``late`` and kept. Restarting a flow from its checkpoint neither loses nor
repeats stored rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from embertide.functions.instants import bucket_window
from embertide.functions.scalar import micros
from embertide.operators import alarms as al
from embertide.operators import devices as dv
from embertide.operators import readings as rd
from embertide.operators import rules as rl
from embertide.operators.devices import HEARTBEAT_SECONDS, IDLE_SECONDS
from embertide.operators.metrics import health_columns
from embertide.operators.ordered import (
    TARGET_ROWS, hot_slices, last_accepted, null_safe, staged,
)
from embertide.operators.suppression import EXPIRY_SECONDS
from embertide.sources.store import StoreSink, delete_below, finished_batches
from embertide.streaming.processors import (
    ARRIVAL, KEY, SHARD, AlarmLife, ChangeFilter, Liveness, Presence, Suppression, Throttle,
)

SHARDS = 1024  # hash groups of the keys of a stream; a checkpoint keeps the number it began with
WATERMARK = "10 minutes"
LATENESS_US = 600_000_000


def _plus(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in more.items()]])


# --- aggregates ---------------------------------------------------------------------------


def bucket_stream(readings: DataFrame, width: str, watermark: str = WATERMARK) -> DataFrame:
    """Time buckets per device and sensor type, emitted when the watermark passes them."""
    return (
        readings.withWatermark("ts", watermark)
        .groupBy("device_id", "sensor_type", bucket_window(width, F.col("ts")).alias("_w"))
        .agg(
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "device_id", "sensor_type", F.col("_w.start").alias("bucket"),
            "avg_value", "min_value", "max_value", "n",
        )
    )


def sharded(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds KEY, one text per combination of ``keys`` (null is a value of its own), and SHARD, a hash of it.

    A stateful processor is called once a shard and micro-batch, not once a key. The states of a shard
    are read and written as one, about 1 / SHARDS of all that are kept.
    """
    def text(name: str) -> Column:
        kind, value = rows.schema[name].dataType, F.col(name)
        if isinstance(kind, T.FractionalType):
            value = value + F.lit(0).cast(kind)  # -0.0 is 0.0
        value = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("~"))

    return rows.withColumn(KEY, F.concat(*[text(k) for k in keys])).withColumn(
        SHARD, F.pmod(F.xxhash64(KEY), F.lit(SHARDS)).cast("int"))


def _arriving(rows: DataFrame) -> DataFrame:
    """A watermark on the time of arrival: state can be let go, but no row counts as too old."""
    return rows.withColumn(ARRIVAL, F.current_timestamp()).withWatermark(ARRIVAL, "1 minute")


# --- stateful operators ---------------------------------------------------------------------


def throttle_stream(
    rows: DataFrame,
    keys: Sequence[str],
    windows: Sequence[str | float],
    tie: str = "id",
) -> DataFrame:
    """First-anchored windows in turn; adds ``status``: accepted or late."""
    return _arriving(sharded(rows, keys)).groupBy(SHARD).transformWithStateInPandas(
        Throttle(list(windows), tie), _plus(rows.schema, status=T.StringType()),
        "append", "eventtime",
    )


def dedup_stream(
    rows: DataFrame, keys: Sequence[str], seconds: float = rl.DEDUP_SECONDS
) -> DataFrame:
    return throttle_stream(rows, keys, [seconds])


def change_filter_stream(messages: DataFrame) -> DataFrame:
    """Readings of valid messages with a non-trivial change; adds ``status``."""
    flat = rd.flatten_messages(rd.valid_messages(messages))
    return _arriving(sharded(flat, ["device_id"])).groupBy(SHARD).transformWithStateInPandas(
        ChangeFilter(rd.TRIVIAL_DELTA, rd.TRIVIAL_LEVEL),
        _plus(flat.schema, status=T.StringType()), "append", "eventtime",
    )


def liveness_stream(
    heartbeats: DataFrame, gap_seconds: float = HEARTBEAT_SECONDS, watermark: str = WATERMARK
) -> DataFrame:
    """(device_id, event, at): connected and disconnected events."""
    out = T.StructType([
        T.StructField("device_id", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ])
    return (
        sharded(heartbeats.select("device_id", "ts"), ["device_id"]).select(SHARD, KEY, "ts")
        .withWatermark("ts", watermark)
        .groupBy(SHARD)
        .transformWithStateInPandas(Liveness(gap_seconds), out, "append", "eventtime")
    )


def presence_stream(
    heartbeats: DataFrame, activity: DataFrame, ttl_seconds: float = HEARTBEAT_SECONDS,
    idle_seconds: float = IDLE_SECONDS, watermark: str = WATERMARK,
) -> DataFrame:
    """(device_id, event, at): connected and disconnected events, by heartbeats and by any traffic.

    The same rule as ``liveness_at`` with its ``activity``. Events come once the slower
    of the two inputs is a watermark past them, so it does not matter which is read first.
    """
    out = T.StructType([
        T.StructField("device_id", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ])

    def seen(rows: DataFrame, beat: bool) -> DataFrame:
        return sharded(rows, ["device_id"]).select(
            SHARD, KEY, "ts", F.lit(beat).alias("beat")).withWatermark("ts", watermark)

    return (
        seen(heartbeats, True).unionByName(seen(activity, False))
        .groupBy(SHARD)
        .transformWithStateInPandas(Presence(ttl_seconds, idle_seconds), out, "append", "eventtime")
    )


def suppression_stream(requests: DataFrame, seconds: float = EXPIRY_SECONDS) -> DataFrame:
    """Requests with ``activated_at`` and ``outcome`` (activated, updated, rejected, late)."""
    schema = _plus(requests.schema, activated_at=T.TimestampType(), outcome=T.StringType())
    return _arriving(sharded(requests, ["device_id"])).groupBy(SHARD).transformWithStateInPandas(
        Suppression(seconds), schema, "append", "eventtime"
    )


def alarm_life_stream(alarms: DataFrame, actions: DataFrame) -> DataFrame:
    """Effective RAISE, ACK and RESOLVE changes per alarm, whichever input comes first."""
    out = T.StructType([
        T.StructField("alarm_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ])
    none = F.lit(None).cast("string")
    changes = alarms.select(
        F.col("id").alias("alarm_id"), "device_id", "severity", F.lit("RAISE").alias("action"),
        none.alias("actor"), "ts",
    ).unionByName(
        actions.select(
            "alarm_id", none.alias("device_id"), none.alias("severity"), "action", "actor", "ts"
        )
    )
    return _arriving(sharded(changes, ["alarm_id"]).drop("alarm_id")).groupBy(SHARD).transformWithStateInPandas(
        AlarmLife(), out, "append", "eventtime"
    ).withColumn("alarm_id", F.col("alarm_id").cast("long"))


# --- messages to store, readings to alarms -----------------------------------------------------


class IngestSink(StoreSink):
    """Store kept readings of registered, enabled devices; the registry is read every time.

    Late readings cannot be judged by the change filter any more, so they are stored.
    Device, message and the reading's place in it identify a stored reading; ``id`` is
    a short form of these for lookups and no key.
    """

    def __init__(self, path: str, registry: Callable[[], DataFrame]):
        super().__init__(path, keys=("device_id", "message_id", "pos"), stamp="created_at", probe="message_id")
        self.registry = registry

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        kept = dv.gate(batch, self.registry())
        identified = kept.withColumn("id", F.xxhash64("device_id", "message_id", "pos")).drop("status")
        super().__call__(identified, batch_id)


def ingest_flow(
    messages: DataFrame, registry: Callable[[], DataFrame], path: str, checkpoint: str
) -> DataStreamWriter:
    """Device messages to stored readings: validity, change filter, registry gate, store.

    The filter's state is per device, so gating after it gives the same rows.
    """
    data = messages.where(F.col("type") == "data")
    return (
        change_filter_stream(data)
        .writeStream.foreachBatch(IngestSink(path, registry))
        .option("checkpointLocation", checkpoint)
    )


class AlarmSink:
    """Micro-batches of readings to stored and fanned-out alarms.

    Per micro-batch: registry gate, rule match, rate limit, de-duplication,
    alarm rows, history, topics. ``rules`` and ``registry`` are called every
    time, so changed rules, thresholds and devices take effect live.

    The rate-limit and de-duplication state of the keys is a small table in
    ``folder``, written once per micro-batch from the previous one and pruned of
    keys whose windows have passed. A repeated micro-batch starts from the same
    state and replaces its own output. Large keys are sliced as in batch.
    Rows older than the state of their key, or than the time up to which states
    were pruned, are kept under ``late``.
    """

    STATE = ("rate_us", "dedup_us")

    def __init__(
        self,
        folder: str,
        rules: Callable[[], DataFrame],
        registry: Callable[[], DataFrame] | None = None,
        dedup_seconds: float = rl.DEDUP_SECONDS,
        target_rows: int = TARGET_ROWS,
    ):
        self.folder, self.rules, self.registry = folder, rules, registry
        self.dedup_seconds, self.target_rows = dedup_seconds, target_rows
        self.history = StoreSink(f"{folder}/history", keys=("id", "rule_id", "ts"))
        self.topics = StoreSink(f"{folder}/topics", keys=("topic", "id", "rule_id", "ts"), probe="id")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = dv.gate(batch, self.registry()) if self.registry else batch
        rules = self.rules()
        matched = rl.match_rules(rows, rules)
        state = self._state_before(spark, batch_id)
        bound = self._bound_before(spark, batch_id)
        if state is None:
            before = matched.withColumns({n: F.lit(None).cast("long") for n in self.STATE})
        else:
            before = null_safe(matched, state.select(*rl.ALARM_KEY, *self.STATE), rl.ALARM_KEY, "left")
        slices = hot_slices(rows, rl.SENSOR_KEY, "ts", self.target_rows)
        if slices is not None:
            slices = slices.join(rules.select(*rl.ALARM_KEY), rl.SENSOR_KEY)
        # below the pruning bound a missing state may be a pruned one
        known = F.coalesce(*[F.col(n) for n in self.STATE])
        pruned = F.lit(False) if bound is None else known.isNull() & (micros(F.col("ts")) < F.lit(bound))
        too_old = before.where(pruned).drop(*self.STATE)
        passed = staged(
            before.where(~pruned), rl.ALARM_KEY, "ts", "id",
            [F.col("time_window_seconds"), self.dedup_seconds], slices, self.STATE,
        )
        path = f"{self.folder}/passed/batch={batch_id}"
        passed.write.mode("overwrite").parquet(path)
        passed = spark.read.schema(passed.schema).parquet(path)
        self._write_state(passed, state, batch_id)
        late = passed.where(F.col("passed") < 0).drop("passed", *self.STATE)
        late.unionByName(too_old.select(*late.columns)).write.mode("overwrite").parquet(
            f"{self.folder}/late/batch={batch_id}"
        )
        accepted = passed.where(F.col("passed") == len(self.STATE))
        alarms = al.normalised(al.create_alarms(accepted, keep=("rule_id",)))
        self.history(alarms, batch_id)
        self.topics(al.fan_out(alarms), batch_id)
        delete_below(spark, f"{self.folder}/passed", batch_id)

    def _state_before(self, spark, batch_id: int) -> DataFrame | None:
        done = [n for n in finished_batches(spark, f"{self.folder}/state") if n < batch_id]
        return spark.read.parquet(f"{self.folder}/state/batch={max(done)}") if done else None

    def _bound_before(self, spark, batch_id: int) -> int | None:
        """Event time in microseconds up to which states have been pruned before this batch."""
        done = [n for n in finished_batches(spark, f"{self.folder}/bound") if n < batch_id]
        return spark.read.parquet(f"{self.folder}/bound/batch={max(done)}").first()[0] if done else None

    def _write_state(self, passed: DataFrame, state: DataFrame | None, batch_id: int) -> None:
        fresh = last_accepted(passed, rl.ALARM_KEY, "ts", self.STATE)
        width = passed.where(F.col("passed") > 0).groupBy(*rl.ALARM_KEY).agg(
            F.max("time_window_seconds").alias("rate_seconds")
        )
        fresh = null_safe(fresh, width, rl.ALARM_KEY, "left")
        both = fresh if state is None else fresh.unionByName(state)
        merged = both.groupBy(*rl.ALARM_KEY).agg(
            *[F.max(c).alias(c) for c in (*self.STATE, "rate_seconds")]
        )
        # Event time reached so far, but never ahead of the clock: one device whose clock runs
        # ahead must not prune the others. A key whose windows all ended before needs no state.
        spark = passed.sparkSession
        now = min(merged.agg(F.max("rate_us")).first()[0] or 0, time.time_ns() // 1000)
        bound = max(now - LATENESS_US, self._bound_before(spark, batch_id) or 0)
        until = F.greatest(
            F.col("rate_us") + F.coalesce("rate_seconds", F.lit(0)) * F.lit(1_000_000).cast("long"),
            F.col("dedup_us") + int(self.dedup_seconds * 1_000_000),
        )
        kept = merged.where(until > bound)
        spark.createDataFrame([(bound,)], "bound long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/bound/batch={batch_id}")
        kept.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")
        for name in ("state", "bound"):
            delete_below(spark, f"{self.folder}/{name}", batch_id - 1)


def alarm_flow(readings: DataFrame, sink: AlarmSink, checkpoint: str) -> DataStreamWriter:
    return readings.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


# --- health ---------------------------------------------------------------------------------------


def observed(
    rows: DataFrame, name: str, succeeded: Column, severity: Column, resolved: Column
) -> DataFrame:
    """Attach health figures of every micro-batch to a stream."""
    return rows.observe(name, *health_columns(succeeded, None, severity, resolved))


class HealthListener(StreamingQueryListener):
    """Adds up the observed figures of a stream."""

    SUMMED = ("total", "succeeded", "severity_high", "severity_medium", "severity_low", "active")

    def __init__(self, name: str):
        self.name, self.batches = name, 0
        self.totals = dict.fromkeys(self.SUMMED, 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["total"]:
            self.batches += 1
            for figure in self.SUMMED:
                self.totals[figure] += row[figure]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def summary(self) -> dict:
        total = self.totals["total"]
        return {
            **self.totals,
            "batches": self.batches,
            "success_rate": 100.0 * self.totals["succeeded"] / total if total else 0.0,
            "average_batch": total / self.batches if self.batches else 0.0,
        }
