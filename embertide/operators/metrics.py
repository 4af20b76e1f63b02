"""Rates, counters, distinct counts, histograms and health figures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.instants import as_datetime, instant
from embertide.functions.scalar import micros, ratio
from embertide.operators.ordered import AUTO, Slices, lag_by, null_safe
from embertide.operators.percentiles import approximate

# Rate window and step, percentiles.
RATE_SECONDS = 300
RATE_STEP_SECONDS = 60
LATENCY_PROBS = (0.5, 0.95, 0.99)


# --- distinct counts ---------------------------------------------------------------


def distinct_events(accepted: DataFrame, key: str = "rule_id", event: str = "id") -> DataFrame:
    """Exact distinct accepted events per key; (key, event) is de-duplicated in parallel."""
    return accepted.select(key, event).distinct().groupBy(key).agg(
        F.count(F.lit(1)).alias("n")
    )


def distinct_sketches(accepted: DataFrame, key: str = "rule_id", event: str = "id") -> DataFrame:
    """HyperLogLog sketch per key, mergeable later."""
    return accepted.groupBy(key).agg(F.hll_sketch_agg(event).alias("sketch"))


def sketch_counts(sketches: DataFrame, key: str = "rule_id") -> DataFrame:
    return sketches.select(key, F.hll_sketch_estimate("sketch").alias("n"))


def sketch_union(sketches: DataFrame) -> DataFrame:
    """Estimated distinct events over all keys together."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def dedup_rates(
    events: DataFrame,
    accepted: DataFrame,
    keys: Sequence[str],
    as_of: datetime | str,
    seconds: int,
    event: str = "id",
) -> DataFrame:
    """De-duplication figures at ``as_of``.

    ``reference_rate`` = (distinct accepted - keys accepted within the window) /
    distinct accepted * 100; ``drop_rate`` = dropped / total * 100.
    """
    at = as_datetime(as_of)
    figures = accepted.where(F.col("ts") <= instant(at)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"),
        F.count_if(F.col("last") > instant(at - timedelta(seconds=seconds))).alias("live_keys"),
    )
    total = events.where(F.col("ts") <= instant(at)).agg(F.count(F.lit(1)).alias("total"))
    both = figures.select("accepted", "live_keys", F.lit(0).cast("long").alias("total"))
    both = both.unionByName(
        total.select(
            F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("live_keys"),
            "total",
        )
    ).agg(*[F.sum(c).alias(c) for c in ("accepted", "live_keys", "total")])
    return both.select(
        "*",
        ratio(F.col("accepted") - F.col("live_keys"), F.col("accepted"), 100.0).alias(
            "reference_rate"
        ),
        ratio(F.col("total") - F.col("accepted"), F.col("total"), 100.0).alias("drop_rate"),
    )


# --- counters -----------------------------------------------------------------------------


def counter_values(operations: DataFrame) -> DataFrame:
    """Counter per device and name: last SET plus the increments after it."""
    keys = ["device_id", "counter_name"]
    is_set = F.col("op") == "SET"
    last = operations.where(is_set).groupBy(*keys).agg(
        F.max("seq").alias("_at"), F.max_by("amount", "seq").alias("_base")
    )
    later = null_safe(operations.where(~is_set), last.select(*keys, "_at"), keys, "left").where(
        F.col("_at").isNull() | (F.col("seq") > F.col("_at"))
    )
    parts = later.groupBy(*keys).agg(F.sum("amount").alias("value")).unionByName(
        last.select(*keys, F.col("_base").alias("value"))
    )
    return parts.groupBy(*keys).agg(F.sum("value").alias("value"))


def counter_value(operations: DataFrame, device_id: str, counter_name: str) -> DataFrame:
    """One counter, 0 when it was never written."""
    mine = operations.where(
        (F.col("device_id") == device_id) & (F.col("counter_name") == counter_name)
    )
    return counter_values(mine).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


# --- rates -----------------------------------------------------------------------------------


def event_rates(
    events: DataFrame,
    by: str,
    seconds: int = RATE_SECONDS,
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Events per second over a trailing window, per ``by`` value and overall (null).

    Events are counted per step first; only step counts enter the overlapping
    windows.
    """
    step_us = step_seconds * 1_000_000
    steps = events.groupBy(
        F.col(by), F.floor(micros(F.col("ts")) / F.lit(step_us)).alias("_step")
    ).agg(F.count(F.lit(1)).alias("_n"))
    covered = seconds // step_seconds
    spread = steps.withColumn(
        "_end", F.explode(F.sequence(F.col("_step") + 1, F.col("_step") + covered))
    )
    total = (
        spread.groupingSets([[F.col(by), F.col("_end")], [F.col("_end")]], F.col(by), F.col("_end"))
        .agg(F.sum("_n").alias("n"), F.grouping(by).alias("_all"))
    )
    return total.select(
        F.col(by),
        (F.col("_all") == 1).alias("overall"),
        F.timestamp_micros(F.col("_end") * step_us).alias("window_end"),
        "n",
        (F.col("n") / F.lit(float(seconds))).alias("per_second"),
    )


def _growth(samples: DataFrame, slices: Slices):
    """Samples with the one before, and by how much a counter has grown since; a drop is a reset."""
    steps = lag_by(samples, ["series"], ["ts", "value"], "value", "_before", slices)
    grown = F.when(F.col("_before").isNull(), F.lit(0.0)).when(
        F.col("value") < F.col("_before"), F.col("value")
    ).otherwise(F.col("value") - F.col("_before"))
    return steps, grown


def windowed_counter_rates(
    samples: DataFrame, seconds: int = 300, step_seconds: int = 60, slices: Slices = AUTO
) -> DataFrame:
    """Reset-aware increase of a counter over trailing windows, one per step, and per second.

    Growth counts at the sample that shows it. It is summed per step first; only these
    sums enter the overlapping windows. Windows without a sample have no row.
    """
    step_us = step_seconds * 1_000_000
    steps, grown = _growth(samples, slices)
    sums = steps.groupBy("series", F.floor(micros(F.col("ts")) / F.lit(step_us)).alias("_step")).agg(
        F.sum(grown).alias("_grown"))
    ends = F.sequence(F.col("_step") + 1, F.col("_step") + seconds // step_seconds)
    return sums.withColumn("_end", F.explode(ends)).groupBy("series", "_end").agg(
        F.sum("_grown").alias("increase")
    ).select(
        "series", F.timestamp_micros(F.col("_end") * step_us).alias("window_end"), "increase",
        (F.col("increase") / F.lit(float(seconds))).alias("per_second"))


def edge_rates(
    samples: DataFrame, series: Sequence[str], seconds: int = 300, step_seconds: int = 60, slices: Slices = AUTO,
) -> DataFrame:
    """Per-second rates of cumulative counters over trailing windows, as dashboards draw them.

    A window (end - seconds, end] takes growth between its own samples only, so it needs two; a
    drop is a reset to zero. The growth is then stretched to the window's edges: to an edge that
    is less than 1.1 sample distances away, else by half a distance, and to the start never below a count of
    zero. Samples are summed up per step first; only these sums enter the overlapping windows.
    """
    series, step_us = list(series), step_seconds * 1_000_000
    keyed = samples.withColumn("series", F.struct(*series)) if series != ["series"] else samples
    steps, grown = _growth(keyed, slices)
    us = micros(F.col("ts"))
    parts = steps.withColumn("_us", us).withColumn("_grown", grown).groupBy(
        "series", F.ceil(F.col("_us") / F.lit(step_us)).alias("_step")
    ).agg(
        F.min(F.struct("_us", "value", "_grown")).alias("_first"), F.max("_us").alias("_last"),
        F.sum("_grown").alias("_grown"), F.count(F.lit(1)).alias("_n"))
    ends = F.sequence(F.col("_step"), F.col("_step") + seconds // step_seconds - 1)
    windows = parts.withColumn("_end", F.explode(ends)).groupBy("series", "_end").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_grown").alias("_grown"),
        F.sum("_n").alias("_n")).where("_n > 1")
    end = F.col("_end") * step_us
    growth = F.col("_grown") - F.col("_first._grown")
    span = (F.col("_last") - F.col("_first._us")).cast("double")
    distance = span / (F.col("_n") - 1)
    to_start = (F.col("_first._us") - (end - seconds * 1_000_000)).cast("double")
    to_zero = F.when((growth > 0) & (F.col("_first.value") >= 0), span * F.col("_first.value") / growth)
    to_end = (end - F.col("_last")).cast("double")
    near = lambda gap: F.when(gap < distance * 1.1, gap).otherwise(distance / 2)
    stretched = span + near(F.least(to_start, F.coalesce(to_zero, to_start))) + near(to_end)
    named = [F.col(f"series.{c}").alias(c) for c in series] if series != ["series"] else [F.col("series")]
    return windows.where(span > 0).select(
        *named, F.timestamp_micros(end).alias("window_end"),
        (growth * stretched / span / F.lit(float(seconds))).alias("per_second"))


def windowed_quantiles(
    samples: DataFrame, probs: Sequence[float], by: Sequence[str] = (), series: Sequence[str] = ("series",),
    seconds: int = 300, step_seconds: int = 60, slices: Slices = AUTO,
) -> DataFrame:
    """Quantiles of what histogram counters counted in trailing windows, per ``by`` and window end.

    ``samples``: cumulative counts ``value`` of every ``series`` and upper bound ``le`` at ``ts``. Rates of equal
    bounds are added up; a bound's sum is at least that of the bound below. Windows in which nothing was counted, or
    without the unbounded bucket, have no row.
    """
    rates = edge_rates(samples, [*series, "le"], seconds, step_seconds, slices)
    summed = rates.groupBy(*by, "window_end", "le").agg(F.sum("per_second").alias("_rate"))
    upto = Window.partitionBy(*by, "window_end").orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    level = summed.withColumn("count", F.max("_rate").over(upto))
    whole = level.groupBy(*by, "window_end").agg(F.max("le").alias("_top"), F.max("count").alias("_all")).where(
        (F.col("_top") == float("inf")) & (F.col("_all") > 0))
    kept = null_safe(level, whole.drop("_top", "_all"), [*by, "window_end"], "left_semi")
    return histogram_quantiles(kept, [*by, "window_end"], probs)


def counter_rates(samples: DataFrame, slices: Slices = AUTO) -> DataFrame:
    """Reset-aware increase of a cumulative counter per series, and per second."""
    steps, grown = _growth(samples, slices)
    span = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / F.lit(1e6)
    return steps.groupBy("series").agg(
        F.sum(grown).alias("increase"), span.alias("span_seconds")
    ).withColumn("per_second", ratio(F.col("increase"), F.col("span_seconds")))


def histogram(values: DataFrame, key: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts per key, the last bucket unbounded."""
    edges = [*bounds, float("inf")]
    counted = values.groupBy(key).agg(
        *[F.count_if(F.col(value) <= F.lit(float(e))).alias(f"_b{i}") for i, e in enumerate(edges)]
    )
    pairs = F.array(
        *[F.struct(F.lit(float(e)).alias("le"), F.col(f"_b{i}").alias("count"))
          for i, e in enumerate(edges)]
    )
    return counted.select(key, F.inline(pairs))


def histogram_quantiles(buckets: DataFrame, key: str | Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles by linear interpolation inside cumulative buckets.

    In the unbounded bucket the highest finite bound is returned.
    """
    keys = [key] if isinstance(key, str) else list(key)
    summed = buckets.groupBy(*keys, "le").agg(F.sum("count").alias("_c"))
    order = Window.partitionBy(*keys).orderBy("le")
    edges = (
        summed.withColumn("_lo", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
        .withColumn("_below", F.coalesce(F.lag("_c").over(order), F.lit(0)))
        .withColumn("_all", F.max("_c").over(Window.partitionBy(*keys)))
    )
    asked = edges.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    rank = F.col("prob") * F.col("_all")
    hit = (F.col("_c") >= rank) & ((F.col("_below") < rank) | (F.col("_lo") == 0) & (rank == 0))
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (rank - F.col("_below")) / F.nullif(
        F.col("_c") - F.col("_below"), F.lit(0)
    )
    found = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside)
    return asked.where(hit).groupBy(*keys, "prob").agg(F.min(found).alias("quantile"))


# --- counts and health --------------------------------------------------------------------------


def latency_percentiles(rows: DataFrame, keys: Sequence[str], value: str = "latency_ms"):
    return approximate(rows, keys, value, LATENCY_PROBS)


def distribution_counts(alarms: DataFrame) -> DataFrame:
    """Counts per severity and per (device, severity, type), in one pass."""
    device, severity, kind = F.col("device_id"), F.col("severity"), F.col("type")
    return (
        alarms.groupingSets([[severity], [device, severity, kind]], device, severity, kind)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("device_id").alias("_all"))
        .select("device_id", "severity", "type", (F.col("_all") == 1).alias("per_severity"), "n")
    )


def failure_counts(outcomes: DataFrame, reason: str = "reason") -> DataFrame:
    return outcomes.where(F.col(reason).isNotNull()).groupBy(reason).agg(
        F.count(F.lit(1)).alias("n")
    )


def health_columns(
    succeeded: Column, batch: Column, severity: Column, resolved: Column
) -> list[Column]:
    """The figures of a running flow, for ``agg`` and for ``observe`` alike."""
    total = F.count(F.lit(1))
    batches = F.approx_count_distinct(batch) if batch is not None else F.lit(0)
    return [
        total.alias("total"),
        F.count_if(succeeded).alias("succeeded"),
        ratio(F.count_if(succeeded), total, 100.0).alias("success_rate"),
        batches.alias("batches"),
        *[F.count_if(severity == s).alias(f"severity_{s.lower()}")
          for s in ("HIGH", "MEDIUM", "LOW")],
        F.count_if(~resolved).alias("active"),
    ]


def flow_health(
    rows: DataFrame, succeeded: Column, batch: str, severity: str, resolved: Column
) -> DataFrame:
    """Totals, success rate in percent, average batch size, severity counts, active rows."""
    per_batch = rows.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(succeeded).alias("ok"),
        *[F.count_if(F.col(severity) == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")],
        F.count_if(~resolved).alias("open"),
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_batch.agg(
        total.alias("total"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("succeeded"),
        F.count(F.lit(1)).alias("batches"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"severity_{s}") for s in ("high", "medium", "low")],
        F.coalesce(F.sum("open"), F.lit(0)).alias("active"),
    ).select(
        "*",
        ratio(F.col("succeeded"), F.col("total"), 100.0).alias("success_rate"),
        ratio(F.col("total"), F.col("batches")).alias("average_batch"),
    )


def sync_statistics(log: DataFrame) -> DataFrame:
    """Pushes, pulls, snapshots, clients with a snapshot, last push."""
    kind = F.col("kind")
    per_client = log.groupBy("client_id").agg(
        *[F.count_if(kind == k).alias(k) for k in ("push", "pull", "snapshot")],
        F.max(F.when(kind == "push", F.col("ts"))).alias("last"),
    )
    return per_client.agg(
        F.sum("push").alias("pushes"),
        F.sum("pull").alias("pulls"),
        F.sum("snapshot").alias("snapshots"),
        F.count_if(F.col("snapshot") > 0).alias("active_clients"),
        F.max("last").alias("last_update"),
    )


def operation_counts(log: DataFrame) -> DataFrame:
    """Requests per operation and outcome."""
    return log.groupBy("operation", "outcome").agg(F.count(F.lit(1)).alias("n"))
