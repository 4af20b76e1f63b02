"""Alarm rules: current state, thresholds, matching, rate limit, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertide.operators.ordered import AUTO, Slices, first_anchored
from embertide.session import checked_broadcast, cut, text_size

# Comparison operators and the de-duplication window.
OPERATORS = (">", ">=", "<", "<=", "==", "!=")
DEDUP_SECONDS = 300
SENSOR_KEY = ["device_id", "sensor_type"]
ALARM_KEY = ["rule_id", "device_id", "sensor_type"]


def check_rules(rules: DataFrame) -> tuple[int, int]:
    """Number of rules and bytes of their text form; ``ValueError`` when one has an operator that does not exist."""
    known = F.coalesce(F.col("operator").isin(*OPERATORS), F.lit(False))
    total, bad, size = rules.agg(F.count(F.lit(1)), F.count_if(~known), text_size(rules)).first()
    if bad:
        some = rules.where(~known).select("rule_id", "operator").limit(5).collect()
        raise ValueError(f"{bad} rules with an invalid operator: {[tuple(r) for r in some]}")
    return total, size


def rule_holds(value: Column, operator: Column, threshold: Column) -> Column:
    tests = (
        value > threshold, value >= threshold, value < threshold,
        value <= threshold, value == threshold, value != threshold,
    )
    case = F.lit(False)
    for symbol, test in zip(OPERATORS, tests):
        case = F.when(operator == symbol, test).otherwise(case)
    return case


def match_rules(
    readings: DataFrame, rules: DataFrame, respect_enabled: bool = True
) -> DataFrame:
    """Reading columns plus the columns of every rule the reading satisfies.

    The rule side is broadcast only when its rows and bytes are measured small; beyond that the join
    shuffles on device and sensor type and AQE splits large keys.
    """
    total, size = check_rules(rules)
    if respect_enabled:
        rules = rules.where("enabled")
    own = set(readings.columns) - set(SENSOR_KEY)
    side = rules.select(
        *[F.col(c).alias(f"rule_{c}" if c in own else c) for c in rules.columns]
    )
    return readings.join(checked_broadcast(side, rows=total, size=size), SENSOR_KEY).where(
        rule_holds(F.col("value"), F.col("operator"), F.col("threshold"))
    )


def current_rules(log: DataFrame) -> DataFrame:
    """Latest version per rule id from a log of ``upsert`` / ``delete`` changes."""
    body = [c for c in log.columns if c != "rule_id"]
    return (
        log.groupBy("rule_id")
        .agg(F.max_by(F.struct(*body), F.struct("changed_at", "seq")).alias("_v"))
        .where(F.col("_v.op") != "delete")
        .select("rule_id", *[F.col(f"_v.{c}").alias(c) for c in body if c not in ("op", "seq")])
    )


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("rule_id") == rule_id)


def current_thresholds(changes: DataFrame) -> DataFrame:
    """Last written threshold per device and sensor type."""
    return changes.groupBy(*SENSOR_KEY).agg(
        F.max_by("threshold", F.struct("changed_at", "seq")).alias("threshold")
    )


def newer_thresholds(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored changes and further ones: the latest per device and sensor type, for ``KeyedTable.merge``."""
    rows = stored.unionByName(changes)
    body = [c for c in rows.columns if c not in SENSOR_KEY]
    return rows.groupBy(*SENSOR_KEY).agg(F.max_by(F.struct(*body), F.struct("changed_at", "seq")).alias("_v")).select(
        *SENSOR_KEY, *[F.col(f"_v.{c}").alias(c) for c in body])


def with_threshold(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Readings with their threshold, null when none is set; the thresholds are computed once."""
    return readings.join(checked_broadcast(cut(thresholds)), SENSOR_KEY, "left")


def apply_thresholds(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest threshold replaces that of every rule of its device and sensor."""
    newest = current_thresholds(changes).withColumnRenamed("threshold", "_new")
    columns = rules.columns
    return (
        rules.join(newest, SENSOR_KEY, "left")
        .withColumn("threshold", F.coalesce("_new", "threshold"))
        .select(*columns)
    )


def rate_limited(
    matches: DataFrame, slices: Slices = AUTO, key: list[str] | None = None
) -> DataFrame:
    """First match per rule in every ``time_window_seconds``; 0 lets everything through."""
    return first_anchored(
        matches, key or ["rule_id"], "ts", "id", [F.col("time_window_seconds")], slices
    )


def deduplicated(
    matches: DataFrame,
    seconds: int = DEDUP_SECONDS,
    slices: Slices = AUTO,
    key: list[str] | None = None,
) -> DataFrame:
    """Drop repeats of a key less than ``seconds`` after the last accepted one."""
    return first_anchored(matches, key or ALARM_KEY, "ts", "id", [seconds], slices)


def raised(
    matches: DataFrame, dedup_seconds: int = DEDUP_SECONDS, slices: Slices = AUTO
) -> DataFrame:
    """Rate limit, then de-duplication, in one shuffle on rule, device and sensor."""
    windows = [F.col("time_window_seconds"), dedup_seconds]
    return first_anchored(matches, ALARM_KEY, "ts", "id", windows, slices)
