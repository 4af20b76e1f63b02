"""Client synchronisation: snapshots, deltas, merge by id."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.functions.instants import as_datetime, instant
from embertide.operators.alarms import BUFFER_ROWS, in_window, newest, snapshot_rows
from embertide.operators.ordered import null_safe
from embertide.session import checked_broadcast, cut

# Default look-back, how long a snapshot is reused, list sizes.
DEFAULT_LOOKBACK = timedelta(hours=1)
SNAPSHOT_REUSE_SECONDS = 300
LIST_ROWS = 10
CLIENT_ROWS = 100


def sync_markers(log: DataFrame) -> DataFrame:
    """Time of each client's last snapshot; other activity does not move it."""
    return log.where(F.col("kind") == "snapshot").groupBy("client_id").agg(
        F.max("ts").alias("last_snapshot")
    )


def marker_of(markers: DataFrame, client_id: str) -> datetime | None:
    """One client's marker: a single value looked up by key."""
    row = markers.where(F.col("client_id") == client_id).select("last_snapshot").first()
    return row[0] if row else None


def snapshot(
    alarms: DataFrame,
    now: datetime | str,
    last_sync: datetime | str | None = None,
    cap: int = BUFFER_ROWS,
) -> DataFrame:
    """Oldest ``cap`` alarms since the last sync (default: the last hour)."""
    since = as_datetime(last_sync) if last_sync else as_datetime(now) - DEFAULT_LOOKBACK
    return snapshot_rows(alarms, since, now, cap)


def delta(
    alarms: DataFrame, now: datetime | str, last_snapshot: datetime | str | None = None
) -> DataFrame:
    """All alarms since the client's last snapshot, oldest first, uncapped."""
    since = as_datetime(last_snapshot) if last_snapshot else as_datetime(now) - DEFAULT_LOOKBACK
    return in_window(alarms, since, now).orderBy("ts", "id")


def periodic_snapshot(
    alarms: DataFrame, now: datetime | str, cap: int = BUFFER_ROWS
) -> DataFrame:
    """The last hour for everybody."""
    return snapshot(alarms, now, None, cap).withColumn("kind", F.lit("periodic-snapshot"))


def reusable_snapshots(log: DataFrame, now: datetime | str) -> DataFrame:
    """Clients whose cached snapshot is still valid at ``now``."""
    oldest = as_datetime(now) - timedelta(seconds=SNAPSHOT_REUSE_SECONDS)
    return sync_markers(log.where(F.col("ts") <= instant(now))).where(
        F.col("last_snapshot") > instant(oldest)
    )


def client_snapshot(
    alarms: DataFrame, log: DataFrame, client_id: str, now: datetime | str, cap: int = BUFFER_ROWS
) -> DataFrame:
    """The client's snapshot; within the reuse time, the one it was given before."""
    given = marker_of(reusable_snapshots(log, now), client_id)
    return snapshot(alarms, given or now, None, cap)


def merge_by_id(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace rows of the same id; the latest incoming row wins.

    The incoming side is reduced to one row per id first, once. The history meets only its
    ids, by a broadcast while these are few, so a small delta moves no history.
    Ids are taken to be unique in ``existing``, as every earlier merge leaves them.
    """
    latest = cut(latest_by_id(incoming.select(*existing.columns)))
    kept = null_safe(existing, checked_broadcast(latest.select("id")), ["id"], "left_anti")
    return kept.unionByName(latest)


def latest_by_id(rows: DataFrame) -> DataFrame:
    """The newest row of each id; ties go to the greater row."""
    body = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(
        F.max_by(F.struct(*body), F.struct("ts", *[c for c in body if c != "ts"])).alias("_v")
    ).select(*[F.col("id") if c == "id" else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def recent_list(alarms: DataFrame, count: int = LIST_ROWS) -> DataFrame:
    return newest(alarms, count)


def client_list(
    alarms: DataFrame, severity: str | None = None, cap: int = CLIENT_ROWS
) -> DataFrame:
    """The client's last ``cap`` alarms by arrival, then the severity filter."""
    kept = newest(alarms, cap)
    return kept if severity is None else kept.where(F.col("severity") == severity)
