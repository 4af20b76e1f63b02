"""Instants, ranges and time buckets."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertide.functions.scalar import micros

# Buckets count from Monday 2000-01-03, month buckets from 2000-01.
BUCKET_ORIGIN_DAYS = 10959
MONTH_ORIGIN = "2000-01-01"
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_MONTHS = {"month": 1, "year": 12}
_WIDTH = re.compile(r"\s*(\d+)\s*(second|minute|hour|day|week|month|year)s?\s*")

Instant = datetime | str | Column


def as_datetime(value: datetime | str) -> datetime:
    """ISO-8601 text or datetime to a naive UTC datetime."""
    parsed = datetime.fromisoformat(value) if isinstance(value, str) else value
    if parsed.tzinfo is not None:
        parsed = parsed.astimezone(timezone.utc).replace(tzinfo=None)
    return parsed


def instant(value: Instant) -> Column:
    """A timestamp literal; kept without zone so it pushes down on either type."""
    if isinstance(value, Column):
        return value
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def floor_millis(value: datetime | str) -> datetime:
    parsed = as_datetime(value)
    return parsed.replace(microsecond=parsed.microsecond // 1000 * 1000)


def width_parts(width: str) -> tuple[str, int]:
    """``"7 days"`` to ``("seconds", 604800)``, ``"1 year"`` to ``("months", 12)``."""
    match = _WIDTH.fullmatch(width.lower())
    if not match or int(match[1]) == 0:
        raise ValueError(f"not a bucket width: {width!r}")
    count, unit = int(match[1]), match[2]
    if unit in _MONTHS:
        return "months", count * _MONTHS[unit]
    return "seconds", count * _SECONDS[unit]


def time_bucket(width: str, ts: Column, ntz: bool = False) -> Column:
    """Start of the bucket holding ``ts`` (session time zone UTC)."""
    kind, size = width_parts(width)
    if kind == "months":
        passed = (F.year(ts) - 2000) * 12 + F.month(ts) - 1
        start = F.add_months(
            F.lit(MONTH_ORIGIN).cast("date"), (passed - F.pmod(passed, F.lit(size))).cast("int")
        ).cast("timestamp")
    else:
        step = size * 1_000_000
        origin = BUCKET_ORIGIN_DAYS * 86_400_000_000 % step
        us = micros(ts)
        start = F.timestamp_micros(us - F.pmod(us - F.lit(origin), F.lit(step)))
    return start.cast("timestamp_ntz") if ntz else start


def bucket_window(width: str, ts: Column) -> Column:
    """The same buckets as an event-time ``window``, for streaming aggregates."""
    kind, size = width_parts(width)
    if kind == "months":
        raise ValueError("streaming buckets need a fixed width")
    offset = BUCKET_ORIGIN_DAYS * 86400 % size
    span = f"{size} seconds"
    return F.window(ts, span, span, f"{offset} seconds")
