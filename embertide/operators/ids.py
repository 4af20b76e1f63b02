"""Time-ordered 64-bit ids for rows, whatever a machine or a millisecond holds.

Numbers inside a group and first places of milliseconds are prefix scans in two steps: inside
slices that a task can hold, then over one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.scalar import SEQUENCE_BITS, encode_id, millis
from embertide.operators.ordered import null_safe
from embertide.session import checked_broadcast, cut

HOT_ROWS = 1_000_000  # rows of one group that one task may number
SLICE_MS = 1 << 20  # milliseconds, and so rows at most, of a slice of the running sums
LANE = 33  # monotonically_increasing_id keeps a row's place in its partition in the lowest 33 bits
_GROUP = ["_machine", "_ms"]


def numbered(rows: DataFrame, group: Sequence[str], tie: Sequence[str], hot: DataFrame | None, name: str) -> DataFrame:
    """Rows numbered from 0 inside their group by ``tie``; the groups of ``hot`` in many tasks.

    Rows of hot groups are sorted by range over (group, tie), so a group goes on from one task to the
    next; a row's number is its place in its task and what earlier tasks hold of the group.
    """
    group = list(group)
    inside = (F.row_number().over(Window.partitionBy(*group).orderBy(*tie)) - 1).cast("long").alias(name)
    if hot is None:
        return rows.select("*", inside)
    hot = checked_broadcast(hot.select(*group))
    order = [*group, *tie]
    ranged = null_safe(rows, hot, group, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_task", F.shiftright("_at", LANE))
    sizes = held.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row per group and task
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    many = null_safe(held, starts, [*group, "_task"], "left").select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
    return null_safe(rows, hot, group, "left_anti").select("*", inside).unionByName(many)


def first_places(counts: DataFrame, slots: int) -> DataFrame:
    """(_machine, _ms, _first): the first place of a millisecond, its own first slot or after all before it.

    ``counts`` has one row (_machine, _ms, _n). With s rows before it on the machine, a millisecond begins at
    s + the greatest ms * slots - (rows before ms) up to it: a running sum and a running maximum of
    it, both taken per slice of time and then over slices.
    """
    sliced = counts.withColumn("_slice", F.floor(F.col("_ms") / F.lit(SLICE_MS)))
    inner = Window.partitionBy("_machine", "_slice").orderBy("_ms")
    local = sliced.withColumn(
        "_s", F.coalesce(F.sum("_n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = local.withColumn("_m", F.max(F.col("_ms") * slots - F.col("_s")).over(inner))
    whole = local.groupBy("_machine", "_slice").agg(F.sum("_n").alias("_all"), F.max("_m").alias("_top"))
    outer = Window.partitionBy("_machine").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_base", F.coalesce(F.sum("_all").over(outer), F.lit(0)))
    whole = whole.withColumn("_high", F.max(F.col("_top") - F.col("_base")).over(outer)).select(
        "_machine", "_slice", "_base", "_high")
    placed = null_safe(local, whole, ["_machine", "_slice"], "left")
    return placed.select(
        "_machine", "_ms",
        (F.col("_base") + F.col("_s") + F.greatest("_high", F.col("_m") - F.col("_base"))).alias("_first"))


def assign_ids(
    df: DataFrame, ts: str, machine: Column, kind: Column, tie: Sequence[str], name: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every row an id; the sequence restarts per millisecond and machine.

    A millisecond has 256 ids a machine. Further rows take the next free ids of the
    following milliseconds, and push on what these hold, so no two rows ever share
    an id. Milliseconds of more than ``hot_rows`` rows are numbered in many tasks.
    """
    slots = 1 << SEQUENCE_BITS
    rows = df.withColumn("_ms", millis(F.col(ts))).withColumn("_machine", machine)
    counts = df.select(machine.alias("_machine"), millis(F.col(ts)).alias("_ms")).groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("_n"))
    over = cut(counts.where(F.col("_n") > slots))
    hot = over.where(F.col("_n") > hot_rows)
    rows = numbered(rows, _GROUP, tie, None if hot.isEmpty() else hot, "_row")
    place = F.col("_ms") * slots
    if not over.isEmpty():
        busy = null_safe(counts, checked_broadcast(over.select("_machine").distinct()), ["_machine"], "left_semi")
        rows = null_safe(rows, first_places(busy, slots), _GROUP, "left")
        place = F.coalesce(F.col("_first"), place)
    rows = rows.withColumn("_place", place + F.col("_row"))
    packed = encode_id(
        F.shiftright("_place", SEQUENCE_BITS), F.col("_machine"), kind, F.col("_place").bitwiseAND(F.lit(slots - 1)))
    return rows.withColumn(name, packed).select(*df.columns, *([] if name in df.columns else [name]))
