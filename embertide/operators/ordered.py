"""Order-dependent operators that stay parallel when one key is very large.

A key normally lives in one task. A key with more than ``target_rows`` rows is
cut along time into slices of about that size; slices are processed
independently and joined up by a small carried state per slice boundary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.functions.scalar import micros
from embertide.operators.bands import chain_before_slices
from embertide.session import checked_broadcast, cut

TARGET_ROWS = 5_000_000
SHAPE = ("_slice_us", "_rows", "_target")  # of a large key: slice width, rows, rows wanted in a task
FEW_WINDOWS = 64  # slices of fewer windows tell little from the rows before them; see ``bands``
AUTO = "auto"  # look for large keys; pass hot_slices() of a cheaper frame, or None, to skip that
Slices = DataFrame | str | None
SLICE, US, NO_STATE = "_slice", "_us", None


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, null matching null; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    on = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def hot_slices(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    target_rows: int = TARGET_ROWS,
    slot_seconds: int = 1,
) -> DataFrame | None:
    """Slice width and rows per large key, or None when no key is large.

    The width is chosen from the key's densest slot, so no slice exceeds
    ``target_rows`` unless one single slot does. At most total / target_rows
    keys can be large. Pass a cheap frame (keys and time only are read).
    """
    keys = list(keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = cut(counted.where(F.col("_rows") > target_rows))
    if large.isEmpty():
        return None
    slot_us = slot_seconds * 1_000_000
    dense = (
        null_safe(df.select(*keys, ts), checked_broadcast(large.select(*keys)), keys, "left_semi")
        .groupBy(*keys, F.floor(micros(F.col(ts)) / F.lit(slot_us)).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.max("_n").alias("_n"), F.sum("_n").alias("_rows"))
    )
    slots = F.greatest(F.lit(1), F.floor(F.lit(target_rows) / F.col("_n")))
    return cut(dense.select(
        *keys, (slots * slot_us).cast("long").alias("_slice_us"), "_rows",
        F.lit(target_rows).cast("long").alias("_target")))


def resolve(slices: Slices, df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame | None:
    return hot_slices(df, keys, ts) if isinstance(slices, str) else slices


def with_slice(df: DataFrame, keys: Sequence[str], ts: str, slices: DataFrame | None) -> DataFrame:
    """Add the slice number; null for keys that are not sliced."""
    if slices is None:
        return df.withColumn(SLICE, F.lit(None).cast("long"))
    sliced = null_safe(df, checked_broadcast(slices), keys, "left")
    return sliced.withColumn(
        SLICE, F.floor(micros(F.col(ts)) / F.col("_slice_us")).cast("long")
    ).drop(*SHAPE)


def lag_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    slices: Slices = AUTO,
) -> DataFrame:
    """Previous ``value`` of the same key by ``order`` (whose first column is the time)."""
    keys = list(keys)
    slices = resolve(slices, df, keys, order[0])
    if slices is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    tagged = with_slice(df, keys, order[0], slices)
    within = Window.partitionBy(*keys, SLICE).orderBy(*order)
    last = (
        tagged.where(F.col(SLICE).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    )
    # One row per slice: the group size is bounded by the time range.
    carried = last.select(
        *keys, SLICE, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_in")
    )
    inside = tagged.withColumn("_first", F.row_number().over(within) == 1).withColumn(
        name, F.lag(value).over(within)
    )
    return (
        null_safe(inside, carried, [*keys, SLICE], "left")
        .withColumn(name, F.when(F.col("_first"), F.col(f"_in.{value}")).otherwise(F.col(name)))
        .drop("_first", "_in", SLICE)
    )


# --- first-anchored windows ----------------------------------------------------
#
# Per key, in time order: accept a row, ignore rows less than N seconds after the
# accepted one, accept the next. N <= 0 accepts everything.


def first_anchored(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    windows: Sequence[Column | int | float],
    slices: Slices = AUTO,
) -> DataFrame:
    """Rows accepted by every window in turn; each window sees the previous one's output.

    ``windows`` are seconds, constant within a key.
    """
    out = staged(df, keys, ts, tie, windows, slices)
    return out.where(F.col("passed") == len(windows)).drop("passed")


def staged(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    windows: Sequence[Column | int | float],
    slices: Slices = AUTO,
    before: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with ``passed``: how many of the (one or two) windows accepted them, if any.

    ``before`` names columns with the last accepted time (microseconds, null
    when none) of the row's key per window, from earlier data. Rows older than
    the first of them come out with ``passed`` = -1 and change nothing.
    """
    keys = list(keys)
    slices = resolve(slices, df, keys, ts)
    if slices is None or len(windows) == 1:
        return _fold(df, keys, ts, tie, windows, slices, before=before).drop(*before or [])
    if len(windows) > 2:
        raise ValueError("at most two windows")
    entry = [[name] for name in before] if before else [None, None]
    first = _fold(df, keys, ts, tie, windows[:1], slices, before=entry[0])
    late = first.where(F.col("passed") < 0)
    second = _fold(
        first.where(F.col("passed") > 0).withColumnRenamed("passed", "_first"),
        keys, ts, tie, windows[1:], slices, before=entry[1], keep_all=True,
    ).withColumn("passed", F.col("_first") + F.col("passed"))
    out = second.drop("_first")
    if before:
        out = out.unionByName(late)
    return out.drop(*before or [])


def last_accepted(passed: DataFrame, keys: Sequence[str], ts: str, names: Sequence[str]):
    """Per key and window the time (microseconds) of its last accepted row."""
    return passed.where(F.col("passed") > 0).groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("passed") > n, micros(F.col(ts)))).alias(name)
            for n, name in enumerate(names)
        ]
    )


def anchored_by(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    window: Column | int | float,
    carry: str,
    slices: Slices = AUTO,
) -> DataFrame:
    """All rows plus ``accepted``, ``anchor_ts`` and ``anchor_<carry>`` of the governing row."""
    kind = df.schema[ts].dataType
    slices = resolve(slices, df, keys, ts)
    out = _fold(df, list(keys), ts, tie, [window], slices, carry=carry, keep_all=True)
    return (
        out.withColumn("accepted", F.col("passed") == 1)
        .withColumn("anchor_ts", F.timestamp_micros("_anchor_us").cast(kind))
        .withColumn(f"anchor_{carry}", F.col("_anchor").cast(df.schema[carry].dataType))
        .drop("passed", "_anchor_us", "_anchor")
    )


def _fold(df, keys, ts, tie, windows, slices, before=None, carry=None, keep_all=False):
    columns = df.columns
    prepared = with_slice(df, keys, ts, slices).withColumn(US, micros(F.col(ts)))
    widths, entries = [], []
    for number, window in enumerate(windows):
        seconds = window if isinstance(window, Column) else F.lit(window)
        widths.append(f"_w{number}")
        entries.append(f"_in{number}_us")
        known = F.col(before[number]) if before else F.lit(None)
        prepared = prepared.withColumn(
            widths[-1], F.coalesce((seconds.cast("double") * 1e6).cast("long"), F.lit(0).cast("long"))
        ).withColumn(entries[-1], known.cast("long"))
    group = [*keys, SLICE]
    prepared = prepared.withColumn(
        "_carry", (F.col(carry) if carry else F.lit(None)).cast("string")
    )
    if slices is None:
        shuffled = prepared.withColumn("_in", F.lit(None).cast("string")).repartition(*keys)
    else:
        states = _entry_states(prepared, keys, tie, widths[0], entries[0], slices, windows[0], carry)
        shuffled = (
            null_safe(prepared.withColumnRenamed(entries[0], "_before"), states, group, "left")
            .withColumn(entries[0], F.coalesce(entries[0], "_before"))
            .repartition(*group)
        )
    ordered = shuffled.sortWithinPartitions(*group, US, tie)
    added = [T.StructField("passed", T.IntegerType())]
    if carry:
        added += [
            T.StructField("_anchor_us", T.LongType()), T.StructField("_anchor", T.StringType())
        ]
    schema = T.StructType([prepared.schema[c] for c in columns] + added)
    label_late = before is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(group, widths, entries, label_late, want_anchor=carry is not None)
        for batch in batches:
            if batch.num_rows:
                passed, *anchors = fold.step(batch)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in columns] + [pa.array(passed, pa.int32()), *anchors],
                    names=[*columns, *[f.name for f in added]],
                )
                yield out if keep_all else out.filter(pa.array(passed != 0))

    return ordered.mapInArrow(run, schema)


def _entry_states(prepared, keys, tie, width, entry, slices, window, carry):
    """State entering each slice of the sliced keys: (keys, slice, ``entry``, _in).

    Where a slice spans many windows, its effect on any state is a small step function. Where it spans
    few or only a part of one, that would be as large as the slice, so the key is read in bands instead.
    """
    sliced = prepared.where(F.col(SLICE).isNotNull())
    if isinstance(window, Column):
        widest = sliced.groupBy(*keys).agg(F.max(width).alias("_w"))
        shapes = cut(null_safe(slices, widest, keys, "inner"))
    else:
        shapes = slices.withColumn("_w", F.lit(int(float(window) * 1e6)).cast("long"))
    banded = (F.col("_w") > 0) & (F.col("_slice_us") < FEW_WINDOWS * F.col("_w"))
    found = shapes.agg(F.count_if(banded), F.count_if(~banded), F.sum(F.when(banded, F.col("_rows"))),
                       F.max("_target")).first()
    if not found[0]:
        return _step_states(sliced, keys, tie, width, entry)
    chosen = checked_broadcast(shapes.where(banded).select(*keys, "_slice_us"))
    states = _band_states(null_safe(sliced, chosen, keys, "inner"), keys, tie, width, entry, found[2], found[3], carry)
    if found[1]:
        others = checked_broadcast(shapes.where(~banded).select(*keys))
        states = states.unionByName(
            _step_states(null_safe(sliced, others, keys, "left_semi"), keys, tie, width, entry))
    return states


def _band_states(sliced, keys, tie, width, entry, total, target_rows, carry):
    # A chain goes on from an earlier state: rows less than a window after it are not accepted.
    able = F.col(entry).isNull() | (F.col(US) >= F.col(entry) + F.col(width))
    rows = sliced.where(able).withColumn("_width", F.col(width))
    states = chain_before_slices(rows, keys, total, target_rows).withColumnRenamed(US, entry)
    if carry is None:
        return states.withColumn("_in", F.lit(None).cast("string"))
    states = cut(states)
    wanted = checked_broadcast(states.select(*keys, F.col(entry).alias(US)).distinct())
    values = null_safe(sliced.select(*keys, US, tie, "_carry"), wanted, [*keys, US], "left_semi").groupBy(
        *keys, F.col(US).alias(entry)).agg(F.min_by("_carry", tie).alias("_in"))
    return null_safe(states, values, [*keys, entry], "left")


def _step_states(sliced, keys, tie, width, entry):
    group = [*keys, SLICE]
    narrow = sliced.select(*group, US, tie, width, entry, "_carry")
    key_fields = [narrow.schema[c] for c in group]
    summary_schema = T.StructType(
        key_fields
        + [
            T.StructField("_width", T.LongType()),
            T.StructField("_before", T.LongType()),
            T.StructField("_upper", T.ArrayType(T.LongType())),
            T.StructField("_exit_us", T.ArrayType(T.LongType())),
            T.StructField("_exit", T.ArrayType(T.StringType())),
        ]
    )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*group, "_width", "_before", "_upper", "_exit_us", "_exit"]
        for head, times, carries, size, earlier in _slices_of(batches, group, width, entry):
            if earlier is not None:
                # Late rows change nothing.
                fresh = times >= earlier
                times, carries = times[fresh], carries.filter(pa.array(fresh))
            upper, exit_us, exit_at = transition(times, size)
            row = [pa.array([v], type=f) for v, f in head]
            row += [
                pa.array([size], pa.int64()),
                pa.array([earlier], pa.int64()),
                pa.array([upper], pa.list_(pa.int64())),
                pa.array([exit_us], pa.list_(pa.int64())),
                pa.array([carries.take(pa.array(exit_at)).to_pylist()], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(row, names=names)

    summaries = (
        narrow.repartition(*group).sortWithinPartitions(*group, US, tie)
        .mapInArrow(summarise, summary_schema)
    )
    entry_schema = T.StructType(
        key_fields + [T.StructField(entry, T.LongType()), T.StructField("_in", T.StringType())]
    )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, value = (), NO_STATE, None
        for batch in batches:
            key_rows = list(zip(*[batch.column(c).to_pylist() for c in keys]))
            sizes, befores = [batch.column(c).to_pylist() for c in ("_width", "_before")]
            steps = [batch.column(c) for c in ("_upper", "_exit_us", "_exit")]
            states, values = [], []
            for row, (key, size, earlier) in enumerate(zip(key_rows, sizes, befores)):
                if key != current:
                    current, state, value = key, earlier, None
                states.append(state)
                values.append(value)
                upper, exit_us, exits = [c[row].values for c in steps]
                at = 0 if state is None else int(np.searchsorted(upper.to_numpy(), state + size))
                if at < len(upper):
                    state, value = exit_us[at].as_py(), exits[at].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in group]
                + [pa.array(states, pa.int64()), pa.array(values, pa.string())],
                names=[*group, entry, "_in"],
            )

    return (
        summaries.repartition(*keys).sortWithinPartitions(*group).mapInArrow(compose, entry_schema)
    )


def _slices_of(batches, group, width, entry):
    """Whole slices from sorted batches: (key cells, times, carries, window, earlier state)."""
    head, parts, texts, size, earlier = None, [], [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = _group_bounds(batch, group)
        for start, end in zip(bounds[:-1], bounds[1:]):
            cells = [(batch.column(c)[start].as_py(), batch.column(c).type) for c in group]
            if head is not None and [v for v, _ in cells] != [v for v, _ in head]:
                yield head, np.concatenate(parts), pa.chunked_array(texts), size, earlier
                parts, texts = [], []
            head = cells
            size = batch.column(width)[start].as_py()
            earlier = batch.column(entry)[start].as_py()
            parts.append(batch.column(US)[start:end].to_numpy())
            texts.append(batch.column("_carry")[start:end])
    if head is not None:
        yield head, np.concatenate(parts), pa.chunked_array(texts), size, earlier


def transition(times: np.ndarray, size: int) -> tuple[list, list, list]:
    """What a slice does to the state entering it.

    For an incoming accept time s, find the first ``upper >= s + size``: the
    state leaving is the matching ``exit_us`` (row ``exit_at``); past the last
    entry the state passes unchanged. Runs of equal exits are merged.
    """
    count = len(times)
    if not count:
        return [], [], []
    follow = _next_accept(times, np.zeros(count, np.int64), np.full(count, size))
    rows = np.arange(count)
    last = np.where(follow < count, follow, rows)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    candidates = rows[: min(int(follow[0]), count - 1) + 1]
    exits = last[candidates]
    if size <= 0:
        exits = np.full(len(candidates), count - 1)
    ends = np.append(np.flatnonzero(np.diff(exits)), len(candidates) - 1)
    # A later incoming state still passes unchanged only beyond the last row.
    upper = times[candidates[ends]]
    return upper.tolist(), times[exits[ends]].tolist(), exits[ends].tolist()


def _group_bounds(batch: pa.RecordBatch, group: Sequence[str]) -> np.ndarray:
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in group:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(
            zero_copy_only=False
        )
        changed |= codes[1:] != codes[:-1]
    return np.concatenate(([0], np.flatnonzero(changed) + 1, [batch.num_rows]))


def _next_accept(times: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per row, the first later row of the same owner at least ``size`` after it.

    Rows are sorted by (owner, time); the owner's end is returned when none.
    """
    count = len(times)
    end = np.searchsorted(owner, owner, side="right")
    base = int(times.min())
    span = int(times.max()) - base + 1
    if (int(owner[-1]) - int(owner[0]) + 2) * span < 2**62:
        line = (owner - owner[0]) * span + (times - base)
        found = np.searchsorted(line, line + np.minimum(size, span))
    else:
        found = np.empty(count, np.int64)
        for start in np.unique(np.searchsorted(owner, owner)):
            stop = end[start]
            block = times[start:stop]
            found[start:stop] = start + np.searchsorted(block, block + size[start:stop])
    return np.minimum(np.maximum(found, np.arange(count) + 1), end)


class _Fold:
    """Applies the windows over sorted batches, keeping one state per window."""

    def __init__(self, group, widths, entries, label_late: bool, want_anchor: bool):
        self.group, self.widths, self.entries = group, widths, entries
        self.label_late, self.want_anchor = label_late, want_anchor
        self.key: list | None = None
        self.states: list = [NO_STATE] * len(widths)
        self.anchor: tuple = (None, None)

    def step(self, batch: pa.RecordBatch):
        count = batch.num_rows
        bounds = _group_bounds(batch, self.group)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        times = batch.column(US).to_numpy()
        continues = [batch.column(c)[0].as_py() for c in self.group] == self.key
        self.key = [batch.column(c)[count - 1].as_py() for c in self.group]
        passed = np.zeros(count, np.int32)
        alive = np.arange(count)
        if self.label_late:
            floor = batch.column(self.entries[0]).fill_null(np.iinfo(np.int64).min).to_numpy()
            late = times < floor
            passed[late] = -1
            alive = alive[~late]
        for number, (width, entry) in enumerate(zip(self.widths, self.entries)):
            # The state entering each group: carried over, or given with its rows.
            given = batch.column(entry).take(pa.array(bounds[:-1])).to_pylist()
            if continues:
                given[0] = self.states[number]
            size = batch.column(width).to_numpy()[alive]
            alive = alive[_walk(times[alive], owner[alive], size, given)]
            passed[alive] = number + 1
            mine = alive[owner[alive] == owner[-1]]
            self.states[number] = int(times[mine[-1]]) if len(mine) else given[-1]
        if not self.want_anchor:
            return (passed,)
        return passed, *self._anchors(batch, passed == 1, bounds, owner, times, continues)

    def _anchors(self, batch, accepted, bounds, owner, times, continues):
        """Time and carried value of the accepted row governing each row."""
        rows = np.maximum.accumulate(np.where(accepted, np.arange(len(times)), -1))
        inside = rows >= bounds[owner]
        us = pa.array(np.where(inside, times[rows], 0), mask=~inside)
        text = batch.column("_carry").take(pa.array(np.where(inside, rows, 0)))
        if not inside.all():
            # Governed by an accepted row of an earlier batch or slice.
            before_us = batch.column(self.entries[0]).take(pa.array(bounds[:-1])).to_pylist()
            before = batch.column("_in").take(pa.array(bounds[:-1])).to_pylist()
            if continues:
                before_us[0], before[0] = self.anchor
            us = pc.if_else(pa.array(inside), us, pa.array(before_us, pa.int64()).take(pa.array(owner)))
            text = pc.if_else(pa.array(inside), text, pa.array(before, pa.string()).take(pa.array(owner)))
        self.anchor = us[-1].as_py(), text[-1].as_py()
        return us, text


def _walk(times, owner, size, given: list) -> np.ndarray:
    """Rows accepted by one window; ``given`` is the state entering each owner."""
    count = len(times)
    if not count:
        return np.zeros(0, np.int64)
    follow = _next_accept(times, owner, size).tolist()
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ends = np.append(starts[1:], count)
    picked: list[int] = []
    for start, end, who in zip(starts.tolist(), ends.tolist(), owner[starts].tolist()):
        at, state = start, given[who]
        if state is not None and size[start] > 0:
            at += int(np.searchsorted(times[start:end], state + size[start]))
        while at < end:
            picked.append(at)
            at = follow[at]
    return np.asarray(picked, np.int64)
