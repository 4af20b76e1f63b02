"""Accepted rows of first-anchored windows for keys that no task can hold, whatever the window.

Time is read as a slot of one window's length and an offset inside it. The row accepted after one at
(slot, offset) is the first of the next slot at that offset or later, so offsets of a chain only grow
until it runs off the end of a slot. A key is therefore cut into bands of offsets, each over
all of its slots: a chain enters a band at its first row of some slot, stays in it slot after
slot, and leaves it for the next band in a later slot. All that a band has to tell is, for every slot that it
has rows in, the slot in which a chain that enters there has left it. That is bounded by the slots of
the key, not by its rows; the chain of a key is walked over these numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.session import cut

BAND, KIND = "_band", "_kind"
FEW_ROWS = 100_000  # a target below this is met by any number of partitions that Spark would choose


def band_exits(times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots with rows, and per slot the one in which a chain entering at its first row has left.

    ``times`` are distinct, ascending, and all of one band.
    """
    slot = times // width
    last = following(times, slot, width)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    return slot[heads], slot[last[heads]] + 1


def following(times: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
    """Per row the next row of its chain inside the band, or the row itself if the chain leaves."""
    after = np.searchsorted(times, times + width)
    here = np.arange(len(times))
    held = np.minimum(after, len(times) - 1)
    return np.where((after < len(times)) & (slot[held] == slot + 1), held, here)


def walk(bands: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Visits of the chain in order, as rows (place of the band, slot entered, slot left)."""
    visits, slot = [], min(int(slots[0]) for slots, _ in bands)
    while True:
        ahead = []
        for number, (slots, exits) in enumerate(bands):
            at = int(np.searchsorted(slots, slot))
            if at < len(slots) and slots[at] == slot:
                visits.append((number, slot, int(exits[at])))
                slot = int(exits[at])
        for slots, _ in bands:  # past the last band: the first slot after this one that has a row
            at = int(np.searchsorted(slots, slot + 1))
            if at < len(slots):
                ahead.append(int(slots[at]))
        # a band looked at before the chain came to ``slot`` may hold rows of it at smaller offsets only
        if not ahead:
            return np.array(visits, np.int64).reshape(-1, 3)
        slot = min(ahead)


def asked(visits: np.ndarray, slices: np.ndarray, slice_us: int, width: int) -> np.ndarray:
    """What to ask for the last accepted time before each slice: rows (band, slot entered, slot, slice).

    That is the row accepted in the slot that the slice starts in, if it comes before, or the one accepted before it.
    """
    slot = slices * slice_us // width
    out = []
    for wanted in (slot, slot - 1):
        at = np.searchsorted(visits[:, 1], wanted, side="right") - 1
        some = at >= 0
        at, reach = at[some], wanted[some]
        out.append(np.stack([
            visits[at, 0], visits[at, 1], np.minimum(reach, visits[at, 2] - 1), slices[some]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def chain_before_slices(
    rows: DataFrame, keys: Sequence[str], total: int, target_rows: int,
) -> DataFrame:
    """(keys, slice, us): the last accepted time before each slice, where there is one.

    ``rows`` has the keys and _us, _slice, _slice_us, _width (longs; a key has one window). Repeats of a time are
    dropped first, so a time shared by any number of rows counts once.
    """
    keys = list(keys)
    narrow = rows.select(*keys, "_us", "_slice", "_slice_us", "_width").dropDuplicates([*keys, "_us"])
    offset = F.pmod(F.col("_us"), F.col("_width"))
    # with few rows the session's number of partitions will do, and small ones may be put together
    parts = -(-total // target_rows)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = [parts] if parts > usual and target_rows >= FEW_ROWS else []
    ranged = narrow.withColumn("_offset", offset).repartitionByRange(*count, *[F.col(k) for k in keys], "_offset")
    banded = cut(ranged.withColumn(BAND, F.spark_partition_id()).drop("_offset").sortWithinPartitions(*keys, "_us"))
    fields = [banded.schema[k] for k in keys]
    long_list = T.ArrayType(T.LongType())
    summary_schema = T.StructType(fields + [
        T.StructField(BAND, T.IntegerType()), T.StructField("_width", T.LongType()),
        T.StructField("_slice_us", T.LongType()), T.StructField("_slots", long_list),
        T.StructField("_exits", long_list), T.StructField("_slices", long_list)])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, columns in groups_of(batches, [*keys, BAND], ["_us", "_slice", "_width", "_slice_us"]):
            times, slices, widths, slice_us = columns
            slots, exits = band_exits(times, int(widths[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], type=kind) for v, kind in head]
                + [pa.array([int(widths[0])]), pa.array([int(slice_us[0])])]
                + [one_list(a) for a in (slots, exits, np.unique(slices))], names=summary_schema.names)

    query_schema = T.StructType(fields + [
        T.StructField(BAND, T.IntegerType()), T.StructField("_entry", T.LongType()),
        T.StructField("_at", T.LongType()), T.StructField("_slice", T.LongType()),
        T.StructField("_width", T.LongType()), T.StructField("_slice_us", T.LongType())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, (bands, numbers, slices, width, slice_us) in whole_keys(batches, keys):
            found = asked(walk(bands), np.unique(np.concatenate(slices)), slice_us, width)
            count = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * count, type=kind) for v, kind in head]
                + [pa.array(np.array(numbers, np.int32)[found[:, 0]])]
                + [pa.array(found[:, k]) for k in (1, 2, 3)]
                + [pa.array(np.full(count, width)), pa.array(np.full(count, slice_us))], names=query_schema.names)

    summaries = banded.mapInArrow(summarise, summary_schema)
    queries = summaries.repartition(*keys).sortWithinPartitions(*keys, BAND).mapInArrow(compose, query_schema)
    # queries go to the task of their band and come before its rows
    blank = F.lit(None).cast("long")
    both = queries.select(*keys, BAND, F.lit(0).alias(KIND), "_entry", "_at", "_slice", "_width", "_slice_us",
                          blank.alias("_us")).unionByName(
        banded.select(*keys, BAND, F.lit(1).alias(KIND), blank.alias("_entry"), blank.alias("_at"),
                      blank.alias("_slice"), "_width", "_slice_us", "_us"))
    answer_schema = T.StructType(fields + [T.StructField("_slice", T.LongType()), T.StructField("_us", T.LongType())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [KIND, "_entry", "_at", "_slice", "_width", "_slice_us", "_us"]
        for head, columns in groups_of(batches, [*keys, BAND], names):
            kind, entry, at, number, width, slice_us, us = columns
            count = int((kind == 0).sum())
            if not count:
                continue
            times = us[count:]
            found = accepted_at(times, int(width[0]), entry[:count], at[:count])
            early = found < number[:count] * slice_us[:count]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * int(early.sum()), type=k) for v, k in head[:-1]]
                + [pa.array(number[:count][early]), pa.array(found[early])], names=answer_schema.names)

    answers = both.repartition(*keys, BAND).sortWithinPartitions(*keys, BAND, KIND, "_us").mapInArrow(
        answer, answer_schema)
    return answers.groupBy(*keys, "_slice").agg(F.max("_us").alias("_us"))


def accepted_at(times: np.ndarray, width: int, entry: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Accepted time in slot ``at`` of the chain that enters at the first row of slot ``entry``."""
    slot = times // width
    step = following(times, slot, width)
    out = np.zeros(len(entry), np.int64)
    for first in np.unique(entry).tolist():
        mine = np.flatnonzero(entry == first)
        mine = mine[np.argsort(at[mine])]
        row, reached = int(np.searchsorted(slot, first)), first
        for k in mine.tolist():
            while reached < at[k]:
                row, reached = int(step[row]), reached + 1
            out[k] = times[row]
    return out


def one_list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int64)))


def groups_of(batches, group: Sequence[str], columns: Sequence[str]):
    """Whole groups of sorted batches: (cells of the group, its columns as long arrays; nulls are 0)."""
    from embertide.operators.ordered import _group_bounds

    head, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = _group_bounds(batch, group)
        values = [batch.column(c).fill_null(0).to_numpy() for c in columns]
        for start, end in zip(bounds[:-1], bounds[1:]):
            cells = [(batch.column(c)[start].as_py(), batch.column(c).type) for c in group]
            if head is not None and [v for v, _ in cells] != [v for v, _ in head]:
                yield head, [np.concatenate(p) for p in zip(*parts)]
                parts = []
            head = cells
            parts.append([v[start:end] for v in values])
    if head is not None:
        yield head, [np.concatenate(p) for p in zip(*parts)]


def whole_keys(batches, keys: Sequence[str]):
    """Summaries of a key's bands, in their order: (cells, (bands, band numbers, slices, window, slice width))."""
    head, held = None, None
    for batch in batches:
        lists = [batch.column(c) for c in ("_slots", "_exits", "_slices")]
        for row in range(batch.num_rows):
            cells = [(batch.column(c)[row].as_py(), batch.column(c).type) for c in keys]
            if head is not None and [v for v, _ in cells] != [v for v, _ in head]:
                yield head, held
                held = None
            if held is None:
                held = ([], [], [], batch.column("_width")[row].as_py(), batch.column("_slice_us")[row].as_py())
            head = cells
            slots, exits, slices = [c[row].values.to_numpy() for c in lists]
            held[0].append((slots, exits))
            held[1].append(batch.column(BAND)[row].as_py())
            held[2].append(slices)
    if head is not None:
        yield head, held
