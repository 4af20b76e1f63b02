"""Helpers shared by the operators: staged tables, whole-text batches, word hashes, ranks."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embertide.session import shared_folder

# Fixed: a word is a run of anything but space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 4_000_000  # text handled at a time inside a task; a longer text is a piece of its own
BATCH_ROWS = 1000
LANE = 33  # monotonically_increasing_id keeps the row of a partition in its lowest 33 bits

_OPEN: dict[str, SparkSession] = {}


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library made, through Spark's own file system layer."""
    _OPEN.pop(path, None)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for path, spark in list(_OPEN.items()):
        try:
            drop_folder(spark, path)
        except Exception:  # the session has gone; the folder's owner cleans up
            _OPEN.pop(path, None)


atexit.register(_drop_all)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below ``spark.checkpoint.dir``, deleted when this process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _OPEN[path] = spark
    return path


CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """A write made within it removes its shuffle files as it ends.

    Else they wait for Spark's cleaner, which missed those of the last write: the shuffles of one step
    lay beside those of the next.
    """
    before = spark.conf.get(CLEANUP_SETTING)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


class Stage:
    """Tables written once to the shared folder, so that a lost executor costs one read.

    A staged table is read several times without running its input again, and its
    lineage ends at the files. ``drop`` removes one that is no longer needed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str, *by: str, codec: str = "zstd") -> DataFrame:
        path = new_folder(self.spark, name)
        writer = df.write.option("compression", codec)
        with shuffles_cleared(self.spark):
            (writer.partitionBy(*by) if by else writer).parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete staged tables, and let Spark clear the shuffle files of frames that are gone.

        Spark's cleaner only learns of these when both sides collect their garbage, which a
        driver with little to do rarely does by itself.
        """
        for name in names:
            for path in self.paths.pop(name, []):
                drop_folder(self.spark, path)
        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def only_result(spark: SparkSession, earlier: list[str]):
    """Within it, ``keep(df, name)`` stages a result; on leaving, all other folders made inside go, and the ``earlier``
    result, in whose place the new one is noted."""
    before, made = set(_OPEN), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        stage = Stage(spark)
        out = stage.put(df, name, codec="snappy")
        made.extend(stage.paths[name])
        return out

    yield keep
    for path in [p for p in _OPEN if p not in before and p not in made] + earlier:
        drop_folder(spark, path)
    earlier[:] = made


def columns_of(df: DataFrame, *named: tuple[str, Column]) -> DataFrame:
    """Only the named columns, so that other columns of any name cannot clash."""
    return df.select(*[column.alias(name) for name, column in named])


def pieces(batches, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, ends = text_buffer(column)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and each row's bounds.

    Row i is bytes bounds[i] to bounds[i + 1]; a null row is empty.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the multipliers are the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A fixed odd 64-bit number per byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
               + np.uint64(seed)) | np.uint64(1)


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        size = max(n + n // 4, 1 << 18)  # by what is asked for: a worker keeps these as long as it lives
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        held = np.cumprod(factors)
        if size <= 2 * PIECE_BYTES:
            _POWERS[int(base)] = held
    return held[:n]


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, bounds: np.ndarray):
    """Start and end of every word, and the index of its row."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, alike wherever the span stands."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_values(seed)[raw] * powers(len(raw), BASE), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(len(raw) + 1, BASE_INVERSE)[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, bounds: np.ndarray, seed: int = 0):
    """Hash of every lower-cased word (A-Z only), and the index of its row."""
    starts, ends, row = word_spans(raw, bounds)
    return span_hashes(lowered(raw), starts, ends, seed), row


def squeezed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: high bytes and runs of small steps cost next to nothing."""
    planes = np.empty((8, len(numbers)), np.uint8)
    for k in range(8):  # faster than a transposed copy
        planes[k] = np.asarray(numbers, np.uint64) >> np.uint64(8 * k)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def loosened(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8")


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, kernel: Callable, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with batches of at most ``rows`` rows, so that long texts stay bounded in a task.

    The setting is read when the frame runs: with other ``rows`` than the default, run it before the next is made.
    """
    df.sparkSession.conf.set(BATCH_SETTING, rows)
    return df.mapInArrow(kernel, schema)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Smaller batches for an action over rows that are large by design."""
    spark.conf.set(BATCH_SETTING, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def group_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def numbered(
    df: DataFrame, stage: Stage, order: list[str], within: str | None = None, name: str = "_slot",
    label: str = "order",
) -> DataFrame:
    """Rows in the total order ``order``, numbered from 0 (anew for each ``within``).

    A range partitioning sorts them, so no group ever meets in one task; ranks are a
    row's place in its partition plus what earlier partitions hold, which is one
    small row per partition and group. ``within`` must be the first of ``order``.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    held = stage.put(
        ranged.withColumns({
            "_part": F.shiftright(place, LANE).cast("int"), "_row": place.bitwiseAND((1 << LANE) - 1),
        }), label,
    )
    group = [within] if within else []
    sizes = held.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", *group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    return (
        held.join(starts, ["_part", *group])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_before"))
        .drop("_part", "_row", "_first", "_before")
    )
