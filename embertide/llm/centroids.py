"""Centroid clustering over space-filling-curve zone maps (operator 13).

Vectors are put in the order of a Hilbert curve through the leading axes of their spread and cut into
blocks, each with the least and greatest value on every axis. A block needs to be compared with
those centroids only that may be nearest to some point of its box; the comparison itself is exact,
in integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import Stage, arrow_map, columns_of
from embertide.session import checked_broadcast

SCALE = 1024  # a component x becomes the integer floor(SCALE * x)
BLOCK = 256  # vectors of a block
CURVE_AXES, CURVE_BITS = 7, 8  # of the Hilbert curve: 56 bits, so a key is a positive long
SMALL = 1 << 27  # components below it: a squared distance of 64 components fits a long
LIMB, LIMBS, COUNT = 40, 32, -1  # sums travel in up to LIMBS parts of LIMB bits, enough for any double


# --- integers --------------------------------------------------------------------------


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: a long array, or Python integers where one is large."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if not y.size or np.abs(y).max() < SMALL:
        return y.astype(np.int64)
    # from 2**52 on a double is whole, and multiplying it as an integer cannot overflow
    whole = [int(v) * SCALE if abs(v) >= 2.0 ** 52 else math.floor(v * SCALE) for v in x.reshape(-1).tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return (gap * gap).sum(axis=1)


def settle(dtypes: list[np.ndarray]) -> list[np.ndarray]:
    """All arrays as Python integers if one has them, else unchanged."""
    wide = any(a.dtype == object for a in dtypes)
    return [a.astype(object) if wide else a for a in dtypes]


# --- the curve -------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2**bits (by exchanging and inverting
    lower bits from the highest bit down, then a Gray code across the axes)."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for axis in range(axes):
            inside = (x[:, axis] & q) != 0
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, axis]) & low)
            x[:, 0] ^= np.where(inside, low, swap)
            x[:, axis] ^= swap
        q >>= 1
    for axis in range(1, axes):
        x[:, axis] ^= x[:, axis - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | (x[:, axis] >> bit & 1)
    return key


def spread(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (rows, by falling variance) and standard deviations of all vectors.

    They choose the order of the vectors only, never a result, so doubles do. Tasks add up one
    matrix of dim * dim numbers each; large components are held back so that none overflows.
    """
    def kernel(batches):
        total, outer, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for batch in batches:
            x = np.clip(_doubles(batch.column(0), dim), -1e6, 1e6)
            total, outer, n = total + x.sum(axis=0), outer + x.T @ x, n + len(x)
        values = np.concatenate([[n], total, outer.reshape(-1)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["place", "value"])

    sums = arrow_map(vectors.select("x"), kernel, "place int, value double").groupBy("place").agg(
        F.sum("value").alias("value")).collect()  # dim * dim + dim + 1 rows
    flat = np.zeros(1 + dim + dim * dim)
    for r in sums:
        flat[r["place"]] = r["value"]
    n = max(flat[0], 1)
    mean = flat[1:1 + dim] / n
    matrix = flat[1 + dim:].reshape(dim, dim) / n - np.outer(mean, mean)
    variance, axes = np.linalg.eigh((matrix + matrix.T) / 2)
    return mean, axes.T[::-1], np.sqrt(np.maximum(variance[::-1], 1e-12))


def _doubles(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


# --- blocks ----------------------------------------------------------------------------


BLOCK_SCHEMA = "ids array<long>, points binary, low array<double>, high array<double>"


def blocks(vectors: DataFrame, dim: int, stage: Stage) -> DataFrame:
    """Vectors (id, x) along the curve, as staged blocks with their boxes.

    The boxes lie along the axes of the spread. Equal places on the curve are parted by a hash of the id,
    so copies of one vector spread over tasks.
    """
    mean, axes, deviation = spread(vectors, dim)
    used = min(CURVE_AXES, dim)

    def keyed(batches):
        for batch in batches:
            x = np.clip(_doubles(batch.column(1), dim), -1e6, 1e6)
            along = (x - mean) @ axes[:used].T / deviation[:used]
            cells = np.clip((along + 4) * (1 << CURVE_BITS) / 8, 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells))], ["id", "x", "place"])

    along = arrow_map(vectors.select("id", "x"), keyed, "id long, x array<double>, place long")
    ordered = along.repartitionByRange("place", F.xxhash64("id")).sortWithinPartitions("place", F.xxhash64("id"))

    def cut(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0), _doubles(batch.column(1), dim)))
            n += batch.num_rows
            if n >= BLOCK:
                yield from closed(held, False)
                tail = n % BLOCK
                ids, x = held[-1]
                held, n = ([(ids[len(ids) - tail:], x[len(x) - tail:])] if tail else []), tail
        if n:
            yield from closed(held, True)

    def closed(held, last):
        ids = pa.chunked_array([i for i, _ in held]).combine_chunks()
        x = np.concatenate([v for _, v in held])
        for start in range(0, len(x) if last else len(x) // BLOCK * BLOCK, BLOCK):
            part = x[start:start + BLOCK]
            turned = (part - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[start:start + BLOCK]], pa.list_(pa.int64())), pa.array([part.tobytes()], pa.binary()),
                pa.array([turned.min(axis=0)], pa.list_(pa.float64())),
                pa.array([turned.max(axis=0)], pa.list_(pa.float64()))], ["ids", "points", "low", "high"])

    held = stage.put(arrow_map(ordered.select("id", "x"), cut, BLOCK_SCHEMA), "blocks")
    return held, (mean, axes)


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box, ascending.

    A centroid goes when even its nearest point of the box is further off than the farthest point
    of the box is from some other centroid. Scaling down to integers moves a point by less than one
    unit on each axis, and doubles round; both are allowed for.
    """
    inside = np.maximum(np.maximum(low - centres, centres - high), 0)
    outside = np.maximum(np.abs(centres - low), np.abs(centres - high))
    slack = 2 * math.sqrt(len(low)) / SCALE + 1e-9 * (np.abs(low).max() + np.abs(high).max() + np.abs(centres).max())
    nearest = np.sqrt((inside ** 2).sum(axis=1)) - slack
    return np.flatnonzero(~(nearest > np.sqrt((outside ** 2).sum(axis=1)).min() + slack))


def assigner(centroids: list[list[int]], frame: tuple, dim: int):
    """A function from a block row to its integer points, their centroids and squared distances."""
    mean, axes = frame
    exact = np.array(centroids, dtype=object)
    if all(abs(v) < SMALL for c in centroids for v in c):
        exact = exact.astype(np.int64)
    with np.errstate(over="ignore"):
        centres = (np.array(centroids, dtype=np.float64) / SCALE - mean) @ axes.T

    def assign(points: bytes, low, high):
        x = scaled(np.frombuffer(points, np.float64).reshape(-1, dim))
        x, c = settle([x, exact])
        if dim > 64:  # more terms than a long is sure to hold
            x, c = x.astype(object), c.astype(object)
        able = candidates(np.array(low), np.array(high), centres)
        best = squared(x, c[able[0]])
        chosen = np.full(len(x), able[0])
        for k in able[1:]:
            other = squared(x, c[k])
            closer = other < best
            best, chosen = np.where(closer, other, best), np.where(closer, k, chosen)
        return x, chosen.astype(np.int64), best

    return assign


def means(held: DataFrame, centroids: list[list[int]], frame: tuple, dim: int) -> list[list[int]]:
    """One round: every vector to its nearest centroid, every centroid to the floor of its vectors' mean."""
    k = len(centroids)

    def kernel(batches):
        assign = assigner(centroids, frame, dim)
        sums, counts = np.zeros((k, dim), dtype=object), np.zeros(k, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                x, chosen, _ = assign(r["points"], r["low"], r["high"])
                for c in np.unique(chosen):
                    mine = chosen == c
                    counts[c] += int(mine.sum())
                    sums[c] += x[mine].sum(axis=0).astype(object)
        # limbs of LIMB bits by axis, so that Spark adds longs however large the sums are
        for c in np.flatnonzero(counts).tolist():
            places, values = [COUNT], [int(counts[c])]
            for axis, rest in enumerate(sums[c].tolist()):
                limb = 0
                while rest not in (0, -1):
                    places.append(axis * LIMBS + limb)
                    values.append(rest & ((1 << LIMB) - 1))
                    rest, limb = rest >> LIMB, limb + 1
                if rest:
                    places.append(axis * LIMBS + limb)
                    values.append(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(places), pa.int32()), pa.array(places, pa.int32()), pa.array(values, pa.int64())],
                ["c", "place", "value"])

    rows = arrow_map(held.select("points", "low", "high"), kernel, "c int, place int, value long")
    totals, count = {}, {}
    for r in rows.groupBy("c", "place").agg(F.sum("value").alias("value")).collect():  # some rows a centroid and axis
        if r["place"] == COUNT:
            count[r["c"]] = r["value"]
        else:
            axis, limb = divmod(r["place"], LIMBS)
            totals[r["c"], axis] = totals.get((r["c"], axis), 0) + (r["value"] << (LIMB * limb))
    return [[totals.get((c, axis), 0) // count[c] for axis in range(dim)] if c in count else centre
            for c, centre in enumerate(centroids)]


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose hash of seed and id is smallest; null ids come last, ties by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select("x", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return [[int(v) for v in scaled(np.array(r["x"]))] for r in first]


OUT_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """Every kept vector's cluster after ``rounds`` rounds of exact integer k-means.

    Kept are vectors of exactly ``dim`` components, none null, NaN or infinite; others give no row. Repeated rows
    count and are given as often as they occur, null ids too. With fewer than k vectors there are fewer
    centroids; an empty table gives no rows. Of equally near centroids the one of smaller number
    wins; a centroid that loses all its vectors stays. Distances and inertias are null where they exceed a long.
    """
    spark = vectors.sparkSession
    stage = Stage(spark)
    rows = columns_of(vectors, ("id", F.col(vec_id).cast("long")), ("x", F.col(embedding).cast("array<double>")))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where((F.size("x") == dim) & ~bad)
    centroids = starts(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], OUT_SCHEMA)
    held, frame = blocks(rows, dim, stage)
    for _ in range(rounds):
        moved = means(held, centroids, frame, dim)
        if moved == centroids:  # every further round would give the same
            break
        centroids = moved

    def kernel(batches):
        assign = assigner(centroids, frame, dim)
        for batch in batches:
            for r in batch.to_pylist():
                _, chosen, best = assign(r["points"], r["low"], r["high"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], pa.int64()), pa.array(chosen.astype(np.int32)),
                     pa.array([fit(d) for d in best.tolist()], pa.int64())], ["vec_id", "cluster", "distance"])

    found = stage.put(arrow_map(held, kernel, "vec_id long, cluster int, distance long"), "assigned")
    per = found.groupBy("cluster").agg(  # k rows
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    own = {r["cluster"]: None if r["beyond"] else int(r["own"]) for r in per.collect()}
    everything = None if None in own.values() else sum(own.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(c, fit(s), fit(everything), digests[c]) for c, s in own.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(checked_broadcast(facts, rows=len(own)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def fit(value: int | None) -> int | None:
    """The value if a long holds it."""
    return None if value is None or value >= 1 << 63 else value
