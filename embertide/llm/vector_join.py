"""Embedding near-duplicates by a subspace pigeonhole join (operator 7).

Unit vectors with cosine >= c lie within a squared distance T = 2 - 2c. A rotation spreads
that over all coordinates; split into blocks, at least one block of a linked pair is
within its share of T, in proportion to its dimensions. Each block is range-joined on a
grid whose cells are as wide as the block's distance, and what meets is verified in
double precision on the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import Stage, arrow_map, batch_rows, columns_of
from embertide.llm.graph import components
from embertide.session import checked_broadcast

BLOCKS = 4
GRID = 2  # coordinates of a block that make its grid cell
CHUNK = 512  # vectors of a cell that one task holds at a time; larger cells are joined chunk by chunk
TILES = 16  # pairs of chunks in an Arrow batch
#: Of two neighbouring cells one offset only, so that every pair of cells meets once.
FORWARD = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
MARGIN = 1e-9


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random rotation: the same in every task and run."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:]))


def budgets(dim: int, cosine: float) -> list[float]:
    """Squared distance of each block: its share of the whole by dimensions."""
    return [(2 - 2 * cosine) * (b - a) / dim + MARGIN for a, b in block_bounds(dim)]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def normal_rows(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim and vec (little-endian doubles; null for vectors that link with nothing)."""
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def kernel(batches):
        for batch in batches:
            out = []
            for v, label, key in zip(batch.column(2).to_pylist(), batch.column(1), batch.column(0)):
                ok = v and label.is_valid and key.is_valid and None not in v
                x = np.array(v, "<f8") + 0.0 if ok else None  # -0.0 becomes 0.0
                out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) // 8 if x else 0 for x in out], pa.int32()),
                pa.array(out, pa.binary())], ["vec_id", "label", "dim", "vec"])

    return arrow_map(rows, kernel, f"vec_id {id_type}, label {label_type}, dim int, vec binary")


def block_cells(nodes: DataFrame, cosine: float) -> DataFrame:
    """Each node once per block with the grid cell of its block: node, label, dim, block, x, y, times, vec."""
    label_type = nodes.schema["label"].dataType.simpleString()

    def kernel(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            blobs = batch.column(4).to_pylist()
            for dim in np.unique(dims).tolist():
                pick = np.flatnonzero(dims == dim)
                vectors = np.frombuffer(b"".join(blobs[i] for i in pick), "<f8").reshape(len(pick), dim)
                turned = unit(vectors) @ rotation(dim)
                part = batch.take(pa.array(pick))
                for block, ((low, high), budget) in enumerate(zip(block_bounds(dim), budgets(dim, cosine))):
                    cell = np.zeros((len(pick), GRID), np.int32)
                    wide = min(GRID, high - low)
                    cell[:, :wide] = np.floor(turned[:, low:low + wide] / np.sqrt(budget))
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), part.column(1), part.column(2),
                        pa.array(np.full(len(pick), block, np.int32)), pa.array(cell[:, 0]), pa.array(cell[:, 1]),
                        part.column(3), part.column(4),
                    ], ["node", "label", "dim", "block", "x", "y", "times", "vec"])

    return arrow_map(nodes.select("node", "label", "dim", "times", "vec"), kernel,
                     f"node long, label {label_type}, dim int, block int, x int, y int, times long, vec binary")


def tile_links(a: np.ndarray, b: np.ndarray, block: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors for which ``block`` is the first block within its budget."""
    dim = a.shape[1]
    turn, bounds, most = rotation(dim), block_bounds(dim), budgets(dim, cosine)
    ua, ub = unit(a), unit(b)
    ta, tb = ua @ turn, ub @ turn
    low, high = bounds[block]
    x, y = ta[:, low:high], tb[:, low:high]
    near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= most[block]
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i):
        kept = np.einsum("ij,ij->i", a[i], b[j]) >= cosine * np.linalg.norm(a[i], axis=1) * np.linalg.norm(b[j], axis=1)
        i, j = i[kept], j[kept]
        for k in range(block):
            low, high = bounds[k]
            x, y = ta[i, low:high], tb[j, low:high]
            before = (x * x).sum(1) + (y * y).sum(1) - 2 * np.einsum("ij,ij->i", x, y) <= most[k]
            i, j = i[~before], j[~before]
    return i, j


def forest(i: np.ndarray, j: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
    """Smallest id each end reaches within the tile: enough links to keep what is connected connected."""
    la, lb = ids_a.copy(), ids_b.copy()
    while True:
        before = la.sum() + lb.sum()
        np.minimum.at(lb, j, la[i])
        np.minimum.at(la, i, lb[j])
        if la.sum() + lb.sum() == before:
            return la, lb


def joined_tiles(tiles: DataFrame, cosine: float) -> DataFrame:
    """Per tile and node with links: node, links (weighted by copies), other (a node it is connected with)."""
    def kernel(batches):
        for batch in batches:
            for tile in batch.to_pylist():
                dim, same = tile["dim"], tile["same"]
                sides = []
                for s in ("a", "b"):
                    held = tile[s]
                    sides.append((
                        np.array([r["node"] for r in held], np.int64), np.array([r["times"] for r in held], np.int64),
                        np.frombuffer(b"".join(r["vec"] for r in held), "<f8").reshape(len(held), dim)))
                (ids_a, times_a, a), (ids_b, times_b, b) = sides
                i, j = tile_links(a, b, tile["block"], cosine, same)
                if not len(i):
                    continue
                if same:
                    i, j = np.concatenate([i, j]), np.concatenate([j, i])
                la, lb = forest(i, j, ids_a, ids_b)
                out = [(ids_a, np.bincount(i, weights=times_b[j], minlength=len(ids_a)), la)]
                if not same:
                    out.append((ids_b, np.bincount(j, weights=times_a[i], minlength=len(ids_b)), lb))
                for ids, n, other in out:
                    used = n > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[used]), pa.array(n[used].astype(np.int64)), pa.array(other[used])],
                        ["node", "links", "other"])

    return arrow_map(tiles, kernel, "node long, links long, other long")


def near_vectors(
    rows: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """Links between vectors of equal label with cosine >= ``cosine``.

    Per input row: vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable, itself included), kept (vec_id = component_id).

    Equal vectors become one node with a count. A cell's nodes are dealt to chunks of about
    CHUNK by a hash, so a cell of any size is joined chunk by chunk; a tile hands on one row
    per node with its number of links and one connection, never the pairs.

    Null labels, null ids, and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Vectors of different length never link. Repeated rows are
    vectors of their own that link. An empty table gives no rows.
    """
    spark = rows.sparkSession
    stage = Stage(spark)
    base = stage.put(normal_rows(columns_of(
        rows, ("vec_id", F.col(vec_id).cast("long")), ("label", F.col(label)), ("v", F.col(vector)))), "vectors")
    key = ["label", "dim", "vec"]
    nodes = stage.put(
        base.where("vec is not null").groupBy(*key).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("times")),
        "nodes")
    cells = stage.put(block_cells(nodes, cosine), "cells")
    place = ["label", "dim", "block", "x", "y"]
    sizes = cells.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = cells.join(checked_broadcast(sizes, 100_000), place)
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    chunks = stage.put(
        dealt.withColumn("chunk", chunk).groupBy(*place, "chunk").agg(
            F.collect_list(F.struct("node", "times", "vec")).alias("held")), "chunks")
    offsets = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in FORWARD]))
    ahead = chunks.withColumn("o", offsets).select(
        "label", "dim", "block", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"),
        F.col("chunk").alias("chunk_b"), F.col("held").alias("b"),
        ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("home"))
    tiles = chunks.withColumnRenamed("held", "a").join(ahead, place).where(
        ~F.col("home") | (F.col("chunk") <= F.col("chunk_b")))
    tiles = tiles.select("dim", "block", (F.col("home") & (F.col("chunk") == F.col("chunk_b"))).alias("same"), "a", "b")
    joined = joined_tiles(tiles, cosine)
    with batch_rows(spark, TILES):
        found = stage.put(joined, "found")
    stage.drop("cells", "chunks")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), stage)
    marked = nodes.join(links, "node", "left").join(classes.withColumnRenamed("id", "node"), "node", "left").select(
        *key, "node", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    out = base.join(marked, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("links") + F.col("times") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
