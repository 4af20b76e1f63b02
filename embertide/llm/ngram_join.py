"""N-gram Jaccard join by parity sketches (operator 1).

A document's shingles flip bits of a sketch: a bit is the parity of the shingles that hash
to it. Two sketches differ in at most as many bits as the sets have elements that only one
of them holds. For the sizes of a band that number is at most k when the sets link, so of
n blocks of the sketch n - k at least are equal. In an order of blocks that all documents
share, each then meets its partners on its first k + 1 blocks; the order begins with the
blocks that hold most shingles, on which unlike documents rarely agree. Pairs are then sifted
by the distance of their sketches and verified on their whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import (
    Stage, arrow_map, batch_rows, columns_of, mix, pieces, text_buffer, word_hashes,
)
from embertide.llm.graph import components
from embertide.session import checked_broadcast

SPARE = 4  # a band has one block in this many beyond those its largest sets need, to leave near-empty ones out
BAND_GROWTH = 1.5
CHUNK = 256  # members of a bucket that are compared with as many others at a time
FIRST = 8  # smallest buckets that a member knows of itself, to leave out pairs that meet in one of them
NEEDED_ROWS = 1_000_000  # ids (8 bytes) that may be broadcast to pick texts; beyond, the join shuffles
TEXT_BYTES = 1_000_000  # text whose words are hashed at a time, some 100 bytes of numbers for each byte
FULLEST = 255  # fuller blocks count as this full in the order


def shingles(raw: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted by row and hash, and their rows.

    With fewer words than ``words`` the whole sequence is the only shingle.
    """
    h, row = word_hashes(raw, bounds)
    n_rows = len(bounds) - 1
    counts = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(counts)
    left = ends[row] - np.arange(len(h))  # words from here to the end of the text
    short = (counts < words)[row]
    starts = np.flatnonzero((left >= words) | (short & (left == counts[row])))
    value = h[starts].copy()
    for j in range(1, words):
        further = left[starts] > j
        value[further] = mix(value[further] * np.uint64(0x9FB21C651E98DF25) + h[starts[further] + j])
    row = row[starts]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        value, row = value[new], row[new]
    return value, row


def band_edges() -> np.ndarray:
    """Band i holds sizes edges[i] to edges[i + 1] - 1."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_GROWTH)))
    return np.array(edges)


EDGES = band_edges()


def most_differing(size: np.ndarray, largest: np.ndarray, share: int) -> np.ndarray:
    """Elements that a set and a linked one of at most ``largest`` can differ in.

    Jaccard >= t means that |B| <= |A| / t and |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|).
    """
    return (size + np.minimum(largest, size * 100 // share)) * (100 - share) // (100 + share)


def n_blocks(band: np.ndarray, share: int) -> np.ndarray:
    """More blocks than linked sets of the band's sizes can differ in elements."""
    largest = EDGES[band + 1] - 1
    most = most_differing(largest, largest, share)
    return most + 1 + most // SPARE


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of the kept sketch: a power of two, at least 64 and at least twice the size."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))


def block_keys(value, row, size, share: int):
    """Keys of the blocks of every text in its own band, and in the bands its larger partners may be in.

    A block is so wide that every shingle has a bit of its own; its content is kept as the exclusive or
    of one hash per bit set. Equal blocks hold equally many shingles, so "fullest first, then by
    key" is one order for all texts of a band. A text that can differ from its partners in k
    elements shares n - k of n blocks with each, hence one of the first k + 1 of both. With k = 0 only
    equal sets link, which are one node already.
    """
    n_rows = len(size)
    band = np.searchsorted(EDGES, np.maximum(size, 1), side="right") - 1
    reach = np.searchsorted(EDGES, size * 100 // share, side="right") - 1
    bits = mix(value)
    keys, owner = [], []
    step = 0
    while (band + step <= reach).any():
        rows = np.flatnonzero((size > 0) & (band + step <= reach))
        differ = most_differing(size[rows], EDGES[band[rows] + step + 1] - 1, share)
        rows, differ = rows[differ > 0], differ[differ > 0]
        blocks = n_blocks(band[rows] + step, share)
        first = np.zeros(n_rows, np.int64)
        first[rows] = np.cumsum(blocks) - blocks
        per_row = np.zeros(n_rows, np.uint64)
        per_row[rows] = blocks
        mine = per_row[row] > 0
        v, r = value[mine], row[mine]
        place = first[r] + (((v >> np.uint64(32)) * per_row[r]) >> np.uint64(32)).astype(np.int64)
        total = int(blocks.sum())
        content = np.zeros(total, np.uint64)
        np.bitwise_xor.at(content, place, bits[mine])
        emptiness = FULLEST - np.minimum(np.bincount(place, minlength=total), FULLEST)
        own = np.repeat(np.arange(len(rows)), blocks)
        start = first[rows]
        at = (band[rows][own] + step).astype(np.uint64) << np.uint64(40) | (np.arange(total) - start[own]).astype(np.uint64)
        key = mix(content ^ mix(at + np.uint64(1)))
        order = np.lexsort((key, emptiness, own))
        chosen = order[np.arange(total) - start[own] <= differ[own]]
        keys.append(key[chosen])
        owner.append(rows[own[chosen]])
        step += 1
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int32)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(n_rows + 1)).astype(np.int32)


def sketches(value, row, size) -> list[bytes]:
    bits = sketch_bits(size)
    first = np.cumsum(bits) - bits
    flips = np.bincount(first[row] + (value & (bits[row] - 1).astype(np.uint64)).astype(np.int64),
                        minlength=int(bits.sum())) & 1
    data = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    return [data[f // 8:(f + b) // 8] for f, b in zip(first.tolist(), bits.tolist())]


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded, which never adds differences."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = 8 * len(a), 8 * len(b)
    while m > n:
        m //= 2
        x = (x >> m) ^ (x & ((1 << m) - 1))
    while n > m:
        n //= 2
        y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


PROFILE = "n long, f1 long, f2 long, keys array<long>, sketch binary"


def profiles(docs: DataFrame, words: int, share: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (shingles), f1 and f2 (128-bit sum of the set), block keys and sketch of every text."""
    rows = columns_of(docs, ("doc_id", F.col(doc_id)), ("text", F.col(text)))

    def kernel(batches):
        for batch in pieces(batches, limit=TEXT_BYTES):
            value, row = shingles(*text_buffer(batch.column(1)), words)
            size = np.bincount(row, minlength=batch.num_rows)
            sums = []
            for seed in (1, 2):
                total = np.zeros(batch.num_rows, np.uint64)
                np.add.at(total, row, mix(value + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))))
                sums.append(pa.array(total.view(np.int64)))
            keys, bounds = block_keys(value, row, size, share)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), *sums,
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.view(np.int64))),
                pa.array(sketches(value, row, size), pa.binary()),
            ], ["doc_id", "n", "f1", "f2", "keys", "sketch"])

    return arrow_map(rows, kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PROFILE}")


def close_pairs(pairs: DataFrame, profile: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    side = profile.select("doc_id", "n", "sketch")
    both = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = both.join(side.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = both.where(100 * F.least("na", "nb") >= share * F.greatest("na", "nb"))

    def kernel(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            most = sizes * (100 - share) // (100 + share)
            keep = [sketch_distance(x, y) <= d for x, y, d in zip(
                batch.column(3).to_pylist(), batch.column(5).to_pylist(), most.tolist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(both.select("a", "b", "na", "sa", "nb", "sb"), kernel, "a long, b long")


def open_pairs(members: DataFrame, profile: DataFrame, stage: Stage, share: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket, in different classes, whose sizes and sketches allow a link."""
    out = met_pairs(members, profile, stage, share).distinct()
    with batch_rows(members.sparkSession, 16):
        return stage.put(out, "open-pairs")


def met_pairs(members: DataFrame, profile: DataFrame, stage: Stage, share: int) -> DataFrame:
    """The pairs of ``open_pairs``, a few of them more than once.

    ``members``: bucket, id, class. A bucket's members are dealt to chunks of about CHUNK by a
    hash, and chunks are compared with chunks: only pairs that pass are ever made, however many
    unlike documents share a bucket. Near copies meet in up to k + 1 buckets. A pair is left out where both
    know of a smaller bucket that they share, by the FIRST smallest of each; in the smallest they share
    it never is.
    """
    side = profile.select(F.col("doc_id").alias("id"), "n", "sketch")
    never = F.array_repeat(F.lit((1 << 63) - 1).cast("long"), FIRST)
    first = F.slice(F.concat(F.sort_array(F.collect_set("bucket")), never), 1, FIRST)
    digits = F.array_join(F.transform(first, lambda b: F.lpad(F.hex(b), 16, "0")), "")
    known = members.groupBy("id").agg(F.unhex(digits).alias("first"))  # FIRST numbers of 8 bytes
    rows = stage.put(members.join(side, "id").join(known, "id"), "open-sketches")
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    chunks = rows.join(sizes, "bucket").withColumn("chunk", chunk).groupBy("bucket", "chunk", "chunks").agg(
        F.collect_list(F.struct("id", "class", "n", "sketch", "first")).alias("held"))
    chunks = stage.put(chunks, "open-chunks")
    later = chunks.select("bucket", F.col("chunk").alias("later"), F.col("held").alias("other"))
    tiles = chunks.join(later, "bucket").where("chunk <= later").select(
        "bucket", "held", "other")

    def parts(held):
        lengths = [len(r["sketch"]) for r in held]
        by = {}
        for k, n in enumerate(lengths):
            by.setdefault(n, []).append(k)
        facts = np.array([(r["id"], r["class"], r["n"]) for r in held], np.int64).reshape(-1, 3)
        first = np.frombuffer(b"".join(r["first"] for r in held), ">i8").astype(np.int64).reshape(-1, FIRST)
        facts = np.concatenate([facts, first], axis=1)
        return [(facts[own], np.frombuffer(b"".join(held[k]["sketch"] for k in own), np.uint64).reshape(len(own), -1))
                for _, own in sorted(by.items())]

    def folded(bits, width):
        while bits.shape[1] > width:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        return bits

    def kernel(batches):
        for batch in batches:
            for tile in batch.to_pylist():
                left, right = parts(tile["held"]), parts(tile["other"])
                found = []
                for fa, ba in left:
                    for fb, bb in right:
                        width = min(ba.shape[1], bb.shape[1])
                        xa, xb = folded(ba, width), folded(bb, width)
                        total = fa[:, 2][:, None] + fb[:, 2][None, :]
                        most = total * (100 - share) // (100 + share)
                        close = 100 * np.minimum(fa[:, 2][:, None], fb[:, 2][None, :]) >= share * np.maximum(
                            fa[:, 2][:, None], fb[:, 2][None, :])
                        close &= fa[:, 1][:, None] != fb[:, 1][None, :]
                        for low in range(0, len(fa), 32):
                            part = slice(low, low + 32)
                            differ = np.bitwise_count(xa[part, None, :] ^ xb[None, :, :]).sum(axis=2, dtype=np.int64)
                            i, j = np.nonzero(close[part] & (differ <= most[part]))
                            i += low
                            met = np.zeros(len(i), bool)
                            for k in range(3, 3 + FIRST):
                                own = fa[i, k]
                                met |= (own < tile["bucket"]) & (fb[j, 3:] == own[:, None]).any(axis=1)
                            found.append(np.stack([fa[i[~met], 0], fb[j[~met], 0]], axis=1))
                pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return arrow_map(tiles, kernel, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, stage: Stage, words: int, share: int) -> DataFrame:
    """Pairs (a, b) of ``pairs`` that link, by the shingles of both whole texts (columns doc_id, text)."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stage.put(docs.join(checked_broadcast(needed, NEEDED_ROWS), "doc_id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def kernel(batches):
        for whole in batches:
            for batch in pieces([whole], "ta", TEXT_BYTES):
                for part in pieces([batch], "tb", TEXT_BYTES):
                    n = part.num_rows
                    sets = [shingles(*text_buffer(part.column(i)), words) for i in (2, 3)]
                    code = np.concatenate([mix(v + mix(r.astype(np.uint64) + np.uint64(1))) for v, r in sets])
                    sizes = sum(np.bincount(r, minlength=n) for _, r in sets)
                    row = np.concatenate([r for _, r in sets])
                    order = np.argsort(code, kind="stable")
                    twice = np.flatnonzero(code[order][1:] == code[order][:-1])
                    common = np.bincount(row[order][twice], minlength=n)
                    yield part.select([0, 1]).filter(pa.array(100 * common >= share * (sizes - common)))

    return arrow_map(both, kernel, "a long, b long")


def jaccard_components(
    docs: DataFrame, words: int = 3, share: int = 90, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Classes of documents that links (Jaccard of word shingles >= ``share`` %) connect.

    Per input row: doc_id, n_shingles, component_id (smallest doc_id reachable, itself
    included), set_id (smallest doc_id with the same shingle set).

    1. Equal shingle sets (by a 128-bit sum) become one node.
    2. Nodes meet on equal sketch blocks. In each bucket all nodes are tested against its
       smallest, never against each other, so a bucket of any size gives as many pairs as nodes.
    3. Where a bucket still holds several classes, the sketches of nodes of different classes
       are compared chunk by chunk, and pairs that pass are tested, so that no link is lost.
       Members of one class need no test.

    Texts without words, null texts and null doc_ids link with nothing (n_shingles 0 for the
    first two). Rows repeated as a whole are in one class; rows that share a doc_id but not
    the text count as versions of one document. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession)
    rows = columns_of(docs, ("doc_id", F.col(doc_id).cast("long")), ("text", F.col(text)))
    full = stage.put(profiles(rows, words, share, "doc_id", "text"), "full")
    profile = stage.put(full.drop("keys"), "profiles")  # the keys are read twice, then they go
    real = profile.where("n > 0 and doc_id is not null")
    sets = stage.put(
        real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("rows")), "sets")
    version = ["doc_id", "f1", "f2", "n"]  # of an id that stands for several texts only the copies go
    copies = profile.join(sets.where("rows > 1").select("f1", "f2", "n", "set_id"), ["f1", "f2", "n"]).where(
        "n > 0 and doc_id is not null and doc_id <> set_id").select(*version).distinct()
    copies = stage.put(copies, "copies")
    nodes = full.where("n > 0 and doc_id is not null").join(
        checked_broadcast(copies, NEEDED_ROWS), version, "left_anti")

    places = nodes.select(F.col("doc_id").alias("id"), F.explode("keys").alias("bucket"))
    buckets = stage.put(
        places.groupBy("bucket").agg(
            F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1"),
        "buckets")
    stage.drop()  # the shuffle of all places goes before they move again
    shared = stage.put(places.join(
        checked_broadcast(buckets.where("nodes > 2").select("bucket", "low"), NEEDED_ROWS), "bucket"), "members")
    stage.drop("full", "copies")
    tested = stage.put(
        buckets.where("nodes = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(
            shared.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))).where("a <> b").distinct(),
        "tested")
    near = stage.put(close_pairs(tested, profile, share), "close")
    stage.drop("buckets")
    links = stage.put(verified(near, rows, stage, words, share), "links")
    stage.drop("close", "texts")
    known = stage.put(components(links, stage, "first"), "first-classes")

    classed = stage.put(
        shared.join(known, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("class")), "classed")
    mixed = classed.groupBy("bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1")
    open_ = stage.put(classed.join(mixed.select("bucket"), "bucket", "left_semi"), "open")
    stage.drop("members", "classed", "first-classes", "first-step")
    rest = stage.put(open_pairs(open_, profile, stage, share).join(tested, ["a", "b"], "left_anti"), "rest")
    stage.drop("open", "open-sketches", "open-chunks", "open-pairs", "tested")
    more = stage.put(verified(rest, rows, stage, words, share), "more-links")
    stage.drop("rest", "texts")
    final = components(links.unionByName(more), stage, "final")

    placed = profile.select("doc_id", "n", "f1", "f2").join(
        sets.select("f1", "f2", "n", "set_id"), ["f1", "f2", "n"], "left").join(
        final.withColumnRenamed("id", "set_id"), "set_id", "left")
    linked = F.col("n") > 0
    own = F.when(F.col("doc_id").isNotNull() & linked, F.col("set_id")).otherwise(F.col("doc_id"))
    out = stage.put(placed.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull() & linked, F.coalesce("component", "set_id")).otherwise(F.col("doc_id"))
        .alias("component_id"), own.alias("set_id")), "classes")
    stage.drop("profiles", "sets", "links", "more-links", "final-step")
    return out
