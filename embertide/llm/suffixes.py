"""Suffix-array dedup by a distributed difference-cover sort (operator 3).

Finds every byte that a string of LENGTH bytes covers which starts anywhere else too.

The cover is {1, 2} modulo 3: two suffixes always reach sampled places together after 0,
1 or 2 bytes. Sampled suffixes are sorted by triples of 8-byte words and named by rank;
the sort recurses on triples of names (24, 72, then 198 bytes). As a question about
LENGTH bytes needs the order of no longer prefixes, the recursion ends there. Remaining
suffixes are merged by one or two leading bytes and a sampled name, and neighbours with
equal prefixes are repeats.

Two exact reductions come first. Equal texts, and equal regions of texts, enter the sort
once, with their count. And a place whose smallest 100-byte hash occurs once in the whole
corpus cannot repeat, so only regions with repeated minimizers are sorted at all. Regions
that share text mostly come to one chunk, which sends what they share once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import (
    BASE, BASE_INVERSE, Stage, arrow_map, batch_rows, byte_values, columns_of, loosened, mix, pieces, powers, squeezed,
    steps, text_buffer,
)
from embertide.llm.lm import Sums
from embertide.session import checked_broadcast

LENGTH = 200
GRAM = 100  # bytes of a minimizer; a LENGTH window holds LENGTH - GRAM + 1 of them
SPANS = (24, 72, 198)  # bytes that names cover after each sort; all but the last shift by multiples of 3
SHIFTS = ((0, 8, 16), (0, 24, 48), (0, 72, 126))  # where the parts of a triple begin
RANK_BITS, MAX_BUCKETS = 34, 4096
TEXT_BYTES = 1_000_000  # text that is hashed at a time; a longer text is a piece of its own
CHUNK_BYTES = 1_000_000  # text of one row of the sort; a longer region is a row of its own
BUCKET_BYTES = 2_000_000  # sampled text that one bucket of the sort takes, about
HELD_MINIMIZERS = 4_000_000  # repeated minimizers (8 bytes each) that are broadcast; beyond, they are joined
NEEDED_ROWS = 1_000_000
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- minimizers ------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, bounds: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Hash of the GRAM bytes from each place; the largest value where they leave the text.

    ``step`` places at a time stay in the cache.
    """
    n = len(raw)
    out = np.empty(n, np.uint64)
    out[max(0, n - GRAM + 1):] = TOP
    values = byte_values(5)
    for start in range(0, n - GRAM + 1, step):
        part = raw[start:start + step + GRAM - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values.take(part, mode="clip") * powers(len(part), BASE), out=sums[1:])
        own = sums[GRAM:] - sums[:-GRAM]
        own *= powers(len(own), BASE_INVERSE)
        out[start:start + len(own)] = mix(own) >> np.uint64(1)
    for k in bounds[1:].tolist():
        out[max(0, k - GRAM + 1):k] = TOP
    return out


def sliding(values: np.ndarray, width: int, ufunc, fill, step: int = 1 << 15) -> np.ndarray:
    """ufunc (least or largest) over values[i] to values[i + width - 1], for every i; ``fill`` stands beyond the end.

    Spans double until two of them, which may overlap, cover the width; ``step`` values at a time stay in the cache.
    """
    padded = np.concatenate([values, np.full(width - 1, fill, values.dtype)])
    out = np.empty(len(values), values.dtype)
    for start in range(0, len(values), step):
        part, span = padded[start:start + step + width - 1], 1
        while 2 * span <= width:
            part = ufunc(part[:-span], part[span:])
            span *= 2
        if span < width:
            part = ufunc(part[:span - width], part[width - span:])
        out[start:start + step] = part
    return out


def window_minimizers(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, smallest gram hash of each LENGTH window (0 where none starts), and valid starts."""
    grams = gram_hashes(raw, bounds)
    valid = np.zeros(len(raw), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= LENGTH:
            valid[a:b - LENGTH + 1] = True
    smallest = sliding(grams, LENGTH - GRAM + 1, np.minimum, TOP)
    return grams, np.where(valid, smallest, np.uint64(0)), valid


def minimizer_counts(texts: DataFrame) -> DataFrame:
    """(gram, n): occurrences of grams that are smallest of some window; tasks add up first."""
    def kernel(batches):
        sums = Sums()

        def out():
            code, n = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

        for batch in pieces(batches, limit=TEXT_BYTES):
            grams, smallest, _ = window_minimizers(*text_buffer(batch.column(0)))
            # a gram is chosen if it is smallest in one of the windows that hold it
            width = LENGTH - GRAM + 1
            chosen = sliding(smallest[::-1], width, np.maximum, np.uint64(0))[::-1] == grams
            if sums.add(grams[chosen & (grams != TOP)]):
                yield out()
        yield out()

    return arrow_map(texts.select("text"), kernel, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


REGION = "h string, at long, key binary, least long, n_bytes long, body binary"


def _regions(flags: np.ndarray, bounds: np.ndarray, raw: np.ndarray, smallest: np.ndarray):
    """(row, place in the row, least hash, bytes) of each run of flagged starts, with the LENGTH bytes of its last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    low, high = edge[::2], edge[1::2]  # starts low to high - 1
    row = np.searchsorted(bounds, low, side="right") - 1
    data = raw.tobytes()
    for a, b, r in zip(low.tolist(), high.tolist(), row.tolist()):
        yield r, a - int(bounds[r]), int(smallest[a:b].min()), data[a:b - 1 + LENGTH]


def _region_batch(rows) -> pa.RecordBatch:
    h, at, least, body = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(h, pa.string()), pa.array(at, pa.int64()),
        pa.array([hashlib.blake2b(b, digest_size=16).digest() for b in body], pa.binary()), pa.array(least, pa.int64()),
        pa.array([len(b) for b in body], pa.int64()), pa.array(body, pa.binary())],
        ["h", "at", "key", "least", "n_bytes", "body"])


def repeated_regions(texts: DataFrame, repeated: DataFrame, n_repeated: int) -> DataFrame:
    """Regions of texts (h, text) whose windows have a repeated minimizer: h, at, key, least, n_bytes, body."""
    held = grams = None
    if n_repeated <= HELD_MINIMIZERS:
        found = np.sort(repeated.select("gram").toArrow().column("gram").to_numpy().view(np.uint64))
        held = texts.sparkSession.sparkContext.broadcast(found)
    else:  # which minimizers of each text are repeated, by a join on the minimizer
        def own(batches):
            for batch in pieces(batches, "text", TEXT_BYTES):
                raw, bounds = text_buffer(batch.column(1))
                _, smallest, _ = window_minimizers(raw, bounds)
                row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                new = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]) & (smallest != 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[new])), pa.array(smallest[new].view(np.int64))], ["h", "gram"])

        grams = arrow_map(texts.select("h", "text"), own, "h string, gram long").distinct()
        grams = grams.join(repeated.select("gram"), "gram").groupBy("h").agg(F.collect_set("gram").alias("grams"))
        texts = texts.join(grams, "h")

    def kernel(batches):
        rows, size = [], 0
        for batch in pieces(batches, "text", TEXT_BYTES):
            raw, bounds = text_buffer(batch.column(1))
            _, smallest, valid = window_minimizers(raw, bounds)
            new = np.flatnonzero(changes(smallest))
            values = smallest[new]
            wanted = held.value if held else np.unique(batch.column(2).flatten().to_numpy().view(np.uint64))
            order = np.argsort(values)  # ascending values find their places near one another
            place = np.empty(len(values), np.int64)
            place[order] = np.searchsorted(wanted, values[order])
            place[place == len(wanted)] = 0
            hit = wanted[place] == values if len(wanted) else np.zeros(len(values), bool)
            flags = np.repeat(hit, np.diff(new, append=len(raw))) & valid
            names = batch.column(0).to_pylist()
            # a start that follows the last one of another text never continues its run, as LENGTH > 1
            for r, at, least, body in _regions(flags, bounds, raw, smallest):
                rows.append((names[r], at, least, body))
                size += len(body)
                if size > 2_000_000:
                    yield _region_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _region_batch(rows)

    return arrow_map(texts.select("h", "text", *(["grams"] if grams is not None else [])), kernel, REGION)


# --- the sort --------------------------------------------------------------------------

CHUNK = "chunk long, body binary, sizes binary, keys binary, counts binary"


def gathered(regions: DataFrame) -> DataFrame:
    """Regions (key, body, n), those with the same least gram hash side by side, equal ones in succession.

    Such regions mostly share text, so a chunk holds fewer distinct triples. Many regions of one hash are parted by
    key; tasks add up equal regions first.
    """
    def kernel(batches):
        held, size = {}, 0

        def out():
            return pa.RecordBatch.from_arrays([
                pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()),
                pa.array([v[1] for v in held.values()], pa.binary()), pa.array([v[2] for v in held.values()], pa.int64())],
                ["key", "least", "body", "n"])

        for batch in batches:
            for key, least, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key in held:
                    held[key][2] += 1
                    continue
                held[key] = [least, body, 1]
                size += len(body)
                if size > 4 * CHUNK_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    summed = arrow_map(regions.select("key", "least", "body"), kernel, "key binary, least long, body binary, n long")
    return summed.repartitionByRange("least", "key").sortWithinPartitions("least", "key")


def packed(regions: DataFrame) -> DataFrame:
    """Regions (key, body, n) side by side in rows of about CHUNK_BYTES; equal ones that follow each other are one."""
    def kernel(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            keys, bodies, counts = zip(*held)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | seq], pa.int64()), pa.array([b"".join(bodies)], pa.binary()),
                pa.array([np.array([len(b) for b in bodies], "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(keys)], pa.binary()), pa.array([np.array(counts, "<i8").tobytes()], pa.binary()),
            ], ["chunk", "body", "sizes", "keys", "counts"])

        for batch in batches:
            for key, body, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and held[-1][0] == key:
                    held[-1][2] += n
                    continue
                if size >= CHUNK_BYTES:
                    yield out()
                    held, size, seq = [], 0, seq + 1
                held.append([key, body, n])
                size += len(body)
        if held:
            yield out()

    return arrow_map(regions.select("key", "body", "n"), kernel, CHUNK)


def sampled_places(sizes: np.ndarray, span: int) -> np.ndarray:
    """Places 1 and 2 modulo 3 of each region from which ``span`` bytes stay inside it."""
    local = places(sizes)
    inside = np.repeat(np.maximum(sizes - span + 1, 0).astype(np.uint32), sizes)
    return np.flatnonzero((local % np.uint32(3) != 0) & (local < inside))


def places(sizes: np.ndarray) -> np.ndarray:
    """Place in its region of each byte; 32 bits do, as a row of a table holds less than 2 GB."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.uint32) - np.repeat(starts.astype(np.uint32), sizes)


def words_at(body: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number, in byte order; zeros beyond the end."""
    out = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):  # k bytes become 2 k
        out = (out[:-k] << np.uint64(8 * k)) | out[k:]
    return out[:len(body)]


def ascending(key: np.ndarray) -> np.ndarray:
    """Order of the rows by key. Where a row's place fits below the key's range, a plain sort of both does it, which
    is faster than ``argsort``."""
    low, high = (key.min(), key.max()) if len(key) else (0, 0)
    bits = int(high - low).bit_length()
    if not 0 < bits < 64 or len(key) >> (64 - bits):
        return np.argsort(key)
    room = np.uint64(64 - bits)
    both = (key - low).astype(np.uint64) << room | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & ((np.uint64(1) << room) - np.uint64(1))).view(np.int64)


def distinct_rows(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and for each row in that order the number of its distinct value.

    A key is looked at only where all keys before it tie. Equal rows stand in any order.
    """
    order = ascending(keys[0])
    new = changes(keys[0][order])
    for key in keys[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        values = key[rows]
        by = ascending(values)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(changes(values[by]))
        code = np.cumsum(new[at]) * (len(at) + 1) + rank  # group of ties, then key
        by = ascending(code)
        order[at] = rows[by]
        new[at] = changes(code[by])
    return order, np.cumsum(new) - 1


def changes(ordered: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it; the first does."""
    out = np.ones(len(ordered), bool)
    out[1:] = ordered[1:] != ordered[:-1]
    return out


def answered(row) -> tuple[np.ndarray, np.ndarray]:
    """The number within the chunk that each sampled place had in the sort before, and the names by number.

    Numbers order the triples of a chunk as names do.
    """
    parts = sorted(row["answer"], key=lambda r: r["bucket"])
    names = [np.cumsum(loosened(r["ranks"])) for r in parts[1:]]
    return loosened(parts[0]["ranks"]), np.concatenate([np.zeros(0, np.uint64), *names])


def numbered_chunk(row, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, region sizes, the number at each place that the sort before sampled (else 0), and the names by number."""
    body, sizes = np.frombuffer(row["body"], np.uint8), np.frombuffer(row["sizes"], "<i8")
    number, names = answered(row)
    local = np.zeros(len(body), np.uint64)
    local[sampled_places(sizes, SPANS[level - 1])] = number
    return body, sizes, local, names


def chunk_arrays(row, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Text, region sizes, and the name at each sampled place of the level before."""
    if not level:
        return np.frombuffer(row["body"], np.uint8), np.frombuffer(row["sizes"], "<i8"), None
    body, sizes, local, names = numbered_chunk(row, level)
    out, at = np.zeros(len(body), np.uint64), sampled_places(sizes, SPANS[level - 1])
    out[at] = names[local[at]]
    return body, sizes, out


def distinct_triples(row, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number within the chunk of the triple at each sampled place, and the parts of the distinct triples in order."""
    if level:
        body, sizes, local, names = numbered_chunk(row, level)
    else:  # the words of the chunk are numbered first
        body, sizes, _ = chunk_arrays(row, 0)
        words = words_at(body)
        order, number = distinct_rows([words])
        local = np.empty(len(body), np.uint64)
        local[order] = number
        names = words[order[np.flatnonzero(changes(number))]]
    at = sampled_places(sizes, SPANS[level])
    parts = [local[at + s] for s in SHIFTS[level]]
    bits = len(names).bit_length()
    if 3 * bits > 64:
        order, number = distinct_rows(parts)
    else:  # the numbers of all parts are one key
        order, number = distinct_rows([parts[0] << np.uint64(2 * bits) | parts[1] << np.uint64(bits) | parts[2]])
    first = order[np.flatnonzero(changes(number))]
    which = np.empty(len(order), np.uint64)
    which[order] = number
    return which, [names[p[first]] for p in parts]


def splitters(chunks: DataFrame, buckets: int) -> np.ndarray:
    """First words that part the sampled suffixes into about equal buckets, from a distributed sketch."""
    def kernel(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body, sizes, _ = chunk_arrays(row, 0)
                at = sampled_places(sizes, SPANS[0])
                first = np.sort(words_at(body)[at])[::251]
                yield pa.RecordBatch.from_pydict({"w": first.astype(np.float64)})

    points = [i / buckets for i in range(1, buckets)]
    sample = arrow_map(chunks.select("body", "sizes"), kernel, "w double")
    found = sample.agg(F.percentile_approx("w", points, 10_000).alias("p")).first()["p"] if points else []
    return np.array([int(x) for x in found or []], dtype=np.uint64)


def sorted_names(
    chunks: DataFrame, level: int, cuts: np.ndarray, stage: Stage, bare: DataFrame | None = None,
) -> DataFrame:
    """Chunks with the rank name of every sampled place after sorting the triples of this level.

    A chunk sends each distinct triple once to the bucket of its first part; buckets sort and
    number what they get and send the ranks back, in the order the chunk sent them. Ranks are
    bucket and place in the bucket, so they order all triples. What the chunk knows of its own
    order travels beside, in a bucket below 0, so that it is sorted once.

    ``bare``: the same chunks without names, where they can be read by themselves.
    """
    fields = ["body", "sizes"] + (["answer"] if level else [])
    own_buckets = max(1, (len(cuts) + 1) // 4)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                which, keys = distinct_triples(row, level)
                bucket = (np.searchsorted(cuts, keys[0], side="right") if level == 0
                          else (keys[0] >> np.uint64(RANK_BITS)).astype(np.int64))
                own = (row["chunk"] >> 32) * 1_000_003 + (row["chunk"] & 0xFFFFFFFF)
                yield sent_batch(-1 - own % own_buckets, row["chunk"], squeezed(which))
                for b, low, high in bucket_runs(bucket):
                    blob = squeezed(np.concatenate([steps(keys[0][low:high]), keys[1][low:high], keys[2][low:high]]))
                    yield sent_batch(b, row["chunk"], blob)

    def number(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table.select(["chunk", "bucket", "keys"]).rename_columns(["chunk", "bucket", "ranks"])
        blobs = [loosened(b).reshape(3, -1) for b in table.column("keys").to_pylist()]
        keys = np.concatenate([np.vstack([np.cumsum(b[:1], axis=1), b[1:]]) for b in blobs], axis=1)
        order, rank = distinct_rows(list(keys))
        names = np.empty(len(order), np.uint64)
        names[order] = rank.astype(np.uint64) | np.uint64(bucket << RANK_BITS)
        ends = np.cumsum([b.shape[1] for b in blobs])
        return pa.table({
            "chunk": table.column("chunk"), "bucket": table.column("bucket"),
            "ranks": pa.array([squeezed(steps(names[e - b.shape[1]:e])) for e, b in zip(ends.tolist(), blobs)],
                              pa.binary())})

    with batch_rows(chunks.sparkSession, 4):
        sent = arrow_map(chunks.select("chunk", *fields), send, SENT)
        ranked = sent.groupBy("bucket").applyInArrow(number, "chunk long, bucket int, ranks binary")
        ranked = stage.put(ranked, f"ranks{level}")
    answers = ranked.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ranks")).alias("answer"))
    return (bare or chunks.drop("answer")).join(answers, "chunk")


SENT = "bucket int, chunk long, keys binary"


def sent_batch(bucket: int, chunk: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())],
        ["bucket", "chunk", "keys"])


def bucket_runs(bucket: np.ndarray):
    """(bucket, low, high) of each run of equal buckets."""
    edge = np.flatnonzero(changes(bucket)).tolist()
    for low, high in zip(edge, [*edge[1:], len(bucket)]):
        yield int(bucket[low]), low, high


def merge_keys(body: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of every start in the two merged orders it belongs to.

    With name(i) standing for the SPANS[-1] bytes from a sampled place i:
    order 0 joins residues 0 and 1 by byte i, name(i + 1), byte i + 199;
    order 1 joins residues 0 and 2 by bytes i and i + 1, name(i + 2);
    order 2 joins residues 1 and 2 by name(i), bytes i + 198 and i + 199.
    """
    local = places(sizes)
    start = np.flatnonzero(local < np.repeat(np.maximum(sizes - LENGTH + 1, 0).astype(np.uint32), sizes))
    residue = local[start] % np.uint32(3)
    span = SPANS[-1]
    wide = body.astype(np.uint64)
    out_at, out_key = [], []
    for order, (skip, shift, first, second) in enumerate(((2, 1, 0, span + 1), (1, 2, 0, 1), (0, 0, span, span + 1))):
        i = start[residue != skip]
        key = (np.uint64(order) << np.uint64(62)) | (names[i + shift] << np.uint64(16))
        out_at.append(i)
        out_key.append(key | (wide[i + first] << np.uint64(8)) | wide[i + second])
    return np.concatenate(out_at), np.concatenate(out_key)


def repeated_runs(chunks: DataFrame, stage: Stage) -> DataFrame:
    """key, low, high: runs of starts of each region whose LENGTH bytes occur again."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body, sizes, local, names = numbered_chunk(row, len(SPANS))
                _, key = merge_keys(body, sizes, local)
                key.sort()
                distinct = key[changes(key)]
                # names for numbers; both are in the same order
                bits = np.uint64((1 << 62) - (1 << 16))
                distinct = distinct & ~bits | names[(distinct & bits) >> np.uint64(16)] << np.uint64(16)
                for b, low, high in bucket_runs((distinct >> np.uint64(16 + RANK_BITS)).astype(np.int64)):
                    yield sent_batch(b, row["chunk"], squeezed(steps(distinct[low:high])))

    def compare(table: pa.Table) -> pa.Table:
        blobs = [np.cumsum(loosened(b)) for b in table.column("keys").to_pylist()]
        keys = np.concatenate(blobs)
        order = ascending(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        ends = np.cumsum([len(b) for b in blobs])
        return pa.table({
            "chunk": table.column("chunk"), "bucket": table.column("bucket"),
            "again": pa.array([again[e - len(b):e].astype(np.uint8).tobytes() for e, b in zip(ends.tolist(), blobs)],
                              pa.binary())})

    def receive(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body, sizes, local, names = numbered_chunk(row, len(SPANS))
                at, key = merge_keys(body, sizes, local)
                bits = len(names).bit_length() + 16  # below the order, of 2 bits
                # without the empty bits between
                order, number = distinct_rows([key >> np.uint64(62) << np.uint64(bits) | key & np.uint64((1 << bits) - 1)])
                times = np.diff(np.flatnonzero(changes(number)), append=len(order))
                parts = sorted(row["met"], key=lambda r: r["bucket"])
                again = np.frombuffer(b"".join(r["again"] for r in parts), np.uint8).astype(bool)
                again = again | (times > 1)  # twice in the chunk itself
                flags = np.zeros(len(body) + 1, np.int8)
                flags[at[order[np.repeat(again, times)]]] = 1
                starts = np.cumsum(sizes) - sizes
                for s, n, c in zip(starts.tolist(), sizes.tolist(), np.frombuffer(row["counts"], "<i8").tolist()):
                    if c > 1:  # the region as a whole occurs again
                        flags[s:s + n - LENGTH + 1] = 1
                edge = np.flatnonzero(np.diff(flags, prepend=0))
                low, high = edge[::2], edge[1::2]
                region = np.searchsorted(starts, low, side="right") - 1
                keys = [row["keys"][16 * r:16 * r + 16] for r in region.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.binary()), pa.array(low - starts[region]), pa.array(high - 1 - starts[region])],
                    ["key", "low", "high"])

    with batch_rows(chunks.sparkSession, 4):
        sent = arrow_map(chunks.select("chunk", "body", "sizes", "answer"), send, SENT)
        met = stage.put(sent.groupBy("bucket").applyInArrow(compare, "chunk long, bucket int, again binary"), "met")
        answers = met.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "again")).alias("met"))
        joined = chunks.join(answers, "chunk")
        runs = stage.put(arrow_map(joined, receive, "key binary, low long, high long"), "runs")
    stage.drop("met")
    return runs


# --- texts -----------------------------------------------------------------------------


def cleaned(texts: DataFrame) -> DataFrame:
    """h, n_removed, n_spans, kept_sha256 of texts (h, text, runs: starts low to high that repeat)."""
    def kernel(batches):
        for batch in pieces(batches, "text"):
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                digest, at, removed, spans = hashlib.sha256(), 0, 0, 0
                end = -1
                for low, high in sorted((r["low"], r["high"] + LENGTH) for r in runs):
                    if low > end:  # touching runs are one span
                        spans += 1
                        digest.update(data[at:low])
                        begin = low
                    else:
                        begin = at
                    if high > begin:
                        removed += high - begin
                        at = end = max(high, at)
                digest.update(data[at:])
                out.append((removed, spans, digest.hexdigest()))
            removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)],
                ["h", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(texts.select("h", "text", "runs"), kernel,
                     "h string, n_removed long, n_spans long, kept_sha256 string")


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What is left of each text without the bytes that repeated strings of LENGTH bytes cover.

    Per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (of the other bytes in order). A string repeats if it starts at any other place of any
    text, in overlap too; all are judged on the input. Matches never cross texts.

    Null texts are empty. Texts shorter than LENGTH lose nothing. Repeated rows are copies, so
    they lose everything if they have LENGTH bytes. A null doc_id is kept. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = columns_of(docs, ("doc_id", F.col(doc_id)), ("text", body), ("h", F.md5(body)))
    facts = stage.put(rows.select(
        "doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "facts")
    groups = stage.put(
        facts.where(F.col("n_bytes") >= LENGTH).groupBy("h").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "groups")
    copies = facts.join(groups, "h").where("doc_id <> first").select("doc_id", "h").distinct()
    copies = stage.put(copies, "copies")
    long_ = rows.where(F.octet_length("text") >= LENGTH)
    texts = long_.join(checked_broadcast(copies, NEEDED_ROWS), ["doc_id", "h"], "left_anti").select("h", "text")

    repeated = stage.put(minimizer_counts(texts).where("n > 1"), "minimizers")
    regions = stage.put(repeated_regions(texts, repeated, repeated.count()), "regions")
    stage.drop("minimizers")
    with batch_rows(spark, 1000):
        # read at every level, and split into tasks by its size as written
        chunks = stage.put(packed(gathered(regions)), "chunks", codec="uncompressed")
    total = regions.agg(F.sum("n_bytes")).first()[0]
    if total:
        buckets = int(min(MAX_BUCKETS - 1, max(24, total // BUCKET_BYTES)))
        with batch_rows(spark, 4):
            cuts = splitters(chunks, buckets)
        named = chunks
        for level in range(len(SPANS)):
            named = sorted_names(named, level, cuts, stage, chunks)
            stage.drop(f"ranks{level - 1}")
        runs = repeated_runs(named, stage)
        stage.drop(f"ranks{len(SPANS) - 1}", "chunks")
    else:
        runs = spark.createDataFrame([], "key binary, low long, high long")
    by_text = regions.select("h", "at", "key").join(runs, "key").select(
        "h", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))
    by_text = by_text.join(groups.select("h"), "h", "left_anti")  # copies go as a whole
    by_text = stage.put(by_text.groupBy("h").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "by-text")
    stage.drop("regions")
    touched = long_.select("h", "text").join(checked_broadcast(by_text.select("h"), NEEDED_ROWS // 4), "h", "left_semi")
    partial = cleaned(touched.join(by_text, "h"))
    empty = hashlib.sha256(b"").hexdigest()
    partial = stage.put(partial.distinct(), "partial").withColumn("whole", F.lit(False))
    whole = groups.select("h", F.lit(0).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                          F.lit(empty).alias("kept_sha256"), F.lit(True).alias("whole"))
    found = facts.join(partial.unionByName(whole), "h", "left")
    return found.select(
        "doc_id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
