"""Benchmark decontamination by q-gram lemma filtering and banded alignment (operator 2).

Windows of a benchmark item and regions of a document match within an edit budget. A
match of a window of w characters with e edits keeps at least w - q + 1 - q * e of the
window's q-grams, all within e of one diagonal. Shared q-grams are counted in overlapping
diagonal bands; regions that reach the count are aligned inside the band.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import arrow_map, columns_of, mix, pieces, text_buffer

Q = 10  # characters of a q-gram
WINDOW = 80  # characters of a window of an item; windows begin at every character
EDIT_SHARE = 0.075  # edits allowed per character of a window
BAND_BITS = 4  # bands start every 2**BAND_BITS diagonals and are twice as wide
POSTINGS = 500_000  # hits of q-grams, by item, that a task looks at together
INDEX_GRAMS = 4_000_000  # q-grams of the items that one pass holds (24 bytes each); more items take more passes


def edit_budget(length: int) -> int:
    """Edits allowed in a window, and no more than the lemma can filter."""
    e = int(EDIT_SHARE * length)
    while e and length - Q + 1 - Q * e < 1:
        e -= 1
    return e


def characters(raw: np.ndarray, bounds: np.ndarray):
    """Lower-cased characters of all rows, white space runs as one space.

    Returns a number per character (its UTF-8 bytes), the bounds of the rows in it, and each
    character's place in the row's own characters.
    """
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    code = padded[at].copy()
    open_ = np.ones(len(at), bool)
    for k in (1, 2, 3):
        follow = padded[at + k]
        open_ &= (follow & 0xC0) == 0x80
        code |= np.where(open_, follow << np.uint32(8 * k), 0).astype(np.uint32)
    first = np.searchsorted(at, bounds)
    place = np.arange(len(at)) - np.repeat(first[:-1], np.diff(first))
    white = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0C2)
    code = np.where(white, np.uint32(32), code)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    keep[first[:-1][first[:-1] < len(code)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], kept[first], place[keep]


def lowered(column) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pc.utf8_lower(column.cast(pa.large_string())))


def gram_codes(code: np.ndarray) -> np.ndarray:
    """64-bit code of the q-gram that starts at each character but the last Q - 1."""
    if len(code) < Q:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    h = mix(code.astype(np.uint64) + np.uint64(1))
    two = h[:-1] * np.uint64(base) + h[1:]
    four = two[:-2] * np.uint64(pow(base, 2, 1 << 64)) + two[2:]
    eight = four[:-4] * np.uint64(pow(base, 4, 1 << 64)) + four[4:]
    ten = eight[:-2] * np.uint64(pow(base, 2, 1 << 64)) + two[8:]
    return mix(ten)


@dataclass
class GramIndex:
    grams: np.ndarray  # distinct q-gram codes, ascending
    first: np.ndarray  # postings of gram i: first[i] to first[i + 1]
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray  # by the top bits of a code: whether any gram has them
    shift: int
    ids: list
    texts: list[np.ndarray]
    need: np.ndarray  # q-grams a region must share, by item


def index_parts(index: GramIndex) -> tuple:
    """Plain arrays, which a task can read without this package."""
    return tuple(getattr(index, f.name) for f in fields(index))


def build_index(items: list[tuple]) -> GramIndex:
    """Index of (item id, characters); items with fewer than Q characters have no q-gram and never match."""
    grams = [gram_codes(t) for _, t in items]
    code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    code, item, place = code[order], item[order].astype(np.int32), place[order].astype(np.int32)
    distinct, first = np.unique(code, return_index=True)
    bits = max(10, int(16 * max(len(distinct), 1)).bit_length())
    table = np.zeros(1 << bits, bool)
    table[(distinct >> np.uint64(64 - bits)).astype(np.int64)] = True
    need = [min(len(t), WINDOW) for _, t in items]
    need = np.array([w - Q + 1 - Q * edit_budget(w) for w in need], np.int64)
    return GramIndex(distinct, np.append(first, len(code)), item, place, table, 64 - bits,
                     [i for i, _ in items], [t for _, t in items], need)


def candidate_regions(index: GramIndex, code: np.ndarray, bounds: np.ndarray):
    """(row, item, band, window start) worth aligning: enough shared q-grams close by in one band."""
    none = (np.zeros(0, np.int64),) * 4
    grams = gram_codes(code)
    at = np.flatnonzero(index.table[(grams >> np.uint64(index.shift)).astype(np.int64)])
    if not len(at) or not len(index.grams):
        return none
    slot = np.searchsorted(index.grams, grams[at])
    slot[slot == len(index.grams)] = 0
    hit = index.grams[slot] == grams[at]
    at, slot = at[hit], slot[hit]
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + Q <= bounds[row + 1]
    at, slot, row = at[inside], slot[inside], row[inside]
    parts = [regions_of(index, bounds, *hits) for hits in posting_slices(index, row, at, slot)]
    found = np.concatenate([np.stack(p) for p in parts], axis=1) if parts else np.zeros((4, 0), np.int64)
    return tuple(found)


def posting_slices(index: GramIndex, row, at, slot):
    """(row, place in the text, item, place in the item) of all hits, at most POSTINGS at a time, or those of one item.

    A slice holds all hits of the (row, item) pairs in it: whole rows, or a range of items for a row that has
    more hits (many items that share a phrase).
    """
    items = len(index.ids)
    n = index.first[slot + 1] - index.first[slot]
    per_row = np.bincount(row, weights=n).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(per_row)])
    edges = np.searchsorted(row, np.arange(len(per_row) + 1))
    low = 0
    while low < len(per_row):
        high = max(low + 1, int(np.searchsorted(total, total[low] + POSTINGS, side="right")) - 1)
        own = slice(edges[low], edges[high])
        if total[high] - total[low] <= POSTINGS:
            yield expanded(index, row[own], at[own], index.first[slot[own]], n[own])
        else:
            key = np.repeat(np.arange(len(index.grams)), np.diff(index.first)) * items + index.item
            step = max(1, items * POSTINGS // int(total[high] - total[low]))
            for item in range(0, items, step):
                begin = np.searchsorted(key, slot[own] * items + item)
                end = np.searchsorted(key, slot[own] * items + min(item + step, items))
                yield expanded(index, row[own], at[own], begin, end - begin)
        low = high


def expanded(index: GramIndex, row, at, begin, n):
    post = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(row, n), np.repeat(at, n), index.item[post].astype(np.int64), index.place[post].astype(np.int64)


def regions_of(index: GramIndex, bounds, row, at, item, place):
    """``candidate_regions`` of some rows and items, from all their hits."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(at):
        return none
    diagonal = at - bounds[row] - place
    low = diagonal >> BAND_BITS
    # first a count by half band; a band is two of these, and every hit lies in two bands
    items, wide = len(index.ids), 1 << 30  # a row has fewer bands than this
    half = (row * items + item) * wide + (low + (wide >> 1))
    seen, count = np.unique(half, return_counts=True)
    pos = np.searchsorted(seen, half)
    neighbours = count[pos].copy()
    for step in (-1, 1):
        other = np.searchsorted(seen, half + step)
        other[other == len(seen)] = 0
        neighbours += np.where(seen[other] == half + step, count[other], 0)
    busy = neighbours >= index.need[item]
    row, item, place, at, half = row[busy], item[busy], place[busy], at[busy], half[busy]
    band = np.concatenate([half, half - 1])  # band k covers half bands k and k + 1
    row, item, place, at = (np.concatenate([x, x]) for x in (row, item, place, at))
    order = np.lexsort((at, band))
    band, row, item, place, at = (x[order] for x in (band, row, item, place, at))
    need = index.need[item]
    last = np.arange(len(at)) + need - 1
    fits = last < len(at)
    reach = np.minimum(last, len(at) - 1)
    fits &= (band[reach] == band) & (at[reach] - at <= WINDOW + int(EDIT_SHARE * WINDOW))
    k = np.flatnonzero(fits)
    if not len(k):
        return none
    # windows of the item that a run of hits may lie in
    width = np.array([min(len(t), WINDOW) for t in index.texts], np.int64)[item[k]]
    length = np.array([len(t) for t in index.texts], np.int64)[item[k]]
    slack = 2 << BAND_BITS
    from_, to = np.minimum(place[k], place[last[k]]), np.maximum(place[k], place[last[k]]) + Q
    start = np.maximum(0, to - width - slack)
    stop = np.minimum(length - width, from_ + slack)
    # runs of one region reach over each other: keep every start once, in the order of the regions
    region = np.cumsum(np.concatenate([[True], band[k][1:] != band[k][:-1]])) - 1
    n = np.maximum(0, stop - start + 1)
    which = np.repeat(np.arange(len(k)), n)
    window = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    code = np.unique(region[which] << 32 | window)
    first = k[np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1])]  # a hit of each region
    # the lemma holds for each window by itself: its own q-grams must be shared often enough
    of = np.searchsorted(band[first], band)
    of[of == len(first)] = 0
    mine = band[first][of] == band
    hits = np.sort(of[mine] << 32 | place[mine])
    reach = np.array([min(len(t), WINDOW) - Q for t in index.texts], np.int64)[item[first]][code >> 32]
    count = np.searchsorted(hits, code + reach, side="right") - np.searchsorted(hits, code)
    code = code[count >= need[first][code >> 32]]
    heads = first[code >> 32]
    return row[heads], item[heads], (band[heads] % wide) - (wide >> 1), code & ((1 << 32) - 1)


def banded_edits(patterns: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each pattern and a stretch of its region, and where that stretch ends.

    ``regions`` holds, for pattern character i, the region characters i to i + width: the band.
    """
    n, length = patterns.shape
    width = regions.shape[1] - length
    # one column per pair: steps along the band are then vector operations over all pairs
    patterns, regions = np.ascontiguousarray(patterns.T), np.ascontiguousarray(regions.T)
    steps = np.arange(width + 1, dtype=np.int16)[:, None]
    # cell k of row i stands for region prefixes of i + k characters
    row = np.zeros((width + 1, n), np.int16)
    new = np.empty((width + 1, n), np.int16)
    for i in range(length):
        # to row i + 1, cell k: substitution from cell k, deletion of the pattern character from cell k + 1
        np.add(row[:width], regions[i:i + width] != patterns[i], out=new[:width])
        np.minimum(new[:width], row[1:] + np.int16(1), out=new[:width])
        new[width] = length + 1
        new -= steps
        for k in range(1, width + 1):
            np.minimum(new[k], new[k - 1], out=new[k])
        new += steps
        row, new = new, row
    end = row.argmin(axis=0)
    return row[end, np.arange(n)], end + length


def aligned(index: GramIndex, code, bounds, place, regions) -> list[tuple]:
    """(row, item, start, end, edits, window) of the regions whose alignment keeps the budget."""
    row, item, band, window = regions
    found = []
    lengths = np.array([min(len(t), WINDOW) for t in index.texts], np.int64)[item]
    for length in np.unique(lengths).tolist():
        budget = edit_budget(length)
        width = (2 << BAND_BITS) + 2 * budget + 1
        all_ = np.flatnonzero(lengths == length)
        for low in range(0, len(all_), 4000):
            own = all_[low:low + 4000]
            patterns = np.stack([index.texts[i][w:w + length] for i, w in zip(item[own], window[own])])
            start = window[own] + (band[own] << BAND_BITS) - budget
            at = start[:, None] + np.arange(length + width)
            size = (bounds[row[own] + 1] - bounds[row[own]])[:, None]
            outside = (at < 0) | (at >= size)
            text = code[np.minimum(bounds[row[own]][:, None] + np.clip(at, 0, np.maximum(size - 1, 0)), len(code) - 1)]
            text = np.where(outside, np.uint32(0xFFFFFFFF), text)
            edits, end = banded_edits(patterns, text)
            for k in np.flatnonzero(edits <= budget):
                r = row[own[k]]
                stop = min(int(start[k] + end[k]), int(size[k, 0]))
                begin = max(0, stop - length)
                base = bounds[r]
                found.append((int(r), int(item[own[k]]), int(place[base + begin]), int(place[base + stop - 1]) + 1,
                              int(edits[k]), int(window[own[k]])))
    return found


def item_groups(items: DataFrame) -> list[list[tuple]]:
    """Items in groups whose q-grams fit one pass each; items are read a partition at a time."""
    groups, held, size = [], [], 0
    for r in items.toLocalIterator():
        code, bounds, _ = characters(*lowered(pa.array([r["text"]], pa.string())))
        if len(code) < Q:
            continue
        if held and size + len(code) > INDEX_GRAMS:
            groups.append(held)
            held, size = [], 0
        held.append((r["item_id"], code))
        size += len(code)
    return groups + [held] if held else groups


def matches(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Benchmark passages in documents: doc_id, item_id, start, end (characters of the text), edits, windows.

    One row per document row and item of which a window of WINDOW characters (or the whole, if
    shorter) occurs with at most EDIT_SHARE edits per character; start and end span all its
    matching windows, edits is the fewest of one window. Case and the kind and length of white
    space do not count. The items are the query set: they are held in blocks of INDEX_GRAMS
    q-grams and every block meets all documents in one pass.

    Null or empty texts and items match nothing, nor do items of fewer than Q characters.
    Repeated rows each match. Without documents or items the result is empty.
    """
    rows = columns_of(docs, ("doc_id", F.col(doc_id)), ("text", F.col(text)))
    wanted = columns_of(items, ("item_id", F.col(item_id)), ("text", F.col(item_text))).where(F.col("text").isNotNull())
    id_type, key_type = rows.schema["doc_id"].dataType.simpleString(), wanted.schema["item_id"].dataType.simpleString()
    schema = f'doc_id {id_type}, item_id {key_type}, start long, "end" long, edits int, windows int'.replace('"', "`")
    out = docs.sparkSession.createDataFrame([], schema)
    for group in item_groups(wanted):
        held = docs.sparkSession.sparkContext.broadcast(index_parts(build_index(group)))

        def kernel(batches, held=held):
            index = GramIndex(*held.value)
            for batch in pieces(batches):
                code, bounds, place = characters(*lowered(batch.column(1)))
                best: dict[tuple, list] = {}
                regions = candidate_regions(index, code, bounds)
                for r, i, start, end, edits, window in aligned(index, code, bounds, place, regions):
                    b = best.setdefault((r, i), [start, end, edits, set()])
                    b[3].add(window)
                    b[:3] = min(b[0], start), max(b[1], end), min(b[2], edits)
                if best:
                    r, i = (np.array(x) for x in zip(*best))
                    columns = list(zip(*best.values()))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(r)), pa.array([index.ids[k] for k in i.tolist()]),
                        pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int32()), pa.array([len(w) for w in columns[3]], pa.int32()),
                    ], ["doc_id", "item_id", "start", "end", "edits", "windows"])

        out = out.unionByName(arrow_map(rows, kernel, schema))
    return out


def without_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **columns) -> DataFrame:
    """The documents in which no benchmark passage occurs; rows with a null id are kept."""
    found = matches(docs, items, doc_id, **columns).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(found, doc_id, "left_anti")
