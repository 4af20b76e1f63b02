"""Sharding: minimax contiguous partition of ordered atomic groups (operator 10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import Stage, columns_of, numbered

BITS, FINER_BITS = 12, 8  # bits of the order key that the first histogram and each refinement look at
KEY_BITS = 60  # order keys are 0 to 2**60 - 1


def greedy_cuts(prefix: np.ndarray, shards: int, capacity: int) -> np.ndarray | None:
    """Ends of shards that each take as much as fits; None when ``shards`` do not suffice."""
    ends, at, base = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, base + capacity, side="right"))
        ends.append(at)
        if at == len(prefix):
            return np.array(ends + [at] * (shards - len(ends)))
        base = prefix[at - 1] if at else 0
    return None


def least_capacity(weights: np.ndarray, shards: int) -> int:
    """Smallest capacity for which cutting greedily needs at most ``shards`` shards."""
    if not len(weights):
        return 0
    prefix = np.cumsum(weights)
    low, high = max(int(weights.max()), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(prefix, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _binned(groups: DataFrame, width: int, within: int | None = None, wanted: list[int] = ()) -> list[tuple]:
    """First and last key, sum, largest and number of groups of each bin of ``2**width`` order keys.

    ``wanted`` keeps the bins of ``2**within`` keys to look at.
    """
    rows = groups if within is None else groups.where(F.shiftright("at", within).isin(wanted))
    found = (
        rows.groupBy(F.shiftright("at", width).alias("bin"))
        .agg(F.sum("size").alias("size"), F.max("size").alias("top"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return sorted((r["bin"] << width, ((r["bin"] + 1) << width) - 1, r["size"], r["top"], r["n"]) for r in found)


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """Last order key of each shard but the last, for the least feasible capacity.

    ``groups`` has one row per atomic group: ``at`` (distinct order key) and ``size``.
    The driver sees histograms only. The first has 2**BITS bins of keys. A bin in
    which no greedy cut can fall for any capacity still in question stays whole; the
    others are split by FINER_BITS more bits, until every cut stands between two groups.
    A capacity is surely feasible if cutting at bin edges with it works, and surely
    not feasible if even cutting inside bins at will does not.
    """
    segments = _binned(groups, KEY_BITS - BITS)
    if not segments:
        return []
    while True:
        sizes = np.array([s[2] for s in segments], dtype=np.int64)
        single = np.array([s[4] == 1 for s in segments])
        prefix = np.cumsum(sizes)
        high = least_capacity(sizes, shards)
        low = max(max(int(s[3]) for s in segments), -(-int(prefix[-1]) // shards))
        low = min(high, _floor_capacity(prefix, single, shards, low, high))
        touched = _touched(prefix, single, shards, low, high)
        if not touched:
            ends = greedy_cuts(prefix, shards, high)
            return [segments[e - 1][1] for e in ends[:-1] if 0 < e < len(segments)]
        widths = {i: (segments[i][1] - segments[i][0] + 1).bit_length() - 1 for i in touched}
        within = max(widths.values())
        chosen = {i for i in touched if widths[i] == within}
        finer = _binned(groups, max(0, within - FINER_BITS), within, [segments[i][0] >> within for i in sorted(chosen)])
        segments = sorted([s for i, s in enumerate(segments) if i not in chosen] + finer)


def _walk(prefix, single, shards, capacity, generous: bool) -> list[int] | None:
    """Places (sums of sizes) of greedy cuts if bins may be cut anywhere (generous) or at edges."""
    base, places = 0, []
    for _ in range(shards):
        i = int(np.searchsorted(prefix, base + capacity, side="right"))
        if i == len(prefix):
            return places
        edge = int(prefix[i - 1]) if i else 0
        base = edge if single[i] or not generous else base + capacity
        places.append(base)
    return None


def _floor_capacity(prefix, single, shards, low, high) -> int:
    """Least capacity that is not ruled out when bins may be cut anywhere."""
    while low < high:
        middle = (low + high) // 2
        if _walk(prefix, single, shards, middle, True) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _touched(prefix, single, shards, low, high) -> set[int]:
    """Bins of several groups in which a cut may fall for a capacity from low to high."""
    touched: set[int] = set()
    least = most = 0
    for _ in range(shards):
        # the k-th cut lies between the cut of the smallest capacity, taken at bin edges, and the largest
        i = int(np.searchsorted(prefix, least + low, side="right"))
        j = int(np.searchsorted(prefix, most + high, side="right"))
        touched.update(k for k in range(i, min(j + 1, len(prefix))) if not single[k])
        if i == len(prefix):
            break
        least = int(prefix[i - 1]) if i else 0
        most = min(most + high, int(prefix[-1]))
    return touched


def minimax_shards(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """Put documents into shards of nearly equal bytes; equal texts stay together.

    Groups (equal texts) are ordered by a 60-bit hash of the text, then cut into
    ``shards`` contiguous runs whose largest is as small as possible. One row per input
    row: doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, shard, slot (0, 1, ...
    in each shard, by group and doc_id), capacity (the largest allowed shard).

    A null text has no bytes and is a group apart from the empty text. A null doc_id is
    kept and sorts first. Rows repeated as a whole are all kept. A group larger than
    an even share fills a shard alone, so some shards may stay empty; with fewer groups
    than shards the last ones are empty. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    digest = F.md5(F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.concat(F.lit("t"), F.col(text))))
    rows = columns_of(
        docs,
        ("doc_id", F.col(doc_id)),
        ("size", (F.octet_length(body) + overhead).cast("long")),
        ("text_crc32", F.crc32(body)),
        ("at", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")),
    )
    rows = stage.put(rows, "sizes")
    groups = rows.groupBy("at").agg(F.sum("size").alias("size"))
    ends = boundaries(groups, shards)
    shard = F.lit(0)
    for end in ends:
        shard = shard + (F.col("at") > end).cast("int")
    placed = rows.withColumn("shard", shard)
    return numbered(placed, stage, ["shard", "at", "doc_id", "size", "text_crc32"], "shard", "slot",
                    "slots").drop("at")
