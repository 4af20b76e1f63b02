"""Mixing sources to target weights by min-cost flow over membership patterns (operator 6)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.llm.common import WORD, Stage, columns_of

REPEATS = 3  # a document enters the mix at most so often; the second and third time cost more
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sizes: dict, weights: dict, total: float, repeats: int = REPEATS) -> dict:
    """Shares of ``total`` by weight; none above ``repeats`` times its size.

    What a source cannot take is shared again by weight among the others until none is above.
    """
    targets = dict.fromkeys(sizes, 0.0)
    open_, left = {k for k in sizes if weights[k] > 0}, float(total)
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * unit > repeats * sizes[k]}
        if not full:
            targets.update({k: weights[k] * unit for k in open_})
            break
        for k in full:
            targets[k] = float(repeats * sizes[k])
            left -= targets[k]
        open_ -= full
    return targets


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, start: int, end: int, room: int, cost: int) -> tuple[int, int]:
        self.arcs[start].append(_Arc(end, room, cost, len(self.arcs[end])))
        self.arcs[end].append(_Arc(start, 0, -cost, len(self.arcs[start]) - 1))
        return start, len(self.arcs[start]) - 1

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.arcs)
        while True:
            far, via, heap = {source: 0}, {}, [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for k, arc in enumerate(self.arcs[u]):
                    step = d + arc.cost + height[u] - height[arc.to]
                    if arc.room > 0 and step < far.get(arc.to, step + 1):
                        far[arc.to], via[arc.to] = step, (u, k)
                        heapq.heappush(heap, (step, arc.to))
            if sink not in far:
                return
            for u in range(len(height)):
                height[u] += far.get(u, far[sink])
            room, at = None, sink
            while at != source:
                u, k = via[at]
                room = self.arcs[u][k].room if room is None else min(room, self.arcs[u][k].room)
                at = u
            at = sink
            while at != source:
                u, k = via[at]
                arc = self.arcs[u][k]
                arc.room -= room
                self.arcs[at][arc.back].room += room
                at = u

    def used(self, place: tuple[int, int]) -> int:
        arc = self.arcs[place[0]][place[1]]
        return self.arcs[arc.to][arc.back].room


def routed(
    patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS
) -> dict[tuple, int]:
    """Words each membership pattern gives to each source: {(pattern, source): words}.

    Every pattern offers its words ``repeats`` times; the k-th time costs 2**k - 1 a word,
    so words are repeated only where a quota cannot be met otherwise.
    """
    names, sources = list(patterns), list(quotas)
    first = {p: 1 + i for i, p in enumerate(names)}
    second = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    sink = 1 + len(names) + len(sources)
    net = Flow(sink + 1)
    for p, words in patterns.items():
        for k in range(repeats):
            net.add(0, first[p], words, 2 ** k - 1)
    places = {}
    for p, words in patterns.items():
        for s in p:
            if s in second:
                places[p, s] = net.add(first[p], second[s], repeats * words, 0)
    for s, quota in quotas.items():
        net.add(second[s], sink, int(quota), 0)
    net.run(0, sink)
    return {key: net.used(place) for key, place in places.items()}


def with_patterns(docs: DataFrame, members: str, text: str, doc_id: str) -> DataFrame:
    """doc_id, size and pattern (the sorted distinct source names; null is a name of its own)."""
    def tagged(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("~"))

    column = F.col(members)
    if docs.schema[members].dataType.typeName() == "array":
        column = F.transform(F.coalesce(column, F.array()), tagged)
        pattern = F.array_sort(F.array_distinct(column))
    else:
        pattern = F.array(tagged(column))
    return columns_of(
        docs, ("doc_id", F.col(doc_id)), ("size", n_words(F.col(text))), ("pattern", pattern))


PLAN = "pattern array<string>, whole long, rest long, source_size long, target double"


def select_words(rows: DataFrame, seed: int, plan: list[tuple]) -> DataFrame:
    """Give each row of a pattern its words: whole repeats, then a seeded share of one more.

    ``plan`` (see ``PLAN``) has the repeats that all rows of a pattern get, and the words of
    one further repeat. Rows stand in the order of a seeded hash; those whose words end
    within these get the further repeat, the row that crosses them gets what is left.
    Sums per 12 bits of the hash locate the crossing row in two steps (one small row per
    pattern reaches the driver, as many as ``plan`` has), then only rows that share all 24
    bits are sorted: a pattern that holds most rows is never gathered.
    """
    spark = rows.sparkSession
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = rows.withColumns({
        "_o": order,
        "_b0": F.shiftrightunsigned(order, 64 - LEVEL_BITS),
        "_b1": F.shiftrightunsigned(order, 64 - 2 * LEVEL_BITS).bitwiseAND((1 << LEVEL_BITS) - 1),
    })
    left = {tuple(p[0]): p[2] for p in plan}
    places: dict[tuple, list] = {key: [] for key in left}
    for level in range(2):
        known = [f"_e{i}" for i in range(level)]
        edges = F.broadcast(spark.createDataFrame(
            [(list(k), left[k], *places[k]) for k in left if len(places[k]) == level],
            ", ".join(["pattern array<string>, _left long", *[f"{c} long" for c in known]])))
        inside = rows.join(edges, "pattern").where(F.lit(True) if not level else F.col("_b0") == F.col("_e0"))
        sums = inside.groupBy("pattern", "_left", f"_b{level}").agg(F.sum("size").alias("_w"))
        run = Window.partitionBy("pattern").orderBy(f"_b{level}")
        sums = sums.withColumn("_end", F.sum("_w").over(run))
        for r in sums.where((F.col("_end") > F.col("_left")) & (F.col("_end") - F.col("_w") <= F.col("_left"))).collect():
            key = tuple(r["pattern"])
            places[key].append(r[f"_b{level}"])
            left[key] -= r["_end"] - r["_w"]
    final = spark.createDataFrame(
        [(*p, left[tuple(p[0])], *(places[tuple(p[0])] + [None, None])[:2]) for p in plan],
        f"{PLAN}, _left long, _e0 long, _e1 long")
    joined = rows.join(F.broadcast(final), "pattern")
    here = F.coalesce((F.col("_b0") == F.col("_e0")) & (F.col("_b1") == F.col("_e1")), F.lit(False))
    below = (
        F.col("_e0").isNull() | (F.col("_b0") < F.col("_e0"))
        | ((F.col("_b0") == F.col("_e0")) & (F.col("_e1").isNull() | (F.col("_b1") < F.col("_e1"))))
    )
    clear = joined.where(~here).withColumn(
        "_extra", F.when((F.col("rest") > 0) & below, F.col("size")).otherwise(F.lit(0)))
    run = Window.partitionBy("pattern").orderBy("_o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_left") - F.coalesce(F.sum("size").over(run), F.lit(0))
    close = joined.where(here).withColumn(
        "_extra", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    return clear.unionByName(close).select(
        "doc_id", "pattern", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("_extra")).alias("taken"))


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    members: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    repeats: int = REPEATS,
    seed: int = 7,
) -> DataFrame:
    """Choose how many words of each document enter a mix whose sources have set weights.

    ``members`` is a source name or an array of names (overlapping sources). ``weights``
    maps names to weights (None for the null source); by default the sources in code point
    order, null last, weigh 1, 2, 3, 1, ... The sources share all words of the table by
    weight; a target stops at ``repeats`` times what the source holds. One row per input row:
    doc_id, pattern, size (words), source_size and target (of the pattern's first source),
    taken (words taken, repeats counted, at most ``repeats`` * size).

    The driver holds one row per membership pattern and solves the flow on them: a mix names
    tens of sources, whatever the size of the corpus. Null or empty texts have size 0 and
    give nothing. A document without any source gives nothing. Repeated rows count each;
    ties of the seeded order fall back on doc_id. An empty table gives no rows.
    """
    rows = Stage(docs.sparkSession).put(with_patterns(docs, members, text, doc_id), "sizes")
    held = {
        tuple(r["pattern"]): int(r["words"])
        for r in rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    }
    names = sorted({s for p in held for s in p}, key=lambda s: (s == "~", s))
    shares = {
        s: i % 3 + 1 if weights is None else weights.get(None if s == "~" else s[1:], 0)
        for i, s in enumerate(names)
    }
    sizes = {s: sum(n for p, n in held.items() if s in p) for s in names}
    targets = water_filled(sizes, shares, sum(held.values()), repeats)
    given = routed(held, {s: round(t) for s, t in targets.items()}, repeats)
    plan = []
    for p, words in held.items():
        flow = sum(given.get((p, s), 0) for s in p)
        whole = min(repeats, flow // words) if words else 0
        first = p[0] if p else None
        plan.append((list(p), int(whole), int(flow - whole * words), sizes.get(first, 0),
                     float(targets.get(first, 0.0))))
    return select_words(rows, seed, plan)
