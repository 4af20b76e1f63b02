"""Brown class-based language model: exchange clustering, class transitions, word emissions (operator 8).

    log P(text) = sum over tokens of log P(class | class before) + log P(word | class)

Word counts cover all training texts and stay a distributed table. Every word that occurs
``LEAST_COUNT`` times or more is clustered. Texts are indexed once: the most frequent words (at most
``HEAD_WORDS``) by a broadcast, all others by one join. The neighbours of every word are then sent
once to the block that holds the word, and the rounds of the exchange read these blocks: no round
moves texts or neighbours. Tasks hold one byte per word, its class, for at most ``CLASS_WORDS``
words; classes of further words stay a staged table and are joined. Where these lines fall does not
change the model. Rarer words share one open class, in which each keeps its exact count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import (
    Stage, arrow_map, columns_of, loosened, mix, numbered, pieces, squeezed, steps, text_buffer, word_hashes,
)

HEAD_WORDS = 1 << 20  # words that are broadcast with their hash to index the texts; further words are joined, once
CLASS_WORDS = 1 << 27  # words whose class is broadcast; those of further words are joined in each round
BLOCK_TOKENS = 1 << 20  # occurrences of one block of words, about
BATCH_BLOCKS = 2  # blocks that a task takes at a time
HOT_COUNT = 1 << 18  # words that occur more often are spread over the blocks
SLICE = 20  # bits of a word's rank within one row of classes that moved
OPEN, EDGE = -1, -2  # neighbours that are no classed word
CLASSES = 32  # exchanged classes; the open class and the text boundary come on top
ROUNDS = 6  # of exchange; in each one half of the words may move
HELD = 2_000_000  # pairs that a task adds up before it hands them on
LEAST_COUNT = 2  # rarer words stay in the open class, which thus tells how unseen words behave
SMOOTHING = 50.0  # weight of the class frequencies in the transitions


def add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    if not len(code):
        return code, n
    order = np.argsort(code)
    code, n = code[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[starts], np.add.reduceat(n, starts)


class Sums:
    """Counts by code, added up in a task; hands out what it holds once that is much."""

    def __init__(self):
        self.codes, self.counts, self.size = [], [], 0

    def add(self, code: np.ndarray) -> bool:
        c, n = np.unique(code, return_counts=True)
        self.codes.append(c)
        self.counts.append(n.astype(np.int64))
        self.size += len(c)
        if self.size > 2 * HELD:
            self.codes, self.counts = ([x] for x in add_up(self.codes, self.counts))
            self.size = len(self.codes[0])
        return self.size > HELD

    def take(self):
        out = add_up(self.codes, self.counts) if self.codes else (np.zeros(0, np.int64),) * 2
        self.__init__()
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """word (64-bit hash), n: how often each lower-cased word occurs in the ``text`` column."""
    def kernel(batches):
        sums = Sums()

        def out():
            code, n = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

        for batch in pieces(batches):
            if sums.add(word_hashes(*text_buffer(batch.column(0)))[0]):
                yield out()
        yield out()

    return arrow_map(texts, kernel, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_threshold(counts: DataFrame, most: int) -> int:
    """Least count such that at most ``most`` words have it or more; from a small histogram of counts."""
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(
        4096 + F.floor(F.log2(F.col("n").cast("double")) * 16 - 192)).cast("int")
    bins = counts.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    threshold, held = None, 0
    for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
        held += r["words"]
        if held > most:
            break
        threshold = r["least"]
    return threshold if threshold is not None else (1 << 62)


@dataclass
class ClassModel:
    words: np.ndarray  # hashes of the head words by rank (most frequent first); rank i has the id 2 i + its turn
    counts: np.ndarray
    classes: np.ndarray  # by rank, also of further words, at most CLASS_WORDS
    transitions: np.ndarray  # log10, from class to class; open class and boundary last
    train_tokens: int
    distinct: int
    ends: int  # end tokens of the training texts
    open_total: int  # tokens of the open class in training, and its words, and one for unseen words
    class_total: np.ndarray  # tokens of each class
    tail: DataFrame | None = None  # id, class: the words beyond ``classes``


def indexed_texts(docs: DataFrame, words, ids, doc_id: str, text: str, extra: dict[str, Column]) -> DataFrame:
    """Each text as head word ids (int32), with the hashes of its other words.

    ``words`` are hashes, ascending, and ``ids`` theirs. The k-th of the other words of a text, from 0,
    stands as -1 - k. Written once; what follows reads these instead of the texts.
    """
    rows = columns_of(
        docs, ("text", F.col(text)), ("doc_id", F.col(doc_id)), *extra.items(),
        ("rid", F.monotonically_increasing_id()))
    names = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    held = docs.sparkSession.sparkContext.broadcast((words, ids))

    def kernel(batches):
        words, ids = held.value
        for batch in pieces(batches):
            hashes, row = word_hashes(*text_buffer(batch.column(0)))
            distinct, inverse = np.unique(hashes, return_inverse=True)
            place = np.searchsorted(words, distinct)
            code = np.full(len(distinct), -1, "<i4")
            inside = np.flatnonzero(place < len(words))
            inside = inside[words[place[inside]] == distinct[inside]]
            code[inside] = ids[place[inside]]
            index = code[inverse]
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            other = np.flatnonzero(index < 0)
            pair = np.lexsort((hashes[other], row[other]))
            h, r = hashes[other][pair], row[other][pair]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            bounds = np.searchsorted(r[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            index[other[pair]] = -1 - (np.cumsum(new) - 1 - bounds[r])
            data = index.tobytes()
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([
                *[batch.column(batch.schema.get_field_index(c)) for c in names],
                pa.array([data[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[new].view(np.int64))),
            ], [*names, "ids", "others"])

    return arrow_map(rows, kernel, f"{fields}, ids binary, others array<long>")


def with_others(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Indexed texts with (k, n, id) of their other words that are in ``known`` (word, n, id), as ``tail``."""
    pairs = texts.select("rid", F.posexplode("others").alias("k", "word")).join(known, "word")
    tail = pairs.groupBy("rid").agg(F.collect_list(F.struct("k", "n", "id")).alias("tail"))
    return texts.drop("others").join(tail, "rid", "left")


def token_runs(batches, column: str = "ids", limit: int = 1_000_000):
    """Token indices of many texts side by side: (batch part, ids, first place of each text, ends)."""
    for batch in batches:
        sizes = np.array([len(b) // 4 for b in batch.column(batch.schema.get_field_index(column)).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            data = b"".join(part.column(part.schema.get_field_index(column)).to_pylist())
            yield part, np.frombuffer(data, "<i4"), np.concatenate([[0], np.cumsum(sizes[start:stop])])
            start = stop


def other_words(part, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the other words of the texts, and what ``tail`` has of each: its count (0: unseen), id, further columns."""
    lists = part.column(part.schema.get_field_index("tail"))
    held = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    other = np.flatnonzero(ids < 0)
    # a text has no more other words than tokens, so that each has a slot of its own
    slot = bounds[row] + held.field(0).to_numpy(zero_copy_only=False)
    wanted = bounds[np.searchsorted(bounds, other, side="right") - 1] - 1 - ids[other]
    out = []
    for i in range(1, held.type.num_fields):
        values = np.full(len(ids), 0 if i == 1 else OPEN, np.int64)
        values[slot] = held.field(i).fill_null(OPEN).to_numpy(zero_copy_only=False)
        out.append(values[wanted])
    return other, out


def word_ids(part, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Id of every token's word, OPEN for open words."""
    words = ids.astype(np.int64)
    other, (_, words[other], *_) = other_words(part, ids, bounds)
    return words


def kinds_of(words: np.ndarray, classes: np.ndarray, n_classes: int, beyond=None) -> np.ndarray:
    """Class of each id; ``beyond``: (ids, ascending, and classes) of the words that ``classes`` does not reach."""
    out = np.where(words == EDGE, n_classes + 1, n_classes)
    inside = np.flatnonzero((words >= 0) & (words < 2 * len(classes)))
    out[inside] = classes[words[inside] >> 1]
    if beyond is not None:
        outside = np.flatnonzero(words >= 2 * len(classes))
        out[outside] = beyond[1][np.searchsorted(beyond[0], words[outside])]
    return out


def framed(values: np.ndarray, bounds: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Values with ``mark`` after every text: (value before, value) over words and ends."""
    n = len(bounds) - 1
    out = np.full(len(values) + n, mark, np.int64)
    out[np.arange(len(values)) + np.repeat(np.arange(n), np.diff(bounds))] = values
    return np.concatenate([[mark], out[:-1]]), out


BLOCK = "block long, words binary, known binary, code binary, n binary"


def word_blocks(texts: DataFrame, n_tokens: int, n_hot: int) -> DataFrame:
    """How often which word stands before and after every classed word, in blocks that hold some words each.

    A row holds the ids of its words and of their neighbours (OPEN and EDGE among them), both ascending,
    and cells: (2 * place of the word + 1 if after) * neighbours + place of the neighbour, with its count.
    The ``n_hot`` most frequent words are spread over several blocks; all others are in one.
    """
    blocks = max(1, -(-n_tokens // BLOCK_TOKENS))

    def send(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            words, *sides = (np.concatenate(x) for x in zip(*held))
            salt = np.where(words < 2 * n_hot, (part + 1) << 20 | seq, 0).astype(np.uint64)
            block = (mix(words.astype(np.uint64) ^ (salt << np.uint64(24))) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block << 40 | words)
            block, words, sides = block[order], words[order], [s[order] - EDGE for s in sides]
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(block[edge]), pa.array([
                squeezed(np.concatenate([steps(words[a:b]), *[s[a:b] for s in sides]]))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(block)])], pa.binary())], ["block", "body"])

        for chunk, ids, bounds in token_runs(batches):
            words = word_ids(chunk, ids, bounds)
            before, after = framed(words, bounds, EDGE)
            known = np.flatnonzero(words >= 0)
            at = known + np.searchsorted(bounds, known, side="right") - 1
            held.append((words[known], before[at], after[at + 1]))
            size += len(known)
            if size > HELD:
                yield out()
                seq, held, size = seq + 1, [], 0
        if size:
            yield out()

    def gather(table: pa.Table) -> pa.Table:
        parts = [loosened(b).reshape(3, -1) for b in table.column("body").to_pylist()]
        words, own = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        known, place = np.unique(np.concatenate([p[side] for side in (1, 2) for p in parts]), return_inverse=True)
        code, n = np.unique(np.concatenate([2 * own, 2 * own + 1]) * len(known) + place, return_counts=True)
        return pa.table({
            "block": table.column("block")[:1], "words": pa.array([squeezed(steps(words))], pa.binary()),
            "known": pa.array([squeezed(steps(known))], pa.binary()),
            "code": pa.array([squeezed(steps(code))], pa.binary()), "n": pa.array([squeezed(n)], pa.binary())})

    return arrow_map(texts.select("ids", "tail"), send, "block long, body binary").groupBy("block").applyInArrow(gather, BLOCK)


def block_cells(batches):
    """Of each block: its words and neighbours, and of each cell the word, side and neighbour as places, its count,
    and the classes of words beyond the broadcast."""
    for batch in batches:
        for row in batch.to_pylist():
            words, known, code = (np.cumsum(loosened(row[c])).astype(np.int64) for c in ("words", "known", "code"))
            own, neighbour = np.divmod(code, len(known))
            beyond = None
            if row.get("tail"):
                found = np.array(sorted((r["id"], r["class"]) for r in row["tail"]))
                beyond = found[:, 0], found[:, 1]
            yield words, known + EDGE, own >> 1, own & 1, neighbour, loosened(row["n"]).astype(np.int64), beyond


def beyond_pairs(blocks: DataFrame, n_held: int) -> DataFrame:
    """block, id: the words and neighbours of each block beyond the ``n_held`` whose class is broadcast."""
    def kernel(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, known = (np.cumsum(loosened(row[c])).astype(np.int64) for c in ("words", "known"))
                ids = np.union1d(words, known + EDGE)
                ids = ids[ids >= 2 * n_held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), row["block"], np.int64)), pa.array(ids)], ["block", "id"])

    return arrow_map(blocks.select("block", "words", "known"), kernel, "block long, id long", BATCH_BLOCKS)


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def information(follows: np.ndarray) -> float:
    """sum N(c, d) log N(c, d) - sum N(c) log N(c) - sum N(d) log N(d) over the classes that follow each other."""
    return float(x_log_x(follows).sum() - x_log_x(follows.sum(axis=0)).sum() - x_log_x(follows.sum(axis=1)).sum())


def move_gains(
    own: np.ndarray, local: np.ndarray, context: np.ndarray, n: np.ndarray, follows: np.ndarray,
) -> np.ndarray:
    """What ``information`` gains when a word alone moves from its class ``own`` to each class.

    Cell i says that word ``local[i]`` (ascending) has ``n[i]`` neighbours of ``context[i]``. Cells of
    classes other than the two of a move change by themselves; the four cells between the two
    change by both neighbours and by the word's own repetitions, so they are reckoned apart.
    """
    full = len(follows)
    kinds = full - 2
    rows = np.arange(len(own))
    left, right, self_ = (np.zeros((len(own), full)), np.zeros((len(own), full)), np.zeros(len(own)))
    before, after = context < full, (context >= full) & (context < 2 * full)
    left[local[before], context[before]] = n[before]
    right[local[after], context[after] - full] = n[after]
    self_[local[context == 2 * full]] = n[context == 2 * full]
    side = context < 2 * full
    local, context, n = local[side], context[side], n[side]
    sides = np.concatenate([follows[:, :kinds], follows[:kinds].T])
    other, home = context % full, own[local]
    was = sides[context, home]
    gone = x_log_x(was - n) - x_log_x(was)
    gain = x_log_x(sides[context] + n[:, None]) - x_log_x(sides)[context]
    gone[other == home] = 0
    gain[other == home] = 0
    inner = np.flatnonzero(other < kinds)
    gain[inner, other[inner]] = -gone[inner]
    starts = np.searchsorted(local, rows)
    score = np.add.reduceat(gain, starts, axis=0) + np.add.reduceat(gone, starts)[:, None]
    ll, rr, again = left[rows, own][:, None], right[rows, own][:, None], self_[:, None]
    to, back = left[:, :kinds], right[:, :kinds]
    inside = follows[:kinds, :kinds]
    for old, change in (
        (inside[own, own][:, None], again - ll - rr), (inside[own], ll - again - back),
        (inside[:, own].T, rr - again - to), (inside.diagonal()[None, :], to + back + again),
    ):
        score += x_log_x(np.maximum(old + change, 0)) - x_log_x(old)
    size = left.sum(axis=1)
    totals = follows[:, :kinds].sum(axis=0)
    score -= 2 * (x_log_x(totals + size[:, None]) - x_log_x(totals))
    score -= 2 * (x_log_x(totals[own] - size) - x_log_x(totals[own]))[:, None]
    score[rows, own] = 0
    return score


def moves(cells: DataFrame, follows: np.ndarray, turn: int) -> DataFrame:
    """id, class: the words of this turn (odd or even) that raise the information by a move, and where to."""
    held = cells.sparkSession.sparkContext.broadcast(follows)

    def kernel(batches):
        follows = held.value
        for big in batches:
            word = big.column(0).to_numpy()
            mine = big.filter(pa.array(word % 2 == turn))
            for start in range(0, mine.num_rows, 500):
                part = mine.slice(start, 500)
                lists = part.column(2)
                flat = lists.flatten()
                local = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                gain = move_gains(
                    part.column(1).to_numpy().astype(np.int64), local,
                    flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64),
                    flat.field(1).to_numpy(zero_copy_only=False).astype(float), follows)
                best = gain.argmax(axis=1)
                move = np.flatnonzero(gain[np.arange(len(best)), best] > 1e-6)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(move)), pa.array(best[move].astype(np.int32))], ["id", "class"])

    return arrow_map(cells, kernel, "id long, class int")


def block_moves(blocks: DataFrame, held, follows: np.ndarray, turn: int, n_classes: int, n_hot: int) -> DataFrame:
    """id, class, context, n: ``moves`` (context -1), and the cells of hot words, of which a block has a part only."""
    full = n_classes + 2
    width = 2 * full + 1

    def kernel(batches):
        for words, known, own, side, neighbour, n, beyond in block_cells(batches):
            home = kinds_of(words, held.value, n_classes, beyond)
            again = (side == 0) & (known[neighbour] == words[own])
            context = side * full + kinds_of(known, held.value, n_classes, beyond)[neighbour]
            mine = np.flatnonzero(words % 2 == turn)
            local = np.full(len(words), -1)
            local[mine] = np.arange(len(mine))
            own = local[own]
            taken = np.flatnonzero(own >= 0)
            own, context, n, again = own[taken], context[taken], n[taken], again[taken]
            hot = int(np.searchsorted(words[mine], 2 * n_hot))
            # hot words come first, as they have the smallest ids, and stay apart
            cuts = [*range(0, hot, 500), *range(hot, len(mine), 500), len(mine)]
            for low, high in zip(cuts, cuts[1:]):
                a, b = np.searchsorted(own, [low, high])
                cell, some = (own[a:b] - low) * width, again[a:b]
                sums = np.bincount(cell + context[a:b], weights=n[a:b], minlength=(high - low) * width)
                sums += np.bincount(cell[some] + 2 * full, weights=n[a:b][some], minlength=(high - low) * width)
                at = np.flatnonzero(sums)
                word, kind = np.divmod(at, width)
                ids, classes = words[mine[low:high]], home[mine[low:high]]
                if low < hot:
                    out = ids[word], classes[word], kind, sums[at]
                else:
                    gain = move_gains(classes, word, kind, sums[at], follows)
                    best = gain.argmax(axis=1)
                    move = np.flatnonzero(gain[np.arange(len(best)), best] > 1e-6)
                    out = ids[move], best[move], np.full(len(move), -1), np.zeros(len(move))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(t)) for x, t in zip(out, (np.int64, np.int32, np.int16, np.int64))],
                    ["id", "class", "context", "n"])

    return arrow_map(blocks, kernel, "id long, class int, context short, n long", BATCH_BLOCKS)


def moved_classes(found: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, bool]:
    """``classes`` after the moves of the words they reach; moves come as one compressed byte string a 2^SLICE words."""
    kind, reach = classes.dtype, len(classes)

    def dense(table: pa.Table) -> pa.Table:
        rank = table.column("id").to_numpy() >> 1
        part = int(rank[0] >> SLICE)
        out = np.zeros(1 << SLICE, kind)
        out[rank - (part << SLICE)] = table.column("class").to_numpy() + 1
        return pa.table({"part": pa.array([part], pa.int64()),
                         "body": pa.array([pa.compress(out.tobytes(), "zstd", asbytes=True)], pa.binary())})

    rows = found.where(F.col("id") < 2 * reach).withColumn("part", F.shiftright("id", SLICE + 1)).groupBy(
        "part").applyInArrow(dense, "part long, body binary").collect()
    out = classes.copy()
    for r in rows:
        new = np.frombuffer(pa.decompress(r["body"], kind.itemsize << SLICE, "zstd", asbytes=True), kind)
        part = out[r["part"] << SLICE:(r["part"] + 1) << SLICE]
        at = np.flatnonzero(new)
        part[at] = new[at] - 1
    return out, bool(rows)


def exchange(
    blocks: DataFrame, classes: np.ndarray, tail: DataFrame | None, follows: np.ndarray, n_hot: int, n_classes: int,
    stage: Stage, rounds: int | None = None,
) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Move words between classes while that raises the information between neighbouring classes.

    That is Brown clustering's criterion (``information``), over the classes of both neighbours as
    they are in the round. In a round half of the words choose their best class against the same
    counts; a round that lowers the information as a whole is taken back and ends the exchange.
    ``blocks`` as of ``word_blocks``; ``classes`` by rank; ``tail`` (id, class) is a staged table of the words
    beyond, or None; ``follows``: how often each class follows each in these classes. Gives the three anew.
    """
    rounds = ROUNDS if rounds is None else rounds
    context = blocks.sparkSession.sparkContext
    corner = np.zeros_like(follows)  # open class and boundary: no move changes how these follow each other
    corner[n_classes:, n_classes:] = follows[n_classes:, n_classes:]
    pairs = None if tail is None else stage.put(beyond_pairs(blocks, len(classes)), "pairs")
    best, idle = None, 0
    for step in range(rounds + 1):
        read, held = blocks, context.broadcast(classes)
        if pairs is not None:
            kinds = pairs.join(tail, "id").groupBy("block").agg(F.collect_list(F.struct("id", "class")).alias("tail"))
            read = stage.put(blocks.join(kinds, "block", "left"), f"read-{step}")
        if step:
            follows = corner + block_transitions(read, held, n_classes)
        value = information(follows)
        if best is not None and value < best[0]:
            break
        best = value, classes, follows, tail
        if step:
            stage.drop(f"moves-{step - 1}", f"read-{step - 1}", f"tail-{step - 1}")
        if step == rounds or idle == 2:
            break
        found = stage.put(block_moves(read, held, follows, step % 2, n_classes, n_hot), f"moves-{step}")
        moving = found.where("context < 0").select("id", "class")
        if n_hot:
            cells = found.where("context >= 0").groupBy("id", "class", "context").agg(F.sum("n").alias("n")).groupBy(
                "id", "class").agg(F.sort_array(F.collect_list(F.struct("context", "n"))).alias("cells"))
            moving = moving.unionByName(moves(cells, follows, step % 2))
        moved = False
        if tail is not None:
            outside = moving.where(F.col("id") >= 2 * len(classes))
            moved = not outside.isEmpty()
            tail = stage.put(tail.join(outside.withColumnRenamed("class", "to"), "id", "left").select(
                "id", F.coalesce("to", "class").alias("class")), f"tail-{step + 1}")
        classes, inside = moved_classes(moving, classes)
        idle = 0 if moved or inside else idle + 1
        held.unpersist()
    stage.drop(f"moves-{step - 1}", f"read-{step - 1}", f"read-{step}")
    return best[1:]


def summed(cells: DataFrame, full: int) -> np.ndarray:
    out = np.zeros(full * full)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(full, full)


def cell_batch(sums: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used].astype(np.int64))], ["cell", "n"])


def block_transitions(blocks: DataFrame, held, n_classes: int) -> np.ndarray:
    """How often each class follows each class where one of both is a classed word's; open class and boundary last."""
    full = n_classes + 2

    def kernel(batches):
        sums = np.zeros(full * full)
        for words, known, own, side, neighbour, n, beyond in block_cells(batches):
            home = kinds_of(words, held.value, n_classes, beyond)[own]
            other = kinds_of(known, held.value, n_classes, beyond)[neighbour]
            # a pair of classed words is counted once, with its second word
            cell = np.where(side == 0, other * full + home, home * full + other)
            once = (side == 0) | (other >= n_classes)
            sums += np.bincount(cell[once], weights=n[once], minlength=full * full)
        yield cell_batch(sums)

    return summed(arrow_map(blocks, kernel, "cell int, n long", BATCH_BLOCKS), full)


def transition_counts(texts: DataFrame, n_classes: int) -> np.ndarray:
    """How often each class follows each class as dealt by rank; the open class and the text boundary come last."""
    full = n_classes + 2

    def kernel(batches):
        sums = np.zeros(full * full, np.int64)
        for part, ids, bounds in token_runs(batches):
            words = word_ids(part, ids, bounds)
            kinds = np.where(words >= 0, (words >> 1) % n_classes, n_classes)
            before, at = framed(kinds, bounds, n_classes + 1)
            sums += np.bincount(before * full + at, minlength=full * full)
        yield cell_batch(sums)

    return summed(arrow_map(texts.select("ids", "tail"), kernel, "cell int, n long"), full)


def train(
    docs: DataFrame, learn: Column, stage: Stage, doc_id: str = "doc_id", text: str = "text",
    head_words: int = HEAD_WORDS, n_classes: int = CLASSES, class_words: int = CLASS_WORDS,
) -> tuple[ClassModel, DataFrame]:
    """Fit the model on the rows where ``learn`` holds; also gives all rows as indexed texts."""
    learn = F.coalesce(learn, F.lit(False))
    training = docs.where(learn)
    counts = stage.put(word_counts(columns_of(training, ("text", F.col(text)))), "counts")
    clustered = F.col("n") >= LEAST_COUNT
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(clustered)).first()
    threshold = max(LEAST_COUNT, head_threshold(counts, head_words))
    head = counts.where(F.col("n") >= threshold).toArrow()  # at most head_words rows of 16 bytes
    words, n = head.column("word").to_numpy(), head.column("n").to_numpy().astype(np.int64)
    ranked = np.lexsort((words, -n))
    words, n = words[ranked].view(np.uint64), n[ranked]
    ids = (2 * np.arange(len(words)) + ((words >> np.uint64(40)) & np.uint64(1)).astype(np.int64)).astype(np.int32)
    order = np.argsort(words)
    indexed = stage.put(indexed_texts(docs, words[order], ids[order], doc_id, text, {"learn": learn}), "indexed")
    below = counts.where(F.col("n") < threshold)
    known = below.where(~clustered).select("word", "n", F.lit(OPEN).cast("long").alias("id"))
    n_words = int(totals[2])
    if n_words > len(words):
        turn = F.shiftright("word", 40).bitwiseAND(1)
        further = stage.put(numbered(
            below.where(clustered).withColumn("less", -F.col("n")), stage, ["less", "word"], label="tail-order").select(
            "word", "n", (2 * (F.col("_slot") + len(words)) + turn).alias("id")), "tail-ids")
        known = known.unionByName(further)
    texts = stage.put(with_others(indexed, known), "texts")
    stage.drop("indexed", "tail-order")
    learned = texts.where("learn")
    ends = learned.count()
    reach = min(n_words, max(class_words, len(words)))
    classes = (np.arange(reach) % n_classes).astype(np.min_scalar_type(n_classes))
    tail = None
    if n_words > reach:
        tail = stage.put(further.where(F.col("id") >= 2 * reach).select(
            "id", (F.shiftright("id", 1) % n_classes).cast("int").alias("class")), "tail-0")
    stage.drop("counts", "tail-ids")
    n_hot = int(np.searchsorted(-n, -HOT_COUNT))
    follows = transition_counts(learned, n_classes)
    blocks = stage.put(word_blocks(learned, int(totals[0]), n_hot), "blocks")
    classes, follows, tail = exchange(blocks, classes, tail, follows, n_hot, n_classes, stage)
    stage.drop("blocks", "pairs")
    n_tokens, distinct = int(totals[0]) + ends, int(totals[1]) + (1 if ends else 0)
    frequency = (follows.sum(axis=0) + 1) / (follows.sum() + n_classes + 2)
    transitions = (follows + SMOOTHING * frequency) / (follows.sum(axis=1, keepdims=True) + SMOOTHING)
    open_tokens, open_words = int(follows[:, n_classes].sum()), int(totals[1]) - n_words
    model = ClassModel(
        words, n, classes, np.log10(transitions), n_tokens, distinct, ends, open_tokens + open_words + 1,
        follows[:, :n_classes].sum(axis=0), tail)
    return model, texts


def score(texts: DataFrame, model: ClassModel) -> DataFrame:
    """Scores of indexed texts: doc_id, learn, n_tokens, n_known, base_score, score.

    base_score is the add-one unigram. Counts came with the texts; classes beyond the broadcast are joined.
    """
    n_classes, ends = len(model.transitions) - 2, model.ends
    open_log = float(np.log10(model.open_total))
    norm = float(np.log10(model.train_tokens + model.distinct + 1))
    held = texts.sparkSession.sparkContext.broadcast((
        model.counts, model.classes, model.transitions, np.log10(np.maximum(model.class_total, 1))))
    key = texts.schema["doc_id"].dataType.simpleString()
    if model.tail is not None:
        tail = texts.select("rid", F.explode("tail").alias("w")).select("rid", "w.*").join(model.tail, "id", "left")
        tail = tail.groupBy("rid").agg(F.collect_list(F.struct("k", "n", "id", "class")).alias("tail"))
        texts = texts.drop("tail").join(tail, "rid", "left")

    def kernel(batches):
        counts, classes, transitions, class_log = held.value
        for part, ids, bounds in token_runs(batches):
            n = part.num_rows
            row = np.repeat(np.arange(n), np.diff(bounds))
            words, count = ids.astype(np.int64), np.zeros(len(ids))
            other, (count[other], words[other], *joined) = other_words(part, ids, bounds)
            head = np.flatnonzero(ids >= 0)
            count[head] = counts[ids[head] >> 1]
            kinds = kinds_of(words, classes, n_classes)
            if joined:
                kinds[other] = np.where(joined[0] >= 0, joined[0], kinds[other])
            before, at = framed(kinds, bounds, n_classes + 1)
            every = np.concatenate([row, np.arange(n)])
            steps = transitions[before, at]
            words_at = np.arange(len(ids)) + row
            ends_at = bounds[1:] + np.arange(n)
            total = np.bincount(every, weights=np.concatenate([steps[words_at], steps[ends_at]]), minlength=n)
            base = np.log10(count + 1.0)
            emission = base - open_log
            classed = np.flatnonzero(kinds < n_classes)
            emission[classed] = np.log10(count[classed]) - class_log[kinds[classed]]
            total += np.bincount(row, weights=emission, minlength=n)
            n_tokens = np.diff(bounds) + 1
            yield pa.RecordBatch.from_arrays([
                *[part.column(part.schema.get_field_index(c)) for c in ("doc_id", "learn")], pa.array(n_tokens),
                pa.array(np.bincount(row[count > 0], minlength=n) + (1 if ends else 0)),
                pa.array(np.bincount(row, weights=base, minlength=n) + np.log10(ends + 1.0) - n_tokens * norm),
                pa.array(total),
            ], ["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"])

    return arrow_map(texts.select("doc_id", "learn", "ids", "tail"), kernel,
                     f"doc_id {key}, learn boolean, n_tokens long, n_known long, base_score double, score double")


def class_scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Fit on the rows where ``learn`` holds and score all rows.

    Per input row: doc_id, learn, n_tokens (words and one end), n_known (tokens seen in
    training), train_tokens, base_score (add-one unigram), score (log10 probability under
    the class model), perplexity. Null texts are empty: one end token. Rows repeated as a
    whole are each scored and each learnt from. Without training rows the transitions are
    even and all words are unseen. Equal counts are ranked by the word's hash. An empty
    table gives no rows.
    """
    stage = Stage(docs.sparkSession)
    model, texts = train(docs, learn, stage, doc_id, text, **settings)
    return score(texts, model).withColumns({
        "train_tokens": F.lit(model.train_tokens).cast("long"),
        "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")),
    })
