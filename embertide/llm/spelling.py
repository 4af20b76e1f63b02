"""Spelling variant grouping (operator 11): words one error apart, found in FM-indexes of the vocabulary.

Two words at distance one agree on the left or on the right half of the longer one. Words are dealt by a
hash of their halves, so that both meet in one part of the vocabulary; each part is indexed and searched there,
either half exactly and the other with one error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import Stage, arrow_map, columns_of, lowered, pieces, span_hashes, text_buffer
from embertide.llm.fm_index import Index, near_words
from embertide.session import checked_broadcast

LEAST_LENGTH, LEAST_COUNT = 7, 2  # code points and occurrences of a word
RATIO = 10  # a form occurs at least so many times as often
DROP_EVERY = 31  # one code point of every run whose hash this divides is deleted
PART_SYMBOLS = 1 << 20  # symbols of the words in one index, about; a half that exceeds it is spread over several
HELD_WORDS = 300_000  # distinct words a task counts before it hands them on
LONG_RUN = 64  # bytes; longer runs are hashed one by one
HALVES = 1_000_000  # halves (two longs) that may be broadcast; beyond, the join shuffles


# --- words -----------------------------------------------------------------------------


def letter_runs(raw: np.ndarray, bounds: np.ndarray):
    """Start, end, row and length in code points of maximal runs of A-Z, a-z and U+00C0 to U+00FF.

    In UTF-8 the latter are the byte C3 and one more.
    """
    n = len(raw)
    inside = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    lead = raw == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1, ends - starts - (leads[ends] - leads[starts])


def crc_table() -> np.ndarray:
    """The table of the CRC-32 polynomial, by its rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def run_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run's bytes, continued from the CRC-32 of what stands before them."""
    table, size = crc_table(), ends - starts
    out = ~before
    short = np.flatnonzero(size <= LONG_RUN)
    short = short[np.argsort(-size[short], kind="stable")]
    crc, place, left = out[short], starts[short], size[short]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))  # runs longer than j
        crc[:n] = table[(crc[:n] ^ raw[place[:n] + j]) & 0xFF] ^ crc[:n] >> np.uint32(8)
    out[short] = crc
    out = ~out
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        out[i] = zlib.crc32(raw[starts[i]:ends[i]].tobytes(), int(before[i]))
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all words of the texts with at least LEAST_LENGTH code points.

    Runs of letters are lower-cased (A-Z only). Where DROP_EVERY divides the CRC-32 of the UTF-8 of
    ``<doc_id>:<run>``, code point CRC % length of the run is left out. A null doc_id is the empty string.
    Tasks add up before anything is shuffled.
    """
    def kernel(batches):
        held: dict[bytes, int] = {}

        def out():
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for batch in pieces(batches):
            raw, bounds = text_buffer(batch.column(1))
            if not len(raw):
                continue
            raw = lowered(raw)
            starts, ends, row, length = letter_runs(raw, bounds)
            able = length >= LEAST_LENGTH
            starts, ends, row, length = starts[able], ends[able], row[able], length[able]
            ids = [b"" if i is None else str(i).encode() for i in batch.column(0).to_pylist()]
            before = np.array([zlib.crc32(i + b":") for i in ids], np.uint32)[row]
            crcs = run_crcs(raw, starts, ends, before)
            cut = crcs % DROP_EVERY == 0
            data = raw.tobytes()
            for i in np.flatnonzero(cut & (length > LEAST_LENGTH)).tolist():
                run = data[starts[i]:ends[i]].decode()
                at = int(crcs[i]) % len(run)
                word = (run[:at] + run[at + 1:]).encode()
                held[word] = held.get(word, 0) + 1
            a, b = starts[~cut], ends[~cut]
            _, first, n = np.unique(span_hashes(raw, a, b), return_index=True, return_counts=True)
            for x, y, m in zip(a[first].tolist(), b[first].tolist(), n.tolist()):
                word = data[x:y]
                held[word] = held.get(word, 0) + m
            if len(held) >= HELD_WORDS:
                yield from out()
        if held:
            yield from out()

    rows = columns_of(docs, ("doc_id", F.col(doc_id)), ("text", F.col(text)))
    return arrow_map(rows, kernel, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- near words ------------------------------------------------------------------------


def halves(words: DataFrame) -> DataFrame:
    """A row for each half by which a word is dealt: its hash, the side, and whether the word is looked up by it.

    A word looks for equally long and for shorter words by its own halves; as a shorter word it is found by
    the halves of a word that has one code point more.
    """
    size = F.length("word")
    middle = F.floor(size / 2).cast("int")

    def part(left: bool, length, asks: bool):
        text = F.substring("word", F.lit(1), length) if left else F.substring("word", size - length + 1, length)
        return F.struct(
            F.xxhash64(F.lit(left), text).alias("half"), F.lit(left).alias("on_left"), F.lit(asks).alias("asks"))

    odd = size % 2 == 1
    dealt = F.array(
        part(True, middle, True), part(False, size - middle, True),
        F.when(odd, part(True, middle + 1, False)).otherwise(part(False, size - middle + 1, False)))
    return words.select("word", "n", F.inline(dealt))


def near_pairs(words: DataFrame, stage: Stage) -> DataFrame:
    """(word, near, near_n) for all words at distance one, in both directions, some of them more than once.

    Halves are packed into parts of about PART_SYMBOLS symbols by hash; the words of a half that
    alone exceeds this are spread over several parts, and looked up in each of them.
    """
    weight = F.sum(F.length("word").cast("long") + 1)
    dealt = halves(words)
    total = words.agg(F.coalesce(3 * weight, F.lit(0))).first()[0]
    parts = -(-total // PART_SYMBOLS) or 1
    large = dealt.groupBy("half").agg(weight.alias("w")).where(F.col("w") > PART_SYMBOLS).select(
        F.col("half").alias("h"), F.ceil(F.col("w") / PART_SYMBOLS).cast("int").alias("shares"))
    large = checked_broadcast(stage.put(large, "large"), HALVES)
    placed = dealt.join(large, dealt["half"] == large["h"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("shares")).cast("int")
    placed = placed.withColumn("own", own).withColumn(
        "share", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array("own"))))
    placed = placed.select(
        F.pmod(F.xxhash64("half", "share"), F.lit(parts)).alias("part"), "word", "n", "on_left", "asks",
        (F.col("share") == F.col("own")).alias("indexed"))

    def kernel(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table["word"].to_pylist()
        flags = np.stack([table[c].to_numpy() for c in ("on_left", "asks", "indexed")]).astype(bool)
        counts = dict(zip(texts, table["n"].to_pylist()))
        indexed = sorted({t for t, inside in zip(texts, flags[2]) if inside})
        outside = sorted({t for t, asks in zip(texts, flags[1]) if asks} - set(indexed))
        if not indexed:
            return pairs_table([], [], counts)
        every = indexed + outside
        number = {t: i for i, t in enumerate(every)}
        symbols = [symbols_of(t) for t in every]
        asked = [np.array(sorted({number[t] for t, left, asks in zip(texts, *flags[:2]) if asks and left == side}),
                          np.int64) for side in (True, False)]
        found = near_words(Index(symbols[:len(indexed)]), symbols, *asked)
        return pairs_table([every[i] for i in found[:, 0].tolist()], [every[i] for i in found[:, 1].tolist()], counts)

    return placed.repartition(parts, "part").groupBy("part").applyInArrow(
        kernel, "word string, near string, near_n long")


def symbols_of(word: str) -> np.ndarray:
    """1 to 26 for a-z, 27 to 90 for U+00C0 to U+00FF: the order of code points."""
    codes = np.frombuffer(word.encode("latin-1"), np.uint8)
    return np.where(codes < 128, codes - 96, codes - 165).astype(np.uint8)


def pairs_table(longer: list[str], shorter: list[str], counts: dict) -> pa.Table:
    """Both directions; equally long words are found from either side already."""
    back = [(b, a) for a, b in zip(longer, shorter) if len(a) != len(b)]
    words, near = longer + [a for a, _ in back], shorter + [b for _, b in back]
    return pa.table({"word": pa.array(words, pa.string()), "near": pa.array(near, pa.string()),
                     "near_n": pa.array([counts[w] for w in near], pa.int64())})


# --- forms -----------------------------------------------------------------------------


def roots(forms: DataFrame, stage: Stage) -> DataFrame:
    """word and root: the last of the forms that follow from the word's.

    A form occurs RATIO times as often as its word, so chains end; every step doubles their reach.
    """
    held = stage.put(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = held.select(F.col("word").alias("w"), F.col("root").alias("r"))
        moved = stage.put(held.join(on, held["root"] == on["w"], "left").select(
            "word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        held = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return held


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word of the texts that occurs twice or more, and the frequent spelling it is a variant of.

    Per word: n (occurrences), n_near (words at distance one: one code point inserted, deleted or replaced), form (the near
    word that occurs most often, of equals the first in code-point order, if RATIO times as often as the word;
    else null), form_n, and root (the last of a chain of forms, or the word itself). Null and
    empty texts have no words, repeated rows count again, an empty table gives no rows.
    """
    stage = Stage(docs.sparkSession)
    words = stage.put(word_counts(docs, doc_id, text).where(F.col("n") >= LEAST_COUNT), "words")
    pairs = near_pairs(words, stage).repartition("word").dropDuplicates(["word", "near"])
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = stage.put(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    found = words.join(near, "word", "left")
    fits = -F.col("best.minus") >= RATIO * F.col("n")
    found = stage.put(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")), "found")
    root = roots(found.where("form is not null"), stage)
    return found.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
