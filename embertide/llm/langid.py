"""Language identification as mixture inference over byte n-grams (operator 5).

A document is taken as a mixture of languages: each n-gram occurrence comes from one of
them. Expectation-maximisation estimates the proportions, and the set of languages is
the one with the best likelihood less a penalty for every further language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import PIECE_BYTES, arrow_map, columns_of, mix, pieces, text_buffer

BUCKET_BITS = 16  # n-grams share 2**16 buckets, so a language's model has a fixed size
GRAM = 4  # bytes
TEXT_BYTES = 1_000_000  # text whose n-grams are held at a time
STEPS = 12  # rounds of expectation-maximisation
GROUP_CELLS = 1 << 14  # n-grams of the documents that are inferred together; a document with more is alone
PENALTY = 4.0  # nats of likelihood per log n-gram that a further language must gain
ALPHA = 0.1  # added to every bucket's count
MAX_LANGUAGES = 512  # the models of all languages are broadcast: 2**16 x 8 bytes each at most
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def gram_buckets(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram; a text is framed by spaces, other white space and digits are spaces.

    A single byte has one more space after it, so that it has an n-gram too.
    """
    counts = np.diff(bounds)
    n_rows = len(counts)
    frame = np.where(counts == 1, GRAM - 1, 2)
    edges = bounds + np.concatenate([[0], np.cumsum(frame)])
    framed = np.full(int(edges[-1]), 32, np.uint8)
    text = np.ones(len(framed), bool)
    text[edges[:-1]] = text[edges[1:] - 1] = text[edges[1:][counts == 1] - 2] = False
    framed[text] = raw
    framed[(framed < 33) | ((framed >= 48) & (framed <= 57))] = 32
    if len(framed) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = framed[:1 - GRAM].astype(np.uint32)
    for k in range(1, GRAM):
        code |= framed[k:len(code) + k].astype(np.uint32) << np.uint32(8 * k)
    inside = np.ones(len(framed), bool)
    for k in range(1, GRAM):  # the last places of a row begin no n-gram
        inside[np.maximum(edges[1:] - k, 0)] = False
    bucket = (mix(code[inside[:len(code)]].astype(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)
    return bucket, np.repeat(np.arange(n_rows), np.maximum(np.diff(edges) + 1 - GRAM, 0))


def lowered_texts(batch) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pc.utf8_lower(batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())))


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms and probabilities, languages x buckets; a further bucket stands for no n-gram (probability 1)."""
        log_p = np.append(self.log_p.T, np.zeros((len(self.languages), 1)), axis=1)
        return log_p, np.exp(log_p)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None) -> LanguageModel:
    """Count n-grams by language over all rows with a label (and ``where``).

    Tasks add up before anything moves: one row per task and language, whose size is fixed
    by the number of buckets, then one row per language. Null texts add nothing. Every
    label that occurs is a language, with the uniform model if its texts are empty.
    """
    kept = docs if where is None else docs.where(where)
    rows = columns_of(
        kept.where(F.col(lang).isNotNull()), ("text", F.col(text)), ("lang", F.col(lang).cast("string")))

    def kernel(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in pieces(batches, limit=PIECE_BYTES):
            langs = batch.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            bucket, row = gram_buckets(*lowered_texts(batch))
            code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] << BUCKET_BITS | bucket
            summed = np.bincount(code, minlength=len(names) << BUCKET_BITS).reshape(len(names), -1)
            for name, c in zip(names, summed):
                counts[name] = counts.get(name, 0) + c
        for name, c in counts.items():
            used = np.flatnonzero(c)
            for part in range(1 << 4):
                own = used[used >> (BUCKET_BITS - 4) == part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(c[own], pa.int64())],
                    ["lang", "bucket", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([-1], pa.int32()), pa.array([1], pa.int64())], ["lang", "bucket", "n"])

    sums = arrow_map(rows, kernel, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(
        F.collect_list(F.struct("bucket", "n")).alias("cells")).limit(MAX_LANGUAGES + 1).collect()
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the label column does not hold languages")
    languages = sorted(r["lang"] for r in packed)
    counts = np.full((1 << BUCKET_BITS, len(languages)), ALPHA)
    for r in packed:
        k = languages.index(r["lang"])
        for bucket, n in r["cells"]:
            if bucket >= 0:
                counts[bucket, k] += n
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)) if languages else counts)


def like_sized(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Positions in groups of about equal size that hold at most ``GROUP_CELLS`` cells, or one position."""
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    start = 0
    while start < len(order):
        widest = ranked[start] + ranked[start] // 4 + 8
        stop = int(np.searchsorted(ranked, widest, side="right"))
        stop = min(stop, start + max(1, GROUP_CELLS // int(widest)))
        yield order[start:stop]
        start = stop


def expectation_maximisation(p, n, total, share, steps: int = STEPS):
    """Proportions and log-likelihood per document; languages of share 0 stay out.

    p: documents x languages x n-grams, n: documents x n-grams, 0 where a document has fewer (p is 1 there).
    """
    for _ in range(steps):
        norm = np.matmul(share[:, None, :], p)[:, 0]
        share = share * np.matmul(p, (n / norm)[:, :, None])[:, :, 0] / total[:, None]
    norm = np.matmul(share[:, None, :], p)[:, 0]
    return share, (n * np.log(norm)).sum(axis=1)


def chosen_shares(p, single, n, total) -> np.ndarray:
    """Proportions of the chosen languages of documents of about equal size (see ``expectation_maximisation``).

    single: log-likelihood of each document in each language alone.
    """
    docs, kinds = single.shape
    best = single.argmax(axis=1)
    chosen = np.zeros((docs, kinds))
    chosen[np.arange(docs), best] = 1.0
    if kinds == 1:
        return chosen
    likelihood = single[np.arange(docs), best]
    cost = PENALTY * np.log(total + 1)
    # the full mixture tells which languages to try, in order of their proportion
    full, bound = expectation_maximisation(p, n, total, np.full((docs, kinds), 1 / kinds))
    active = np.flatnonzero(bound > likelihood + cost)  # no smaller set can gain more than the full one
    wanted = np.argsort(-full, axis=1, kind="stable")
    size = 1
    while len(active) and size < kinds:
        size += 1
        share = np.zeros((len(active), kinds))
        np.put_along_axis(share, wanted[active][:, :size], 1 / size, axis=1)
        share, value = expectation_maximisation(p[active], n[active], total[active], share)
        better = value - cost[active] > likelihood[active]
        won = active[better]
        chosen[won], likelihood[won] = share[better], value[better] - cost[won]
        active = won
    return chosen


def infer(model: LanguageModel, bucket: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Proportions (rows x languages) of each row's chosen languages; zero rows without n-grams.

    Rows of about equal size are taken together, so a group's numbers stay in the cache, and
    memory is bounded by the buckets of one row however long its text is.
    """
    shares = np.zeros((n_rows, len(model.languages)))
    code, n = np.unique(row.astype(np.int64) << BUCKET_BITS | bucket, return_counts=True)
    if not len(code) or not model.languages:
        return shares
    rows, cells = code >> BUCKET_BITS, code & ((1 << BUCKET_BITS) - 1)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    present, sizes = rows[starts], np.diff(np.append(starts, len(rows)))
    log_p, p = model.tables
    for group in like_sized(sizes):
        place = np.arange(int(sizes[group].max()))
        inside = place < sizes[group][:, None]
        at = np.where(inside, starts[group][:, None] + place, 0)
        own, count = np.where(inside, cells[at], 1 << BUCKET_BITS), np.where(inside, n[at], 0).astype(float)
        single = np.stack([(table[own] * count).sum(axis=1) for table in log_p], axis=1)
        shares[present[group]] = chosen_shares(
            np.stack([table[own] for table in p], axis=1), single, count, count.sum(axis=1))
    return shares


def identify(
    docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score (its proportion, 0 to 1), languages and shares of every row.

    A text that is null, empty or without any letter is ``und`` with score 0 and no
    languages. Ties go to the language that sorts first. Whole texts are read.
    """
    rows = columns_of(docs, ("doc_id", F.col(doc_id)), ("text", F.col(text)))
    key_type = rows.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))  # readable without this package

    def kernel(batches):
        model = LanguageModel(*held.value)  # its tables are made once a task
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in pieces(batches, limit=TEXT_BYTES):
            texts = batch.column(1).cast(pa.large_string())
            letters = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()], bool)
            shares = infer(model, *gram_buckets(*lowered_texts(batch)), batch.num_rows)
            known = letters & (shares.sum(axis=1) > 0)
            shares[~known] = 0
            top = np.where(known, shares.argmax(axis=1) if model.languages else 0, len(model.languages))
            score = np.where(known, shares.max(axis=1, initial=0.0), 0.0)
            found = [np.flatnonzero(s > 0.005) for s in shares]
            found = [f[np.argsort(-s[f], kind="stable")] for f, s in zip(found, shares)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(names[top], pa.string()), pa.array(np.clip(score, 0, 1)),
                pa.array([names[f].tolist() for f in found], pa.list_(pa.string())),
                pa.array([s[f].tolist() for f, s in zip(found, shares)], pa.list_(pa.float64())),
            ], ["doc_id", "lang_pred", "score", "languages", "shares"])

    return arrow_map(
        rows, kernel,
        f"doc_id {key_type}, lang_pred string, score double, languages array<string>, shares array<double>")


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    """Whether the crc32 of the id as text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
