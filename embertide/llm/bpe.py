"""BPE encoding and decoding (operator 12): a backtracking encoder and an offset-table decoder.

A sequence of tokens is what the merges make of its bytes exactly if every two neighbours are
compatible, that is, if the two alone would be encoded as themselves. The encoder therefore takes the longest
token at each place, steps to the next shorter one where it does not go with the token before
it, and steps back where none does. A place from which it had to step back is never tried again, as the
encoding of what lies before it is unique, so the steps are linear in the length. Longest tokens
come from an Aho-Corasick automaton over the reversed tokens, run once from the end of a piece.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import arrow_map, columns_of, pieces, text_buffer
from embertide.llm.spans import SpanMemory, gathered, text_ids

# Fixed: the splitting pattern of byte-level encoders.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = 0x530  # below it, character classes do not depend on the Unicode version of a library
REMEMBERED = 300_000  # pairs of tokens, and steps of the automaton, that a task remembers; beyond, it starts afresh


def byte_characters() -> dict[str, int]:
    """Byte of each character that stands for one in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for U+0100 and on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_tables(path: str) -> tuple:
    """Encoder and decoder tables of a tokenizer file, as plain arrays that can be broadcast.

    Takes byte-level BPE files with the built-in splitting and added tokens without rules of
    their own; anything else is an error. A token that its own bytes do not encode to can never
    be put out and is left out of the automaton.
    """
    with open(path, encoding="utf-8") as source:
        spec = json.load(source)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split.get("add_prefix_space") and spec["normalizer"] is None
        and not any(model.get(k) for k in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    special = spec["added_tokens"]
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
        raise ValueError("only plain byte-level BPE files can be encoded by backtracking")
    byte_of = byte_characters()
    vocabulary = model["vocab"]
    size = max([*vocabulary.values(), *[t["id"] for t in special]]) + 1
    marks = {t["content"]: t["id"] for t in special}
    texts = [b""] * size
    for token, i in vocabulary.items():
        if i not in marks.values():
            texts[i] = bytes(byte_of[c] for c in token)
    made, left, right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    pairs = np.zeros((len(model["merges"]), 2), np.int64)
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        i, j, k = vocabulary[a], vocabulary[b], vocabulary[a + b]
        if made[k] >= 0 or max(made[i], made[j]) >= rank:
            raise ValueError("merges must make each token once, from tokens made before it")
        made[k], left[k], right[k], pairs[rank] = rank, i, j, (i, j)
    rank_of = {(int(a), int(b)): r for r, (a, b) in enumerate(pairs)}
    used = [i for i in range(size) if texts[i] and (len(texts[i]) == 1 or (made[i] >= 0 and compatible(
        int(left[i]), int(right[i]), rank_of, made, left, right, int(made[i]))))]
    shorter = np.full(size, -1, np.int64)
    by_text = {texts[i]: i for i in used}
    for i in used:
        body = texts[i]
        shorter[i] = next((by_text[body[:n]] for n in range(len(body) - 1, 0, -1) if body[:n] in by_text), -1)
    for content, i in marks.items():
        texts[i] = content.encode()
    sizes = np.array([len(t) for t in texts], np.int64)
    return (*automaton({texts[i][::-1]: i for i in used}), pairs, made, left, right, shorter, sizes,
            np.frombuffer(b"".join(texts), np.uint8), sorted(marks.items()))


def automaton(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Aho-Corasick automaton: transition keys (state * 256 + byte) and targets, fall-back state
    of each state, and the longest word that ends there (-1: none)."""
    step, out = {}, [-1]
    for word, i in words.items():
        state = 0
        for byte in word:
            key = state << 8 | byte
            if key not in step:
                step[key] = len(out)
                out.append(-1)
            state = step[key]
        out[state] = i
    children = [[] for _ in out]
    for key, target in step.items():
        children[key >> 8].append((key & 255, target))
    back = [0] * len(out)
    queue = deque([0])
    while queue:
        state = queue.popleft()
        for byte, target in children[state]:
            if state:
                fall = back[state]
                while fall and fall << 8 | byte not in step:
                    fall = back[fall]
                back[target] = step.get(fall << 8 | byte, 0)
            if out[target] < 0:
                out[target] = out[back[target]]
            queue.append(target)
    return (np.array(list(step), np.int64), np.array(list(step.values()), np.int64),
            np.array(back, np.int64), np.array(out, np.int64))


def compatible(a: int, b: int, rank_of: dict, made, left, right, below: int | None = None) -> bool:
    """True if the bytes of token a, then b, are encoded as a, b (by merges of rank under ``below`` only).

    Goes back in time over the two tokens that meet at the border: a merge of theirs that comes before
    either is used up would have joined them. Of equal merges the one further left comes first.
    """
    end_a = end_b = len(rank_of) if below is None else below
    while True:
        rank = rank_of.get((a, b))
        if rank is not None and rank < end_a and rank <= end_b and (below is None or rank < below):
            return False
        if made[a] > made[b]:
            end_a, a = made[a], right[a]
        elif made[b] >= 0:
            end_b, b = made[b], left[b]
        else:
            return True


class Encoder:
    """Exact ids of spans of text; the tables come from ``load_tables``."""

    def __init__(self, tables: tuple, splitter=None):
        keys, targets, back, longest, pairs, made, left, right, shorter, sizes, _, marks = tables
        self.steps = dict(zip(keys.tolist(), targets.tolist()))
        self.step, self.steps_kept = dict(self.steps), len(self.steps) + REMEMBERED
        self.back, self.longest = back.tolist(), longest.tolist()
        self.rank_of = {(a, b): r for r, (a, b) in enumerate(pairs.tolist())}
        self.made, self.left, self.right = made.tolist(), left.tolist(), right.tolist()
        self.shorter, self.sizes = shorter.tolist(), sizes.tolist()
        self.marks = dict(marks)
        self.splitter, self.pattern = splitter, regex.compile(PATTERN)
        self.marked = regex.compile("|".join(
            regex.escape(m) for m in sorted(self.marks, key=len, reverse=True))) if marks else None
        self.fits = {}

    def longest_at(self, piece: bytes) -> list[int]:
        """The longest token that begins at each byte; steps once found by falling back are kept."""
        step, longest = self.step, self.longest
        found, state = [], 0
        for byte in reversed(piece):
            key = state << 8 | byte
            state = step.get(key)
            if state is None:
                state = self.fallen(key)
            found.append(longest[state])
        found.reverse()
        return found

    def fallen(self, key: int) -> int:
        """Target of a transition that the automaton reaches by falling back only."""
        state, byte, target = key >> 8, key & 255, None
        while state and target is None:
            state = self.back[state]
            target = self.step.get(state << 8 | byte)
        if len(self.step) >= self.steps_kept:
            self.step = dict(self.steps)
        self.step[key] = target = target or 0
        return target

    def piece_ids(self, piece: bytes) -> list[int]:
        longest, sizes, fits = self.longest_at(piece), self.sizes, self.fits
        n, at, out, token, last = len(piece), 0, [], longest[0], -1
        if sizes[token] == n:
            return [token]
        dead = bytearray(n + 1)  # places through which no encoding of the whole piece goes
        while True:
            end = at + sizes[token]
            if not dead[end]:
                fit = last < 0 or fits.get(last << 32 | token)
                if fit is None:
                    if len(fits) >= REMEMBERED:
                        fits.clear()
                    fit = compatible(last, token, self.rank_of, self.made, self.left, self.right)
                    fits[last << 32 | token] = fit
                if fit:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: give up the token before, and try a shorter one
                dead[at] = 1
                at -= sizes[last]
                token = self.shorter[out.pop()]
                last = out[-1] if out else -1

    def split(self, text: str) -> list[str]:
        if self.splitter is None or max(text) < chr(PLAIN):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def span_ids(self, span: bytes) -> list[int]:
        text = span.decode()
        if self.marked is None or not self.marked.search(text):
            return self.plain_ids(text)
        out, last = [], 0
        for m in self.marked.finditer(text):
            out += [*self.plain_ids(text[last:m.start()]), self.marks[m.group()]]
            last = m.end()
        return out + self.plain_ids(text[last:])

    def plain_ids(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.piece_ids(piece.encode())] if text else []

    def __call__(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.span_ids(s) for s in spans]
        return (np.array([i for ids in lists for i in ids], np.uint32),
                np.array([len(ids) for ids in lists], np.int64))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text, as the tokenizer file's own library gives them.

    Special tokens in a text are taken as such; none are added. Null and empty texts have no
    ids; repeated rows give repeated rows; an empty table gives none. A text of any length is encoded
    whole: a task holds one text, or 4 MB of shorter ones, and a bounded memory of spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_tables(path))

    def kernel(batches):
        from tokenizers import Tokenizer  # its character classes, for letters that came late to Unicode

        encoder = Encoder(shared.value, Tokenizer.from_file(path).pre_tokenizer)
        memory = SpanMemory(encoder)
        mark = next(iter(encoder.marks)).encode() if len(encoder.marks) == 1 else None
        if len(encoder.marks) > 1:  # several kinds of marks: no cuts inside a text
            def ids_of(raw, bounds):
                data = raw.tobytes()
                lists = [encoder.span_ids(data[a:b]) if b > a else [] for a, b in zip(bounds[:-1], bounds[1:])]
                return (np.array([i for ids in lists for i in ids], np.uint32),
                        np.array([len(ids) for ids in lists], np.int64))
        else:
            def ids_of(raw, bounds):
                return text_ids(raw, bounds, memory, mark)
        for batch in pieces(batches):
            ids, counts = ids_of(*text_buffer(batch.column(1)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))],
                ["doc_id", "ids"])

    rows = columns_of(docs, ("doc_id", F.col(doc_id)), ("text", F.col(text)))
    return arrow_map(rows, kernel, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text that its ids stand for.

    Every id is a stretch of one table of bytes, found by its offset. Bytes that are not UTF-8 become
    U+FFFD, as in the library; special tokens stay. Null ids give null, no ids an empty text;
    an id outside the vocabulary, or a null among the ids, is left out.
    """
    *_, sizes, table, _ = load_tables(path)
    at = np.cumsum(sizes) - sizes
    names = encoded.columns
    shared = encoded.sparkSession.sparkContext.broadcast((sizes, at, table))
    place = names.index(ids)

    def kernel(batches):
        sizes, at, table = shared.value
        for batch in batches:
            column = batch.column(place)
            flat = column.flatten()
            known = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.where((known < 0) | (known >= len(sizes)), len(sizes), known)
            width = np.append(sizes, 0)[known]
            data = gathered(table, np.append(at, 0)[known], width).tobytes()
            per_row = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(per_row)])].tolist()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([None if gone else t for gone, t in zip(nulls, texts)], pa.string())],
                [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return arrow_map(encoded, kernel, f"{schema}, decoded string")
