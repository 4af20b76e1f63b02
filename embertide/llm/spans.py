"""Spans of text that a byte-level encoder treats alike wherever they stand, and a bounded memory of their ids.

The byte-level splitting pattern takes contractions, runs of letters, of digits and of other signs (each
with one space before it at most), and white space. Between two characters of different kinds it
always begins a new piece, whatever stands further left or right, so a text may be cut there and
its spans encoded one by one, equal spans once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from embertide.llm.common import span_hashes

OTHER, LETTER, DIGIT, SIGN, WHITE = range(5)
SLOTS = 1 << 20  # spans a task remembers at most; results do not depend on it
POOL_IDS = 8_000_000  # ids of remembered spans; beyond, those of spans no longer remembered are given up

_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = SIGN
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[[32, *range(9, 14)]] = WHITE


def kinds(raw: np.ndarray) -> np.ndarray:
    """Kind of every byte of UTF-8: ASCII and the letters U+00C0 to U+00FF; all else is OTHER."""
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # the signs U+00D7 and U+00F7
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def spans_of(raw: np.ndarray, bounds: np.ndarray, mark: bytes | None = None):
    """Start, end and row of spans that may be encoded one by one; together they are the whole texts.

    Cuts fall between letters, digits, signs and white space where both sides are known. An
    apostrophe stays with what follows, a space with what follows it, and a run of white space
    is whole unless it is one character other than a space. Every occurrence of ``mark``, which the
    encoder takes out before it splits, is a span of its own.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        kind = kinds(raw)
        left, right = kind[:-1], kind[1:]
        cut[1:n] = (left != right) & (left != OTHER) & (right != OTHER) & (left != WHITE)
        cut[1:n] &= (raw[:-1] != 39) | (right == WHITE)
        alone = np.zeros(n, bool)  # one white character, not a space, between characters of known kind
        alone[1:n - 1] = (right[:-1] == WHITE) & (raw[1:n - 1] != 32) & cut[1:n - 1] & (right[1:] != WHITE)
        alone[bounds[:-1][bounds[:-1] < n]] = False
        cut[1:n] |= alone[:-1] & (right != OTHER)
    if mark:
        data, at = raw.tobytes(), -1
        at = data.find(mark)
        while at >= 0:
            if np.searchsorted(bounds, at, side="right") == np.searchsorted(bounds, at + len(mark) - 1, side="right"):
                cut[at:at + len(mark)] = False
                cut[at] = cut[at + len(mark)] = True
                at = data.find(mark, at + len(mark))
            else:  # not within one text
                at = data.find(mark, at + 1)
    cut[bounds] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def one_piece(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each span is, after one space at most, a run of letters, of digits or of signs other than apostrophes.

    The splitting pattern takes such a span as one piece.
    """
    kind = kinds(raw) if len(raw) else np.zeros(0, np.uint8)
    first, sizes = bounds[:-1], np.diff(bounds)
    spaced = np.flatnonzero(sizes > 1)
    spaced = spaced[raw[first[spaced]] == 32]
    kind[first[spaced]] = kind[first[spaced] + 1]  # the space counts as what follows it
    odd = (kind == OTHER) | (kind == WHITE) | (raw == 39)
    odd[1:] |= kind[1:] != kind[:-1]
    begun = first[sizes > 0]
    odd[begun] = (kind[begun] == OTHER) | (kind[begun] == WHITE) | (raw[begun] == 39)
    found = np.concatenate([[0], np.cumsum(odd)])
    return (found[bounds[1:]] == found[first]) & (sizes > 0)


class SpanMemory:
    """Ids of spans by hash, in a table of fixed size; a newer span takes the slot of an older one.

    ``encode`` takes distinct spans (bytes) and gives all their ids and how many each has. Spans
    that occur often come back soon after they lost their slot, so they are encoded a few times a task.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], slots: int = SLOTS):
        self.encode, self.mask = encode, np.uint64(slots - 1)
        self.hashes, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        self.sizes = np.zeros(slots, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Place of ``ids`` in the pool, which grows by doubling."""
        place, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            grown = np.zeros(2 * self.used, np.uint32)
            grown[:place] = self.pool[:place]
            self.pool = grown
        self.pool[place:self.used] = ids
        return place

    def _compact(self) -> None:
        live = np.flatnonzero(self.sizes)
        ids = gathered(self.pool, self.at[live], self.sizes[live])
        self.at[live] = np.cumsum(self.sizes[live]) - self.sizes[live]
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self._keep(ids)

    def ids(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        """All ids of the spans one after the other, and how many each span has."""
        if self.used > POOL_IDS:
            self._compact()
        slot = (hashes & self.mask).astype(np.int64)
        at, sizes = self.at[slot], self.sizes[slot]
        new = np.flatnonzero((self.hashes[slot] != hashes) | (sizes == 0))
        if len(new):
            distinct, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            own = new[first]
            ids, counts = self.encode([data[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())])
            places = self._keep(ids) + np.cumsum(counts) - counts
            at[new], sizes[new] = places[inverse], counts[inverse]
            self.hashes[slot[own]], self.at[slot[own]], self.sizes[slot[own]] = distinct, places, counts
        return gathered(self.pool, at, sizes), sizes


def gathered(pool: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that begin at ``at``, one after the other."""
    shift = at - (np.cumsum(sizes) - sizes)
    return pool[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]


def text_ids(raw: np.ndarray, bounds: np.ndarray, memory: SpanMemory, mark: bytes | None = None):
    """All ids of the texts one after the other, and how many each text has."""
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
    starts, ends, row = spans_of(raw, bounds, mark)
    ids, sizes = memory.ids(raw.tobytes(), starts, ends, span_hashes(raw, starts, ends))
    return ids, np.bincount(row, weights=sizes, minlength=len(bounds) - 1).astype(np.int64)
