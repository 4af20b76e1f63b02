"""A bidirectional FM-index over a delimited vocabulary, searched for many patterns in step.

A set of distinct words is indexed as one circular text, each word led by a delimiter. A pattern's
occurrences are an interval of suffix ranks; the index keeps the interval in the order of
the suffixes and in that of the reversed prefixes, so a pattern can be extended to either side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PACKED = 9  # symbols of 7 bits in one sort key
BITS = 7
DELIMITER = 0  # the smallest symbol; words hold symbols 1 to 127


def joined(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The circular text of ascending words, the word of each place, and the symbols left in its word."""
    sizes = np.array([len(w) for w in words], np.int64)
    text = np.zeros(int(sizes.sum()) + len(words), np.uint8)
    word = np.repeat(np.arange(len(words)), sizes + 1)
    heads = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), bool)
    inside[heads] = False
    text[inside] = np.concatenate(words)
    left = (heads + sizes + 1)[word] - np.arange(len(text))
    left[heads] = 0
    return text, word, left


def suffix_order(text: np.ndarray, word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of the text by the text that follows them.

    Delimiters come first, in the order of their words. Other places compare up to their word's end, then by
    the word that follows, which is the next one (the last word's is the first). Ranks of 9 symbols
    are doubled until they reach over the longest word.
    """
    heads = np.flatnonzero(left == 0)
    count = len(heads)
    inner = np.flatnonzero(left > 0)
    inner = inner[np.argsort((word[inner] + 1) % count, kind="stable")]  # stable sorts keep this order in ties
    key = np.zeros(len(inner), np.uint64)
    for j in range(PACKED):
        symbol = text[np.minimum(inner + j, len(text) - 1)]
        key = key << np.uint64(BITS) | np.where(left[inner] > j, symbol, 0).astype(np.uint64)
    reach, longest = PACKED, int(left.max())
    rank = np.full(len(text), -1, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        dense = np.zeros(len(inner), np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=dense[1:])
        if reach >= longest or (len(dense) and dense[-1] == len(inner) - 1):
            return np.concatenate([heads, inner[order]])
        rank[inner[order]] = dense
        further = np.where(left[inner] > reach, rank[np.minimum(inner + reach, len(text) - 1)], -1)
        key = rank[inner] * (len(text) + 2) + further + 1
        reach *= 2


class Symbols:
    """A sequence of symbols as a wavelet matrix: per bit, how many ones come before each place."""

    def __init__(self, symbols: np.ndarray):
        self.ones, self.zeros = [], []
        for bit in range(BITS - 1, -1, -1):
            ones = symbols >> bit & 1
            self.ones.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        counts = np.bincount(symbols, minlength=1 << BITS)
        self.shift = np.cumsum(counts) - counts  # place of a symbol's first row among all rows
        every = np.arange(1 << BITS)
        self.shift -= self.narrow(every, np.zeros_like(every), np.zeros_like(every))[0] - self.shift
        # narrow adds shift once; from here on it maps a place to its row

    def narrow(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The interval after a step by ``symbol``, and how many smaller symbols the old one holds."""
        smaller = np.zeros(len(low), np.int64)
        for level, bit in enumerate(range(BITS - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            low_ones, high_ones = ones[low], ones[high]
            up = (symbol >> bit & 1).astype(bool)
            low_zeros, high_zeros = low - low_ones, high - high_ones
            smaller += np.where(up, high_zeros - low_zeros, 0)
            low, high = np.where(up, zeros + low_ones, low_zeros), np.where(up, zeros + high_ones, high_zeros)
        move = self.shift[symbol]
        return low + move, high + move, smaller

    def branches(self, low: np.ndarray, high: np.ndarray):
        """All symbols in the intervals: number of the interval, symbol, interval after it, smaller symbols."""
        owner = np.arange(len(low))
        symbol, smaller = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for level in range(BITS):
            ones, zeros = self.ones[level], self.zeros[level]
            low_ones, high_ones = ones[low], ones[high]
            low_zeros, high_zeros = low - low_ones, high - high_ones
            none, some = high_zeros > low_zeros, high_ones > low_ones
            owner = np.concatenate([owner[none], owner[some]])
            smaller = np.concatenate([smaller[none], (smaller + high_zeros - low_zeros)[some]])
            low = np.concatenate([low_zeros[none], (zeros + low_ones)[some]])
            high = np.concatenate([high_zeros[none], (zeros + high_ones)[some]])
            symbol = np.concatenate([symbol[none] << 1, symbol[some] << 1 | 1])
        move = self.shift[symbol]
        return owner, symbol, low + move, high + move, smaller


@dataclass
class States:
    """Patterns in progress: owner, next place in its query, and both intervals (of equal size)."""

    owner: np.ndarray
    at: np.ndarray
    low: np.ndarray
    other: np.ndarray
    size: np.ndarray

    def pick(self, which: np.ndarray) -> States:
        return States(self.owner[which], self.at[which], self.low[which], self.other[which], self.size[which])

    @staticmethod
    def together(parts: list[States]) -> States:
        fields = ("owner", "at", "low", "other", "size")
        return States(*[np.concatenate([getattr(p, f) for p in parts] or [np.zeros(0, np.int64)]) for f in fields])


class Index:
    """``words`` are distinct arrays of symbols in ascending order; a word's number is its place among them."""

    def __init__(self, words: list[np.ndarray]):
        self.size = int(sum(len(w) + 1 for w in words))
        back = sorted((w[::-1] for w in words), key=bytes)
        self.before, self.after = self._preceding(words), self._preceding(back)

    @staticmethod
    def _preceding(words: list[np.ndarray]) -> Symbols:
        text, word, left = joined(words)
        return Symbols(text[suffix_order(text, word, left) - 1])

    def flipped(self) -> Index:
        """The index of the reversed words: left is right."""
        other = object.__new__(Index)
        other.size, other.before, other.after = self.size, self.after, self.before
        return other

    def all(self, owners: np.ndarray, at: np.ndarray) -> States:
        zero = np.zeros(len(owners), np.int64)
        return States(owners, at, zero, zero.copy(), np.full(len(owners), self.size, np.int64))

    def to_left(self, s: States, symbol: np.ndarray, at: np.ndarray) -> States:
        low, high, smaller = self.before.narrow(symbol, s.low, s.low + s.size)
        grown = States(s.owner, at, low, s.other + smaller, high - low)
        return grown.pick(np.flatnonzero(grown.size > 0))

    def to_right(self, s: States, symbol: np.ndarray, at: np.ndarray) -> States:
        low, high, smaller = self.after.narrow(symbol, s.other, s.other + s.size)
        grown = States(s.owner, at, s.low + smaller, low, high - low)
        return grown.pick(np.flatnonzero(grown.size > 0))

    def right_branches(self, s: States) -> tuple[np.ndarray, np.ndarray, States]:
        """Every extension by one symbol to the right: number of the state, symbol, new state."""
        owner, symbol, low, high, smaller = self.after.branches(s.other, s.other + s.size)
        return owner, symbol, States(s.owner[owner], s.at[owner], s.low[owner] + smaller, low, high - low)


def one_error_right(index: Index, flat: np.ndarray, start: np.ndarray, size: np.ndarray, half: np.ndarray):
    """Whole words that agree with a query's first ``half`` symbols and differ by one error after them.

    An error is a replaced symbol, or one that the word lacks. Queries are ``size`` symbols of
    ``flat`` from ``start``. The first half is matched outward from its end to the left and closed by the delimiter,
    then the pattern grows to the right. Gives numbers of queries and the words' states.
    """
    at = half.copy()
    s = index.all(np.arange(len(start)), at)
    anchored = []
    while len(s.owner):
        going = s.at > 0
        done = s.pick(np.flatnonzero(~going))
        if len(done.owner):
            anchored.append(index.to_left(done, np.full(len(done.owner), DELIMITER), half[done.owner]))
        s = s.pick(np.flatnonzero(going))
        s = index.to_left(s, flat[start[s.owner] + s.at - 1].astype(np.int64), s.at - 1)
    exact = States.together(anchored)
    wrong = []
    while True:  # exact so far: leave out a symbol, take another one, or go on
        exact = exact.pick(np.flatnonzero(exact.at < size[exact.owner]))
        if not len(exact.owner):
            break
        place = start[exact.owner] + exact.at
        due = flat[place].astype(np.int64)
        follows = np.where(exact.at + 1 < size[exact.owner], flat[np.minimum(place + 1, len(flat) - 1)], DELIMITER)
        left_out = exact.pick(np.flatnonzero(due != follows))  # of a run of equal symbols the last one
        left_out.at = left_out.at + 1
        number, symbol, others = index.right_branches(exact)
        others = others.pick(np.flatnonzero((symbol != due[number]) & (symbol != DELIMITER)))
        others.at = others.at + 1
        wrong += [left_out, others]
        exact = index.to_right(exact, due, exact.at + 1)
    s, found = States.together(wrong), []
    while len(s.owner):
        going = s.at < size[s.owner]
        done = s.pick(np.flatnonzero(~going))
        if len(done.owner):
            found.append(index.to_right(done, np.full(len(done.owner), DELIMITER), done.at))
        s = s.pick(np.flatnonzero(going))
        s = index.to_right(s, flat[start[s.owner] + s.at].astype(np.int64), s.at + 1)
    return States.together(found)


def near_words(index: Index, words: list[np.ndarray], first: np.ndarray, second: np.ndarray, chunk: int = 20_000):
    """(query, found) numbers of words that differ by a replaced symbol, or one that ``found`` lacks.

    Queries ``first`` match their first half exactly, queries ``second`` their second half; both
    halves part at the middle (the first is the shorter one).
    """
    pairs = []
    for numbers, right in ((first, True), (second, False)):
        way = index if right else index.flipped()
        for k in range(0, len(numbers), chunk):
            part = numbers[k:k + chunk]
            chosen = [words[i] if right else words[i][::-1] for i in part.tolist()]
            size = np.array([len(w) for w in chosen], np.int64)
            half = size // 2 if right else size - size // 2
            s = one_error_right(way, np.concatenate(chosen), np.cumsum(size) - size, size, half)
            pairs.append(np.stack([part[s.owner], s.low if right else s.other], axis=1))
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return np.unique(found, axis=0)
