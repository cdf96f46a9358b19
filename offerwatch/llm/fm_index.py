"""A compressed full-text index over words, in numpy.

The Burrows-Wheeler transform of a text is kept in a wavelet matrix: one plain
bit vector per bit of a word's number, with counts of ones before every 64
bits. Backward search, from the last word of a pattern to its first, narrows
the range of suffixes that begin with it; any number of patterns go on at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` in their order, by doubling the length they are compared on.

    Suffixes that are already alone are left out of the next sort.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)

    def ranked(keys: np.ndarray) -> np.ndarray:
        change = np.empty(len(keys), bool)
        change[:1] = True
        change[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(change, np.arange(len(keys)), 0)), change

    rank[order], change = ranked(text[order])
    width = 1
    open_ = np.flatnonzero(~(change & np.append(change[1:], True)))
    while len(open_) and width < n:
        suffixes = order[open_]
        after = suffixes + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffixes] * np.int64(n + 1) + second
        within = np.argsort(key, kind="stable")
        suffixes, key = suffixes[within], key[within]
        order[open_] = suffixes
        group = rank[suffixes]
        change = np.empty(len(key), bool)
        change[:1] = True
        change[1:] = key[1:] != key[:-1]
        new_group = np.empty(len(key), bool)
        new_group[:1] = True
        new_group[1:] = group[1:] != group[:-1]
        place = np.arange(len(key))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        rank[suffixes] = group + np.maximum.accumulate(np.where(change, place, 0)) - start
        alone = change & np.append(change[1:], True)
        open_ = open_[~alone]
        width *= 2
    return order


class Index:
    """Over passages (arrays of numbers from 0 to symbols - 1), each counting `weights` times."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, weights: np.ndarray, symbols: int):
        """`text` holds the passages one after the other, beginning at `starts`."""
        n, m = len(text), len(starts)
        lengths = np.diff(np.append(starts, n))
        owner = np.repeat(np.arange(m), lengths)
        place = np.arange(n) + owner
        laid = np.empty(n + m, np.int64)
        laid[place] = text + m  # each passage ends with a mark of its own, below all words
        laid[np.append(starts, n)[1:] + np.arange(m)] = np.arange(m)
        order = suffix_order(laid)
        of = np.empty(n + m, np.int64)
        of[place] = owner
        of[np.append(starts, n)[1:] + np.arange(m)] = np.arange(m)
        self.weight = np.zeros(n + m + 1, np.int64)
        np.cumsum(weights[of[order]], out=self.weight[1:])
        shifted = np.maximum(laid[order - 1] - m + 1, 0)  # all marks are symbol 0: no pattern holds one
        self.first = np.zeros(symbols + 2, np.int64)
        counts = np.bincount(text, minlength=symbols)
        self.first[1] = m
        np.cumsum(counts, out=self.first[2:])
        self.first[2:] += m
        self.bits: list[Bits] = []
        self.levels = max(1, int(symbols).bit_length())
        for level in range(self.levels - 1, -1, -1):
            bit = (shifted >> level) & 1
            self.bits.append(Bits(bit.astype(bool)))
            shifted = np.concatenate([shifted[bit == 0], shifted[bit == 1]])
        # where a symbol's run starts after the last level
        self.run = np.zeros(symbols + 1, np.int64)
        self.run[:] = self._walk(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            ones = bits.ones(place)
            place = np.where((symbol >> level) & 1 == 1, bits.zeros + ones, place - ones)
        return place

    def start(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that begin with a word."""
        return self.first[word + 1], self.first[word + 2]

    def back(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes low..high those with `word` before them, as suffixes that begin with it."""
        symbol = word + 1
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([low, high])) - np.tile(self.run[symbol], 2)
        base = self.first[symbol]
        return base + both[: len(word)], base + both[len(word) :]

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often, passages weighed, the pattern stands in the text."""
        return self.weight[high] - self.weight[low]


def matches(index: Index, text: np.ndarray, ends: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Matching statistics: for each end (a place in `text`) the first word of the longest stretch that
    ends there, starts at `floors` or later and stands twice or more in the index; end + 1 if there is none."""
    reached = ends + 1
    low, high = index.start(text[ends])
    at = ends.copy()
    lane = np.flatnonzero(index.count(low, high) > 1)
    low, high, at = low[lane], high[lane], at[lane]
    while len(lane):
        reached[lane] = at
        going = at > floors[lane]
        lane, low, high, at = lane[going], low[going], high[going], at[going] - 1
        if not len(lane):
            break
        low, high = index.back(text[at], low, high)
        going = index.count(low, high) > 1
        lane, low, high, at = lane[going], low[going], high[going], at[going]
    return reached
