"""An FM-index of a shard's words: suffix order, Burrows-Wheeler transform, wavelet ranks, backward search, locating, two-way extension.

A shard is an array of word numbers from 1; 0 ends a run, and no match crosses it. Searches and extensions take many intervals at a time.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits with the number of ones before every place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix: ranks of any symbol, and the distinct symbols of intervals, in as many steps as a symbol has bits."""

    def __init__(self, x: np.ndarray, sigma: int):
        self.sigma, self.shifts = sigma, range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bit = ((x >> shift) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(x) - int(np.count_nonzero(bit)))
            x = np.concatenate([x[~bit], x[bit]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bits, zeros, shift in zip(self.levels, self.zeros, self.shifts, strict=True):
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of its place."""
        return self._walk(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands in front of it."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            ones, bit = bits.ones(at), bits.get(at)
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]

    def symbols(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, its rank at low, its rank at high) for the distinct symbols of each interval, by interval and symbol."""
        owner, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = bits.ones(low), bits.ones(high)
            # each node becomes its two children, the one of the clear bit first; empty ones go
            pair = np.empty((2, len(low), 2), np.int64)
            pair[0, :, 0], pair[1, :, 0], pair[0, :, 1], pair[1, :, 1] = low - a, high - b, zeros + a, zeros + b
            low, high = pair[0].ravel(), pair[1].ravel()
            kept = np.flatnonzero(low < high)
            low, high, node = low[kept], high[kept], kept >> 1
            owner, symbol = owner[node], symbol[node] << 1 | (kept & 1)
        return owner, symbol, low - self.start[symbol], high - self.start[symbol]


def suffix_order(x: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of x, which ends in 0, by what follows: whole suffixes up to their first 0 (ties by place), or their first `depth` symbols at least.

    Prefixes are sorted three symbols long, then those that are still equal by twice as many, as often as needed.
    """
    n = len(x)
    if n == 0:
        return np.empty(0, np.int64)
    first = x.astype(np.int64)
    ends = np.flatnonzero(first == 0)
    first += len(ends) - 1
    first[ends] = np.arange(len(ends))  # each end is a symbol of its own
    width = max(1, int(first.max()).bit_length())
    reach = 3 if 3 * width <= 63 else 2
    tail = np.concatenate([first, np.zeros(2, np.int64)])
    key = first << width | tail[1 : n + 1]
    if reach == 3:
        key = key << width | tail[2 : n + 2]
    order = np.argsort(key)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    slots = np.flatnonzero(~head | ~np.r_[head[1:], True])
    while len(slots) and (depth is None or reach < depth):
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + reach, n - 1)]
        inner = np.argsort(key, kind="stable")
        key, at = key[inner], at[inner]
        order[slots] = at
        head = np.r_[True, key[1:] != key[:-1]]
        rank[at] = slots[np.flatnonzero(head)[np.cumsum(head) - 1]]
        slots = slots[~head | ~np.r_[head[1:], True]]
        reach *= 2
    return order


class Index:
    """x: word numbers, 0 at the ends of runs and at the very end. depth: longest phrase to be sought; None sorts whole suffixes, which locate() needs."""

    def __init__(self, x: np.ndarray, sigma: int, depth: int | None = None, sampled: int = 0):
        order = suffix_order(x, depth)
        self.size = len(x)
        self.first = np.zeros(sigma + 1, np.int64)  # rows that begin with a smaller symbol
        np.cumsum(np.bincount(x, minlength=sigma), out=self.first[1:])
        self.wavelet = Wavelet(x[order - 1], sigma)
        if sampled:
            at = (order % sampled == 0) | (x[order - 1] == 0)
            self.marked, self.places = Bits(at), order[at]

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the phrases with a symbol put before them."""
        return self.first[symbol] + self.wavelet.rank(symbol, low), self.first[symbol] + self.wavelet.rank(symbol, high)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of phrases, rows of numbers that end at the right: the last `lengths` columns of each count. 0 is a word that the shard lacks."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for step in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -step]
            low[live], high[live] = self.back(symbol, low[live], high[live])
            high[live[symbol == 0]] = 0
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows, by steps back to sampled suffixes."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            found = self.marked.get(rows)
            out[at[found]] = self.places[self.marked.ones(rows[found])] + steps
            at, rows = at[~found], rows[~found]
            symbol, rank = self.wavelet.access(rows)
            rows, steps = self.first[symbol] + rank, steps + 1
        return out


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, row) for every row of each interval."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]


class TwoWay:
    """Indexes of a shard and of the shard read backwards; an interval in both is extended at either end."""

    def __init__(self, x: np.ndarray, sigma: int, depth: int):
        self.sigma = sigma
        self.forth = Index(x, sigma, depth)
        self.back = Index(np.concatenate([x[-2::-1], x[-1:]]), sigma, depth)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, interval): low and high are pairs for the shard and for it read backwards, the same for one word."""
        word = np.flatnonzero(np.diff(self.forth.first)[1:]) + 1
        low, high = self.forth.first[word], self.forth.first[word + 1]
        return word, np.stack([low, low]), np.stack([high, high])

    def extend(self, low: np.ndarray, high: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, word, low, high): every interval with each word that stands at its right, or left, end."""
        ours, other = (1, 0) if right else (0, 1)
        index = self.back if right else self.forth
        owner, word, a, b = index.wavelet.symbols(low[ours], high[ours])
        # in the other index the extensions of an interval follow each other in the order of their words
        sizes = b - a
        before = np.cumsum(sizes) - sizes
        begins = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
        at = low[other][owner] + before - before[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        real = word > 0
        owner, word, a, b, at = owner[real], word[real], a[real], b[real], at[real]
        lows, highs = np.empty((2, len(owner)), np.int64), np.empty((2, len(owner)), np.int64)
        lows[ours], highs[ours] = index.first[word] + a, index.first[word] + b
        lows[other], highs[other] = at, at + b - a
        return owner, word, lows, highs
