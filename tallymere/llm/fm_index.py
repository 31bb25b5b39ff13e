"""An FM-index over a sequence of numbers: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions.

Zeros separate stretches; patterns have none. Every zero counts as a symbol of its own, ordered by its place, so that
equal stretches differ at their ends and suffixes are soon told apart. All queries take many patterns at once.
"""

from __future__ import annotations

import numpy as np

#: A suffix position is kept for every so many places of the sequence, and for each start of a stretch.
SAMPLE_EVERY = 16


class Bits:
    """A bit vector with rank: 64 bits a word, and the ones before each word."""

    def __init__(self, flags: np.ndarray):
        self.n = len(flags)
        whole = np.zeros((self.n // 64 + 1) * 64, bool)
        whole[: self.n] = flags
        self.words = np.packbits(whole, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def suffix_order(s: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the suffixes of s in order; s ends in a zero, and zeros are ordered by their places.

    The first sort takes as many symbols as fit into 62 bits, 16 at most; then the compared length doubles, and only suffixes that
    are still tied are sorted again. Tied suffixes have no zero in what was compared, so none of them reaches past the end.
    """
    n, width = len(s), max(1, min(62 // bits, len(s), 16))
    key, alive = s.astype(np.int64), s != 0
    for k in range(1, width):
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = s[k:]
        ahead[~alive] = 0
        key = (key << bits) | ahead
        alive = alive & (ahead != 0)
    order = np.argsort(key, kind="stable")  # equal keys with a zero in them stay in the order of their places
    sorted_key = key[order]
    fresh = np.concatenate(([True], (sorted_key[1:] != sorted_key[:-1]) | ~alive[order[1:]]))
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
    compared = width
    while True:
        tied = np.flatnonzero(~fresh | np.concatenate((~fresh[1:], [False])))
        if not len(tied):
            return order
        at = order[tied]
        group = rank[at]
        key = group * np.int64(n + 1) + rank[at + compared]
        again = np.argsort(key, kind="stable")
        order[tied], key = at[again], key[again]
        fresh[tied] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        compared *= 2


class FmIndex:
    """Counts and finds patterns in s, an array of numbers from 0 to symbols - 1; a zero is added at its end."""

    def __init__(self, s: np.ndarray, symbols: int):
        s = np.concatenate((s, [0])).astype(np.int64)
        self.bits = max(1, int(symbols - 1).bit_length())
        order = suffix_order(s, self.bits)
        last = s[order - 1]  # the symbol before each suffix
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        start = np.concatenate(([True], s[:-1] == 0))
        kept = start[order] | (order % SAMPLE_EVERY == 0)
        self.kept, self.positions = Bits(kept), order[kept]
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for b in range(self.bits - 1, -1, -1):
            flags = (last >> b) & 1 == 1
            self.levels.append(Bits(flags))
            self.zeros.append(int(len(last) - np.count_nonzero(flags)))
            last = np.concatenate((last[~flags], last[flags]))
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places of the top level lie at the bottom among those of each symbol."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._down(symbol, at) - self.first[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the suffixes that begin with each pattern, by backward search; equal bounds: none.

        A pattern is a row; a shorter one has zeros in front.
        """
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        live = np.flatnonzero((self.counts[patterns[:, -1] + 1] > self.counts[patterns[:, -1]]) & (patterns[:, -1] > 0))
        low[live], high[live] = self.counts[patterns[live, -1]], self.counts[patterns[live, -1] + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = live[patterns[live, k] > 0]
            symbol = patterns[live, k]
            both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.counts[symbol] + both[: len(live)], self.counts[symbol] + both[len(live) :]
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: each goes back through the sequence until a place that is kept."""
        found, rows, todo, steps = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            here = self.kept.get(rows)
            found[todo[here]] = self.positions[self.kept.rank(rows[here])] + steps
            todo, rows, steps = todo[~here], rows[~here], steps + 1
            symbol, at = np.zeros(len(rows), np.int64), rows
            for level, zeros in zip(self.levels, self.zeros, strict=True):
                one, ones = level.get(at), level.rank(at)
                symbol = (symbol << 1) | one
                at = np.where(one, zeros + ones, at - ones)
            rows = self.counts[symbol] + at - self.first[symbol]
        return found
