"""FM-index over a sequence of symbols: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions.

All queries of a batch take each step side by side, as numpy arrays.
"""

from __future__ import annotations

import numpy as np

from heliograph.llm.common import ranges


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes still level with another are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while True:
        level = np.concatenate((~head[1:], [False])) | ~head
        at = np.flatnonzero(level)
        if not len(at):
            return order
        who = order[at]
        follow = np.where(who + width < n, rank[np.minimum(who + width, n - 1)], -1)
        group = rank[who]
        again = np.lexsort((follow, group))
        who, follow, group = who[again], follow[again], group[again]
        order[at] = who
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        head[at] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, at, 0))
        width *= 2


class FMIndex:
    """Index of ``symbols``, positive numbers; every ``step``-th position is kept for locating."""

    def __init__(self, symbols: np.ndarray, step: int = 8):
        text = np.append(np.asarray(symbols, np.int64), 0)
        self.n, self.step = len(text), step
        order = suffix_array(text)
        last = text[order - 1]
        top = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top))))
        self.bits = max(1, (top - 1).bit_length())
        self.ones, self.zeros = [], []
        level = last
        for k in reversed(range(self.bits)):
            bit = level >> k & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.marked = np.concatenate(([0], np.cumsum(order % step == 0)))
        self.samples = order[order % step == 0]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        lo = np.zeros_like(at)
        for k, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            bit = (symbol >> k & 1).astype(bool)
            one_lo, one_at = ones[lo], ones[at]
            lo, at = np.where(bit, zeros + one_lo, lo - one_lo), np.where(bit, zeros + one_at, at - one_at)
        return at - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns of one length, a row each, by backward search; a symbol of -1 is nowhere."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, column]
            ok = (symbol > 0) & (symbol < len(self.before) - 1)
            lo[alive[~ok]] = hi[alive[~ok]] = 0
            alive, symbol = alive[ok], symbol[ok]
            both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((lo[alive], hi[alive])))
            base = self.before[symbol]
            lo[alive], hi[alive] = base + both[: len(alive)], base + both[len(alive) :]
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the ranges and text positions of all their suffixes, by steps back to a sampled position."""
        owner, at = np.repeat(np.arange(len(lo)), hi - lo), ranges(lo, hi - lo)
        out = np.zeros(len(at), np.int64)
        open_, steps = np.arange(len(at)), 0
        while len(open_):
            found = self.marked[at + 1] > self.marked[at]
            out[open_[found]] = self.samples[self.marked[at[found]]] + steps
            open_, at = open_[~found], at[~found]
            symbol = self.symbol(at)
            at = self.before[symbol] + self.rank(symbol, at)
            steps += 1
        return owner, out
