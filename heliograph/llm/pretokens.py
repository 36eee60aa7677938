"""Byte-level pre-tokens of whole batches of texts with numpy.

The split follows the byte-level BPE pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: instead of running it as a
regular expression, class changes between neighbouring code points give the boundaries of a whole batch at once.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from heliograph.llm.common import ranges

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


@functools.cache
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


_kept_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse modulo 2**64, at least ``n`` of each; the longest so far are kept."""
    if not _kept_powers or len(_kept_powers[0]) < n:
        size = max(1 << 16, n + n // 8)
        both = []
        for step in (_STEP, _BACK):
            run = np.full(size, step, np.uint64)
            run[0] = 1
            both.append(np.multiply.accumulate(run))
        _kept_powers[:] = both
    return _kept_powers[0], _kept_powers[1]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts laid end to end, and the texts' offsets in code points."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, offsets
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, leads[offsets]


def boundaries(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start positions of all pre-tokens; no pre-token crosses from one text to the next."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    fresh[n] = True
    run = fresh[:n].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # a word after white space: the last white-space character stands apart, and a blank joins the word
    after = np.flatnonzero(run[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:n]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # an apostrophe that starts a pre-token takes a contraction's letters
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & ~fresh[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = points[quote + 1]
        two = np.where(~fresh[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for took, width in ((quote[single], 2), (quote[double], 3)):
            start[took + 1] = False
            ends = took + width
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Distinct:
    """Distinct pre-tokens of a batch: ``of`` maps each pre-token to its first equal one in ``first``."""

    def __init__(self, points: np.ndarray, starts: np.ndarray):
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        self.points, self.starts, self.lengths = points, starts, ends - starts
        if not len(starts):
            self.first = self.of = np.zeros(0, np.int64)
            self.codes = np.zeros(0, np.uint64)
            return
        forth, back = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * forth[: len(points)], out=sums[1:])
        code = (sums[ends] - sums[starts]) * back[starts]
        code ^= code >> np.uint64(29)
        self.codes, self.first, self.of = np.unique(code, return_index=True, return_inverse=True)
        rep = self.first[self.of]
        if not (np.array_equal(self.lengths[rep], self.lengths) and np.array_equal(points[ranges(starts[rep], self.lengths)], points[starts[0] :])):
            self._exact()
            self.codes = code[self.first]

    def checks(self) -> np.ndarray:
        """A second hash of each different pre-token, independent of ``codes``."""
        spread = (self.points.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        forth, back = powers(len(self.points) + 1)
        sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(spread * forth[: len(self.points)], out=sums[1:])
        at, size = self.starts[self.first], self.lengths[self.first]
        return (sums[at + size] - sums[at]) * back[at] + size.astype(np.uint64)

    def _exact(self) -> None:
        """Two different pre-tokens had equal hashes: tell them apart by their text."""
        seen: dict[str, int] = {}
        first: list[int] = []
        of = np.empty(len(self.starts), np.int64)
        for i, word in enumerate(self._words(np.arange(len(self.starts)))):
            if word not in seen:
                seen[word] = len(first)
                first.append(i)
            of[i] = seen[word]
        self.first, self.of = np.array(first, np.int64), of

    def _words(self, which: np.ndarray) -> list[str]:
        text = self.points.tobytes().decode("utf-32-le")
        return [text[a : a + n] for a, n in zip(self.starts[which].tolist(), self.lengths[which].tolist())]

    def words(self, which: np.ndarray | slice = slice(None)) -> list[str]:
        """Texts of the different pre-tokens, or of ``which`` of them."""
        return self._words(self.first[which])


class WordValues:
    """A memory from pre-tokens to short lists of numbers, in sorted arrays: some forty bytes a word.

    Words are known by two independent 64-bit hashes. Beyond ``most`` words all are forgotten.
    """

    def __init__(self, most: int):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.parts = [tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32)) for _ in range(2)]
        self.values, self.used = np.zeros(1 << 16, np.int32), 0

    def find(self, codes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in ``values`` and lengths; a start of -1 for words not known."""
        start, length = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
        for known, check, begin, size in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = (known[at] == codes) & (check[at] == checks)
                start[hit], length[hit] = begin[at[hit]], size[at[hit]]
        return start, length

    def add(self, codes: np.ndarray, checks: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        if sum(len(p[0]) for p in self.parts) + len(codes) > self.most:
            self._forget()
        if self.used + len(values) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros(len(self.values) + len(values), np.int32)))
        self.values[self.used : self.used + len(values)] = values
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(values)
        old, new = self.parts
        new = self._sorted(new, (codes, checks, begin, sizes.astype(np.int32)))
        if len(new[0]) > len(old[0]) // 4:
            old, new = self._sorted(old, new), tuple(a[:0] for a in new)
        self.parts = [old, new]

    @staticmethod
    def _sorted(one: tuple, two: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(one, two)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)
