"""Words of whole batches of UTF-8 texts with numpy: runs of digits, lower-cased A-Z and all bytes beyond ASCII."""

from __future__ import annotations

import numpy as np

from heliograph.llm.pretokens import powers

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])


class Words:
    """Byte ``starts`` and ``ends`` of all words, a 64-bit ``code`` of each, and each text's range ``cuts`` of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        inside = _IN_WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        after = np.concatenate((inside[1:], [False])) if len(raw) else inside
        self.starts = np.flatnonzero(inside & (~before | edge[: len(raw)]))
        self.ends = np.flatnonzero(inside & (~after | edge[1 : len(raw) + 1])) + 1
        self.cuts = np.searchsorted(self.starts, offsets)
        forth, back = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * forth[: len(raw)], out=sums[1:])
        self.code = mix((sums[self.ends] - sums[self.starts]) * back[self.starts])


def mix(code: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes (a fixed invertible mixer)."""
    code = (code ^ (code >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code ^ (code >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return code ^ (code >> np.uint64(31))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``size`` words end to end, and each text's offsets; a shorter text has one run of all its words."""
    counts = np.diff(words.cuts)
    code, n = words.code, len(words.code)
    width = np.minimum(counts, size)
    number = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    offsets = np.concatenate(([0], np.cumsum(number)))
    starts = np.repeat(words.cuts[:-1] - offsets[:-1], number) + np.arange(offsets[-1])
    widths = np.repeat(width, number)
    total = np.zeros(len(starts), np.uint64)
    for k in range(size):
        term = mix(code[np.minimum(starts + k, max(n - 1, 0))] + np.uint64(2 * k + 1)) if n else total
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(widths > k, term, np.uint64(0))
    return mix(total + widths.astype(np.uint64)), offsets
