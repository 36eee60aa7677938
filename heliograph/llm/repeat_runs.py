"""Periodic runs of words: maximal pairs of an LCP-interval tree, and texts collapsed to a run's first period.

A run is a stretch of words with smallest period q that no neighbouring word extends, here of at least ``LEAST_LENGTH``
words and ``LEAST_PERIODS`` periods. Two equal stretches of words whose left words differ, and whose right words differ,
are a maximal pair. If they lie at most a third of their length apart, they overlap, and together are a whole run: there
is nothing left to extend. So a text's suffixes are sorted by doubling, its LCP intervals are merged from the bottom up,
smaller into larger, and a position looks for partners of other left words only as far as the interval's length allows.

A text is a row of one narrow stage: no shuffle, whatever the number of copies. Memory grows with the words of the longest
text (some 200 bytes for each), time with n log² n.
Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a row with a null doc_id is a row
like any other, but is never rewritten by :func:`planted_repeats`; repeated rows give repeated results; an empty table
gives no rows. Extra columns are kept, but for those named like results, which are replaced.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run, and its length in periods, at least.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Bytes of a text split into words at a time.
PIECE = 1 << 20
RESULTS = ("n_words", "runs", "collapsed")
_RUN = pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("period", pa.int64())])


def _split(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece: ASCII white space parts them."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and text[hi] not in b" \t\n\r\x0b\x0c":
            hi += 1
        yield text[lo:hi].split()
        lo = hi


def word_numbers(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word in order, and the words by number."""
    numbers: dict[bytes, int] = {}
    parts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in _split((text or "").encode())]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(numbers)


def _repeats(words: np.ndarray, size: int) -> bool:
    """Whether some ``size`` words may occur twice: sums of mixed numbers are equal for equal words."""
    if len(words) <= size:
        return False
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    code = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        code = code * np.uint64(0x94D049BB133111EB) + mixed[k : len(mixed) - size + 1 + k]
    code.sort()
    return bool((code[1:] == code[:-1]).any())


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common words of each with the next, by ranks of stretches of 1, 2, 4, ... words."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            break
        ranks.append(rank)
    one, two = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        size = 1 << k
        # a rank of 2^k words is only shared by whole stretches: a shorter suffix has its end in its key
        inside = np.flatnonzero((one + size <= n) & (two + size <= n))
        same = inside[ranks[k][one[inside]] == ranks[k][two[inside]]]
        common[same] += size
        one[same] += size
        two[same] += size
    return order, common


class _Interval:
    """Positions of one LCP interval in order, and those of each left word."""

    __slots__ = ("at", "by_left")

    def __init__(self, position: int, left: int):
        self.at = [position]
        self.by_left = {left: [position]}


def _merge(one: _Interval, two: _Interval, common: int, left: list[int], pairs: list[tuple[int, int, int]]) -> _Interval:
    """Join two children of an interval, and report the maximal pairs between them whose distance is short enough.

    Positions in reach of each other start overlapping repeats of one period, so that all but the first of them have the
    same left word: of other left words there is the first one, or all are reported. A search costs its result.
    """
    large, small = (one, two) if len(one.at) >= len(two.at) else (two, one)
    reach = common // (LEAST_PERIODS - 1)
    for mine, positions in small.by_left.items():
        same = large.by_left.get(mine, ())
        for x in positions:
            lo, hi = bisect_left(large.at, x - reach), bisect_right(large.at, x + reach)
            others = hi - lo
            if others and same:
                others -= bisect_right(same, x + reach) - bisect_left(same, x - reach)
            while others:
                y = large.at[lo]
                if left[y] != mine:
                    others -= 1
                    pairs.append((min(x, y), abs(x - y), common))
                lo += 1
    for mine, positions in small.by_left.items():
        held = large.by_left.setdefault(mine, [])
        for x in positions:
            insort(held, x)
            insort(large.at, x)
    return large


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a sequence of numbers, in order."""
    least = LEAST_LENGTH - LEAST_LENGTH // LEAST_PERIODS  # common words of a pair that can be a run, at least
    if not _repeats(words, least):
        return []
    order, common = suffix_order(words)
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return []
    left = [-1, *words[:-1].tolist()]
    pairs: list[tuple[int, int, int]] = []
    for tree in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        places, depths = order[tree[0] : tree[-1] + 2], common[tree]
        if np.diff(np.sort(places)).min() > depths.max() // (LEAST_PERIODS - 1):
            continue  # no two of its positions are near enough
        places, waiting = places.tolist(), []
        node = _Interval(places[0], left[places[0]])
        for depth, place in zip(depths.tolist(), places[1:]):
            while waiting and waiting[-1][0] >= depth:
                below, before = waiting.pop()
                node = _merge(before, node, below, left, pairs)
            waiting.append((depth, node))
            node = _Interval(place, left[place])
        while waiting:
            below, before = waiting.pop()
            node = _merge(before, node, below, left, pairs)
    shortest: dict[tuple[int, int], int] = {}  # multiples of a period make the same stretch
    for start, period, length in pairs:
        if length + period >= max(LEAST_LENGTH, LEAST_PERIODS * period):
            key = (start, length + period)
            shortest[key] = min(period, shortest.get(key, period))
    return sorted((start, length, period) for (start, length), period in shortest.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: a run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _collapse_batches(batches):
    for batch in batches:
        counts, runs, texts = [], [], []
        for text in batch.column("text").to_pylist():
            words, names = word_numbers(text)
            found = find_runs(words)
            kept = words[kept_words(len(words), found)] if found else words
            counts.append(len(words))
            runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
            texts.append(b" ".join(map(names.__getitem__, kept.tolist())).decode())
        names = [c for c in batch.schema.names if c not in RESULTS]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], [*names, *RESULTS])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, all ``runs`` (start, length, period) of ``text`` in order, and the ``collapsed`` text.

    The collapsed text holds, joined by one space, the words that no run contains after its first period.
    """
    kept = docs.drop(*RESULTS)
    shape = kept.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>"), "collapsed": F.lit("")}).schema
    return kept.mapInArrow(_collapse_batches, shape)


def repeated_tail(doc_id: int, text: str | None) -> str | None:
    """The text whose words from some place on repeat the first of them, place and period by a hash; most stay as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    words, names = word_numbers(text)
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    words[a:] = words[a + np.arange(n - a) % p]
    return b" ".join(map(names.__getitem__, words.tolist())).decode()


def _plant_batches(batches):
    for batch in batches:
        texts = [t if d is None else repeated_tail(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of about every tenth row, by a hash of its doc_id, made periodic from some word on."""
    return docs.mapInArrow(_plant_batches, docs.schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest (ties: first start, then period), digests of all and of the collapsed text."""
    found = collapse_runs(planted_repeats(docs.select("doc_id", F.col("text").cast("string").alias("text"))))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.k")).alias("length"), F.col("top.period").alias("period"), F.floor(F.lit(-1000) * F.col("top.k") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
