"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Every reduced word gets its whole neighbourhood: itself and all words one
deleted, replaced or inserted symbol away. The neighbourhoods join the reduced vocabulary, and the words behind the two
reduced words are compared as they are. An edit of a word edits its reduced word at most once, so no pair is lost; the
more symbols, the fewer pairs are compared for nothing and the larger the neighbourhoods.

Words are counted in tasks, then summed by word, so that a frequent word is a few rows. Joins are on codes of reduced
words, 64-bit sums whose rare collisions only add comparisons; a reduced word with many words behind it is a skewed join,
which Spark splits. A variant's form has at least ``FORM_RATIO`` times its occurrences, so chains to a root are short:
they are followed by doubling.
Defined cases: null and empty texts have no words; repeated rows count again; a row with a null doc_id is counted like
any other; an empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import discard, materialise
from heliograph.llm.pretokens import powers
from heliograph.llm.words import mix

#: Symbols of the reduced alphabet; code points and occurrences of a word, and occurrences of a form against its variant's, at least.
SYMBOLS, LEAST_CHARS, LEAST_COUNT, FORM_RATIO = 8, 6, 5, 5
#: Different words that a task counts before it hands them on; neighbours made at a time.
HELD_WORDS, NEIGHBOURS_AT_ONCE = 500_000, 2_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def runs_of_letters(text: str | None) -> list[str]:
    """Maximal runs of letters, A-Z lower-cased."""
    return _RUN.findall((text or "").encode("utf-8", "replace").translate(_LOWER).decode())


def without_one(doc_id: int, word: str) -> str:
    """The word, or, for about every 199th pair of document and word, the word less one letter: a planted misspelling."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 199:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, change: Callable[[int, str], str] | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n) of all words of ``least_chars`` or more in (doc_id, text); ``change`` rewrites a document's words first."""

    def run(batches):
        held: Counter[str] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in Counter(runs_of_letters(text.as_py())).items():
                    if change and doc_id is not None:
                        word = change(doc_id, word)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Reduced:
    """Words in the reduced alphabet: symbols end to end, ``cuts`` between words, and a 64-bit ``code`` of each word."""

    def __init__(self, words: list[str], symbols: int = SYMBOLS):
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.symbols = symbols
        self.cuts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        self.symbol = (mix(points.astype(np.uint64) + np.uint64(1)) % np.uint64(symbols)).astype(np.uint64)
        self.of = np.repeat(np.arange(len(words)), np.diff(self.cuts))
        self.place = np.arange(len(points)) - self.cuts[self.of]
        self.forth, self.back = powers(int(np.diff(self.cuts).max(initial=0)) + 2)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((self.symbol + np.uint64(1)) * self.forth[self.place], out=sums[1:])
        self.before = sums[:-1] - sums[self.cuts[:-1]][self.of]  # what stands left of each symbol
        self.total = sums[self.cuts[1:]] - sums[self.cuts[:-1]]
        self.code = mix(self.total)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and codes of all reduced words at most one edit away, each once."""
        every, at = np.arange(len(self.total)), self.place
        own, total, term = self.symbol, self.total[self.of], (self.symbol + np.uint64(1)) * self.forth[self.place]
        after = total - self.before - term
        fresh = np.ones(len(own), bool)  # of equal symbols in a row, deleting the first will do
        fresh[1:] = (own[1:] != own[:-1]) | (self.of[1:] != self.of[:-1])
        number, code = [every, self.of[fresh]], [self.total, (self.before + after * self.back[1])[fresh]]
        for s in range(self.symbols):
            put = np.uint64(s + 1)
            other = own != s
            number.append(self.of[other])
            code.append((total + (put - own - np.uint64(1)) * self.forth[at])[other])
            # before a symbol; behind one of its own kind it makes the same word, so only in front of it, and at the end
            first = (at == 0) | (np.concatenate(([0], own[:-1])) != s) if len(own) else other
            number.append(self.of[first])
            code.append((self.before + put * self.forth[at] + (term + after) * self.forth[1])[first])
            last = self.cuts[1:] - 1
            ends = (own[last] != s) if len(own) else np.zeros(0, bool)
            number.append(every[ends])
            code.append((self.total + put * self.forth[np.diff(self.cuts)])[ends])
        return np.concatenate(number), mix(np.concatenate(code))


def _code_batches(symbols: int):
    def run(batches):
        for batch in batches:
            code = Reduced(batch.column("word").to_pylist(), symbols).code.view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])

    return run


def _neighbour_batches(symbols: int):
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            lo = 0
            while lo < len(words):
                hi, size = lo, 0
                while hi < len(words) and (hi == lo or size < NEIGHBOURS_AT_ONCE):
                    size += 2 * symbols * (len(words[hi]) + 1)
                    hi += 1
                reduced = Reduced(words[lo:hi], symbols)
                number, near = reduced.neighbours()
                yield pa.RecordBatch.from_arrays([pa.array(reduced.code[number].view(np.int64)), pa.array(near.view(np.int64))], ["code", "near"])
                lo = hi

    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of different words (word, n) that one edit parts."""
    coded = words.select("word", "n").mapInArrow(_code_batches(symbols), "word string, n long, code long")
    reduced = coded.groupBy("code").agg(F.min("word").alias("word")).select("word")  # one word will do for each reduced word
    around = reduced.mapInArrow(_neighbour_batches(symbols), "code long, near long")
    met = around.join(coded.select(F.col("code").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n")), "near").drop("near")
    one_edit = F.levenshtein("word", "other", 1) == 1
    return coded.join(met, "code").where((F.abs(F.char_length("word") - F.char_length("other")) <= 1) & one_edit).select("word", "n", F.col("other").alias("near"), F.col("other_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last by doubling, a written table for each round."""
    held = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("over"))
        if held.join(on, "root", "left_semi").isEmpty():
            return held
        step = materialise(held.join(on, "root", "left").select("word", F.coalesce("over", "root").alias("root")), "roots")
        discard(held)
        held = step


def group_variants(counts: DataFrame, symbols: int = SYMBOLS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Forms and roots of the words of ``least_count`` occurrences or more among (word, n).

    Returns (word, n, n_near, form, form_n, root): the number of words one edit away; the most frequent of them (ties: the
    first in code-point order) if it has ``FORM_RATIO`` times the word's occurrences, else null; the end of the chain.
    """
    words = materialise(counts.where(F.col("n") >= least_count).select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near")))
    found = near_words(words, symbols).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    takes = -F.col("best.k") >= FORM_RATIO * F.col("n")
    found = materialise(found.select("word", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.k")).alias("form_n")), "near-words")
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
