"""Edit-aware token counts.

A document's pre-tokens lie in the leaves of a segment tree that sums characters and tokens. An edit finds the last
boundary that it can't have moved, splits the text anew from there, and stops at the first boundary that the old split
has as well; only that stretch is counted again, and only the sums above its leaves change.

Trees are kept: :func:`build_trees` gives a table of documents with their leaves, which is written once. Edits take rows
of that table and give rows of the same form, for further edits. Nothing but the stretches that edits touch is split or
counted again. The sums above the leaves aren't kept: they are added up anew from the kept leaves when a row is read, by
numpy; the pre-tokens of a leaf that no edit reaches are not looked at one by one.

The byte-level pattern looks at most two characters past a pre-token's end, and never back, so the boundaries up to two
characters before an edit hold, and from a common boundary after it all later ones do. Strings of special tokens count as
ordinary text.

Edits (start, removed, inserted) of a document apply one after the other, each to the text that the one before left.
Places beyond the text's end are drawn back to it; null fields are 0 or empty; a null text is empty; null edits are none.
Rows stay, repeated ones too. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import materialise, passes, text_buffers
from heliograph.llm.pretokens import Distinct, boundaries, code_points
from heliograph.llm.token_ids import model_ids

LEAF, KEPT_WORDS = 32, 150_000
# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)


class WordCounts:
    """Numbers of tokens of pre-tokens, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for word, ids in zip(new, model_ids(self.model, new)):
            self.known[word] = len(ids)
        return [self.known[w] for w in words]


@functools.lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


class Leaves:
    """Leaves of a tree, (lengths, counts) each; one that nothing has asked for stays a part of the kept arrays."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self.lengths, self.counts, self.read = lengths, counts, {}
        self.size = max(1, -(-len(lengths) // LEAF))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> tuple[list[int], list[int]]:
        if i not in self.read:
            own = slice(i * LEAF, i * LEAF + LEAF)
            self.read[i] = self.lengths[own].tolist(), self.counts[own].tolist()
        return self.read[i]

    def __setitem__(self, i: int, leaf: tuple[list[int], list[int]]) -> None:
        self.read[i] = leaf

    def sums(self) -> tuple[list[int], list[int]]:
        if not len(self.lengths):
            return [0], [0]
        at = np.arange(0, len(self.lengths), LEAF)
        return tuple(np.add.reduceat(x, at, dtype=np.int64).tolist() for x in (self.lengths, self.counts))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """All lengths and counts as they are now."""
        parts, at = ([], []), 0
        for i in sorted(self.read):
            for k, kept in enumerate((self.lengths, self.counts)):
                parts[k].append(kept[at : i * LEAF])
                parts[k].append(np.array(self.read[i][k], np.int64))
            at = i * LEAF + LEAF
        return tuple(np.concatenate([*part, kept[at:]]) for part, kept in zip(parts, (self.lengths, self.counts)))


class CountTree:
    """Segment tree over leaves of pre-tokens (lengths, counts); a node sums characters and tokens below it."""

    def __init__(self, text: str, lengths, counts, count):
        self.text, self.count, self.counted = text, count, 0
        self._build(np.asarray(lengths, np.int64), np.asarray(counts, np.int64))

    def _build(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.leaves = Leaves(lengths, counts)
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        empty = [0] * (self.width - len(self.leaves))
        below = [[*x, *empty] for x in self.leaves.sums()]
        levels = [below]
        while len(levels[-1][0]) > 1:
            levels.append([[a + b for a, b in zip(x[::2], x[1::2])] for x in levels[-1]])
        self.chars, self.tokens = ([0] + [v for level in reversed(levels) for v in level[k]] for k in (0, 1))

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pretokens(self) -> int:
        return len(self.leaves.lengths) + sum(len(own) - len(self.leaves.lengths[i * LEAF : i * LEAF + LEAF]) for i, (own, _) in self.leaves.read.items())

    def _find(self, place: int) -> tuple[int, int, int]:
        """Leaf and pre-token with the last boundary at or before ``place``, and that boundary."""
        node, at = 1, 0
        while node < self.width:
            node *= 2
            if at + self.chars[node] <= place and self.chars[node + 1]:
                at += self.chars[node]
                node += 1
        leaf = min(node - self.width, len(self.leaves) - 1)
        for k, n in enumerate(self.leaves[leaf][0]):
            if at + n > place:
                return leaf, k, at
            at += n
        return leaf, len(self.leaves[leaf][0]), at

    def _set(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(lengths), sum(counts)
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = max(0, min(start, len(self.text)))
        removed = max(0, min(removed, len(self.text) - start))
        leaf, k, at = self._find(max(0, start - 2))
        old_end, shift = start + removed, len(inserted) - removed
        self.text = self.text[:start] + inserted + self.text[old_end:]
        words: list[str] = []
        pieces = (m[0] for m in _SPLIT.finditer(self.text, at))
        head = (self.leaves[leaf][0][:k], self.leaves[leaf][1][:k])
        first, new, old = leaf, at, at
        while True:
            # the old split moves on to at least where the new one is, and the new one past the edit
            while old < old_end or old + shift < new:
                if k == len(self.leaves[leaf][0]):
                    if leaf + 1 == len(self.leaves):
                        break
                    leaf, k = leaf + 1, 0
                    continue
                old += self.leaves[leaf][0][k]
                k += 1
            if new >= start + len(inserted) and old >= old_end and new == old + shift:
                break
            word = next(pieces, None)
            if word is None:
                break
            words.append(word)
            new += len(word)
        counts = self.count(words)
        self.counted += len(words)
        tail = (self.leaves[leaf][0][k:], self.leaves[leaf][1][k:])
        lengths = [*head[0], *map(len, words), *tail[0]]
        numbers = [*head[1], *counts, *tail[1]]
        for i in range(first + 1, leaf + 1):
            self._set(i, [], [])
        self._set(first, lengths, numbers)
        if len(lengths) > 8 * LEAF:  # a long insertion: spread the leaves anew
            self._build(*self.leaves.arrays())


def _tree_batches(path: str):
    """Adds each text's leaves: lengths of pre-tokens and their token counts, as little-endian unsigned 32-bit integers."""

    def run(batches):
        count = word_counts(path)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in passes(offsets):
                points, places = code_points(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                starts = boundaries(points, places)
                tokens = Distinct(points, starts)
                each = np.zeros(len(starts), np.int64)
                each[tokens.first] = count(tokens.words())
                each = each[tokens.first[tokens.of]] if len(starts) else each
                cuts = np.searchsorted(starts, places)
                leaves = [pa.array([x[cuts[i] : cuts[i + 1]].astype("<u4").tobytes() for i in range(hi - lo)], pa.binary()) for x in (np.asarray(tokens.lengths), each)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *leaves], [*part.schema.names, "lengths", "counts"])

    return run


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` with ``lengths`` and ``counts``, the leaves of each text's tree: the table to keep, with its texts."""
    kept = docs.drop("lengths", "counts").withColumn("text", F.col("text").cast("string"))
    return kept.mapInArrow(_tree_batches(tokenizer), kept.withColumns({"lengths": F.lit(b""), "counts": F.lit(b"")}).schema)


RESULTS = ["tokens_before", "tokens_after", "pretokens_after", "pretokens_counted", "n_chars_after"]


def _edit_batches(path: str):
    def run(batches):
        count = word_counts(path)
        for batch in batches:
            found, texts, leaves = [], [], ([], [])
            for text, edits, *own in zip(*(batch.column(c).to_pylist() for c in ("text", "edits", "lengths", "counts"))):
                tree = CountTree(text or "", *(np.frombuffer(x, "<u4") for x in own), count)
                before = tree.total
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                found.append((before, tree.total, tree.pretokens, tree.counted, len(tree.text)))
                texts.append(tree.text)
                for out, x in zip(leaves, tree.leaves.arrays()):
                    out.append(x.astype("<u4").tobytes())
            kept = [c for c in batch.schema.names if c not in ("text", "edits", "lengths", "counts", *RESULTS)]
            new = [pa.array(texts, pa.string()), *(pa.array(x, pa.binary()) for x in leaves), *(pa.array([f[k] for f in found], pa.int64()) for k in range(len(RESULTS)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "text", "lengths", "counts", *RESULTS])

    return run


def apply_edits(trees: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of a kept table with a column edits, array of (start, removed, inserted), after their edits.

    Texts and leaves are those after the edits, ready for further ones; five columns count tokens before and after,
    pre-tokens after, pre-tokens that the edits made the tree count again, and characters after.
    """
    rows = trees.withColumn("edits", F.col("edits").cast("array<struct<start:long,removed:long,inserted:string>>"))
    kept = rows.drop("text", "edits", "lengths", "counts", *RESULTS)
    schema = kept.withColumns({"text": F.lit(""), "lengths": F.lit(b""), "counts": F.lit(b""), **{c: F.lit(0).cast("long") for c in RESULTS}}).schema
    return rows.mapInArrow(_edit_batches(tokenizer), schema)


def count_edited(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text, edits array of (start, removed, inserted)) before and after their edits.

    Trees are built and written first, and the edits read them back. ``pretokens_counted`` is what the edits made the
    tree count again.
    """
    trees = materialise(build_trees(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits"), tokenizer), "count-trees")
    return apply_edits(trees, tokenizer).select("doc_id", *RESULTS)


def derived_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits of each text, placed by hashes of its id: an insertion, a deletion, a replacement."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), n + 1)
    own = lambda k, size: F.coalesce(F.substring(F.col("text"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), n + 1) + 1).cast("int"), F.lit(size)), F.lit(""))
    edit = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return docs.withColumn("edits", F.array(edit(place(1), 0, own(2, 60)), edit(place(3), 45, F.lit("")), edit(place(4), 20, own(5, 25))))
