"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of a task's texts. Its words become symbols: words of the benchmark have numbers, all others end
a run. Runs keep only neighbouring words that are neighbours in some window too, since no window can cross others; the
remaining sequence is indexed, all windows are searched backward through wavelet-tree ranks, occurrences are located by
sampled suffix positions and carried back to the texts' words, and a text's spans are merged.

Windows come to the tasks in blocks of bounded size; a further block is a further narrow pass over the same rows, which
adds its spans to those found. No row is shuffled.

Defined cases: words are lower-cased A-Z, digits and all characters beyond ASCII. An item of fewer words than a window is
one window; an item without words or with a null text has none. An item with a null item_id hits words like any other and
is named nowhere. A null text has no words. Equal windows of several items count for each of them. Repeated rows stay;
empty tables on either side work; other columns are kept, but for n_words, spans and items, which are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import materialise, passes, ranges, text_buffers
from heliograph.llm.fm_index import FMIndex
from heliograph.llm.words import Words, mix

WINDOW = 10
#: Bytes of text in an indexed shard, and of benchmark text in a block of windows.
SHARD_BYTES, BLOCK_BYTES = 1_000_000, 8_000_000
#: Passes over blocks that run in one stage; then the rows found so far are written.
PASSES_AT_ONCE = 4
FOUND = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


class Phrases:
    """Numbered words, their allowed neighbours, and the different windows of each length with their items."""

    def __init__(self, items: tuple[tuple[str | None, str | None], ...], window: int):
        raw, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
        words = Words(raw, offsets)
        self.names = [name for name, _ in items]
        self.vocabulary, number = np.unique(words.code, return_inverse=True)
        number = number + 2  # 1 separates runs
        counts = np.diff(words.cuts)
        found: dict[int, dict[tuple, list[int]]] = {}
        pairs = []
        for i, n in enumerate(counts):
            own = number[words.cuts[i] : words.cuts[i + 1]]
            pairs.append(self.pair(own[:-1], own[1:]))
            for k in range(max(1, n - window + 1) if n else 0):
                owners = found.setdefault(min(n, window), {}).setdefault(tuple(own[k : k + window].tolist()), [])
                if not owners or owners[-1] != i:
                    owners.append(i)
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.windows = {n: np.array([*w], np.int64) for n, w in sorted(found.items())}
        self.owners = {n: ([*w.values()]) for n, w in sorted(found.items())}
        self.shortest = min(self.windows, default=0)

    @staticmethod
    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)


def _member(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """First words and lengths of all occurrences of windows, and each one's items, over the texts of a shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if not phrases.windows or not len(words.code):
        return none
    # most words of a shard are rare: a small table of hash bits turns them away before the search
    sieve = np.zeros(1 << 20, bool)
    sieve[(phrases.vocabulary >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(words.code >> np.uint64(44)).astype(np.int64)])
    at, known = _member(phrases.vocabulary, words.code[maybe])
    number = np.zeros(len(words.code) + 1, np.int64)
    number[maybe[known]] = at[known] + 2
    joined = (number[:-1] > 0) & (number[1:] > 0)
    joined[words.cuts[words.cuts > 0] - 1] = False
    near = np.flatnonzero(joined)
    _, allowed = _member(phrases.pairs, Phrases.pair(number[near], number[near + 1]))
    joined[near[~allowed]] = False
    inside = number[:-1] > 0
    head = inside & ~np.concatenate(([False], joined[:-1]))
    starts = np.flatnonzero(head)
    ends = np.flatnonzero(inside & ~joined) + 1
    long = ends - starts >= phrases.shortest
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return none
    # runs end to end, with a separator after each
    places = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.ones(int((sizes + 1).sum()), np.int64)
    source = np.zeros(len(text), np.int64)
    target, origin = ranges(places, sizes), ranges(starts, sizes)
    text[target], source[target] = number[origin], origin
    index = FMIndex(text)
    firsts, lengths, items = [], [], []
    for n, patterns in phrases.windows.items():
        lo, hi = index.search(patterns)
        some = np.flatnonzero(hi > lo)
        which, position = index.locate(lo[some], hi[some])
        firsts.append(source[position])
        lengths.append(np.full(len(position), n, np.int64))
        items += [phrases.owners[n][k] for k in some[which]]
    return np.concatenate(firsts), np.concatenate(lengths), items


def merged(first: np.ndarray, length: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans over ``total`` words."""
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + length, -1)
    hit = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
    return np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])


def find(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[Words, np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Words of the texts, the merged spans (never across texts) as word ranges, and the items of each text hit."""
    words = Words(raw, offsets)
    first, length, items = occurrences(words, phrases)
    text = np.searchsorted(words.cuts, first, "right") - 1
    # spans that meet at a border between texts stay apart
    begins, ends = merged(first + text, length, len(words.code) + len(offsets) - 1)
    owner = np.searchsorted(words.cuts + np.arange(len(words.cuts)), begins, "right") - 1
    hits: dict[int, set[str]] = {}
    for t, own in zip(text.tolist(), items):
        hits.setdefault(t, set()).update(phrases.names[i] for i in own if phrases.names[i] is not None)
    return words, begins - owner, ends - owner, hits


@functools.lru_cache(maxsize=2)
def _phrases(items: tuple[tuple[str | None, str | None], ...], window: int) -> Phrases:
    return Phrases(items, window)


def _find_batches(shared, window: int, text: str):
    def run(batches):
        phrases = _phrases(shared.value, window)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(text))
            for lo, hi in passes(offsets, SHARD_BYTES):
                words, begins, ends, hits = find(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], phrases)
                owner = np.searchsorted(words.cuts, begins, "right") - 1
                spans: list[list] = [[] for _ in range(hi - lo)]
                for t, a, b in zip(owner.tolist(), (begins - words.cuts[owner]).tolist(), (ends - words.cuts[owner]).tolist()):
                    spans[t].append((a, b))
                items = [sorted(hits.get(t, ())) for t in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                if "spans" in part.schema.names:  # an earlier block's results
                    for t, (old, names) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
                        if old:
                            every = np.array([*spans[t], *((s["first"], s["last"]) for s in old)], np.int64)
                            a, b = merged(every[:, 0], every[:, 1] - every[:, 0], int(every.max()) + 1)
                            spans[t] = [*zip(a.tolist(), b.tolist())]
                        items[t] = sorted({*items[t], *names})
                names = [c for c in part.schema.names if c not in ("n_words", "spans", "items")]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                cells = [[{"first": a, "last": b} for a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(words.cuts), pa.int64()), pa.array(cells, kind), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])

    return run


def _cut(part: np.ndarray, places: np.ndarray, words: Words, begins: np.ndarray, ends: np.ndarray) -> dict[int, bytes]:
    """The texts that have spans, without them."""
    owner = np.searchsorted(words.cuts, begins, "right") - 1
    whole, kept = part.tobytes(), {}
    order = np.searchsorted(owner, np.unique(owner))
    for lo, hi in zip(order, [*order[1:], len(owner)]):
        t = int(owner[lo])
        pieces, at = [], int(places[t])
        for a, b in zip(begins[lo:hi], ends[lo:hi]):
            pieces.append(whole[at : words.starts[a]])
            at = int(words.ends[b - 1])
        kept[t] = b"".join([*pieces, whole[at : places[t + 1]]])
    return kept


def _with_texts(batch: pa.RecordBatch, changed: dict[int, str]) -> pa.RecordBatch:
    if not changed:
        return batch
    column = batch.column("text")
    texts = column.to_pylist()
    for t, x in changed.items():
        texts[t] = x
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))


def _remove_batches(shared, window: int):
    """Removal with all phrases at hand: a text is cut until no window is left."""

    def run(batches):
        phrases = _phrases(shared.value, window)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            changed: dict[int, str] = {}
            for lo, hi in passes(offsets, SHARD_BYTES):
                part, places = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                which = np.arange(hi - lo)
                while True:  # words that come together where a span went may form a window again
                    words, begins, ends, _ = find(part, places, phrases)
                    if not len(begins):
                        break
                    kept = {int(which[t]): x for t, x in _cut(part, places, words, begins, ends).items()}
                    changed |= {lo + t: x.decode() for t, x in kept.items()}
                    which = np.array([*kept])
                    part = np.frombuffer(b"".join(kept.values()), np.uint8)
                    places = np.concatenate(([0], np.cumsum([len(x) for x in kept.values()])))
            yield _with_texts(batch, changed)

    return run


def _cut_batches(batches):
    """Texts without the spans found for them."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column("text"))
        spans, changed = batch.column("spans").to_pylist(), {}
        for lo, hi in passes(offsets, SHARD_BYTES):
            part, places = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            words = Words(part, places)
            ends = [(words.cuts[t] + x["first"], words.cuts[t] + x["last"]) for t in range(hi - lo) for x in spans[lo + t] or ()]
            if ends:
                begins, ends = (np.array(x, np.int64) for x in zip(*ends))
                changed |= {lo + t: x.decode() for t, x in _cut(part, places, words, begins, ends).items()}
        yield _with_texts(batch.select([c for c in batch.schema.names if c not in ("n_words", "spans", "items")]), changed)


def _blocks(benchmark: DataFrame) -> list[tuple[tuple[str | None, str | None], ...]]:
    """All items in blocks of bounded size; see :func:`_each_block`."""
    return [*_each_block(benchmark)]


def _each_block(benchmark: DataFrame) -> Iterator[tuple[tuple[str | None, str | None], ...]]:
    """Items in blocks of bounded size, one on the driver at a time; their number follows the benchmark's size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(-(-total // BLOCK_BYTES)) or 1
    own = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for b in range(count):
        yield tuple(sorted(((r["item_id"], r["text"]) for r in own.where(F.col("block") == b).collect()), key=lambda x: (x[0] or "", x[1] or "")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (with a string column text) with n_words, the merged spans of words hit, and the items that occur."""
    out = docs.drop("n_words", "spans", "items")
    spark = docs.sparkSession
    schema = out.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<struct<first:long,last:long>>"), "items": F.lit(None).cast("array<string>")}).schema
    for k, block in enumerate(_each_block(benchmark)):
        if k and k % PASSES_AT_ONCE == 0:
            out = materialise(out, "found")
        out = out.mapInArrow(_find_batches(spark.sparkContext.broadcast(block), window, "text"), schema)
    return out


def words_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the spans of words that are hit; n_chars, where there is one, follows the text.

    Removal goes on until no window is left, so that a cut never joins words into a new one. A benchmark of several
    blocks takes a round of passes for each step of that, in which all blocks' spans are found before any is cut, and only
    rows that a round has cut go into the next: the result is the same for any size of blocks.
    """
    first = [block for _, block in zip(range(2), _each_block(benchmark))]
    if len(first) == 1:
        out = docs.mapInArrow(_remove_batches(docs.sparkSession.sparkContext.broadcast(first[0]), window), docs.schema)
    else:
        del first
        # the caller's columns stand in a struct, so that none meets a result's name
        rows, done = docs.select(F.struct("*").alias("_row"), "text"), None
        while True:
            found = materialise(find_contamination(rows, benchmark, window), "removal")
            clean = found.where(F.size("spans") == 0).select("_row", "text")
            done = clean if done is None else done.unionByName(clean)
            hit = found.where(F.size("spans") > 0)
            if hit.isEmpty():
                break
            rows = hit.mapInArrow(_cut_batches, rows.schema)
        out = done.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
