"""BPE encoding through a minimal acyclic transducer of frequent words, and decoding.

Frequent pre-tokens of the whole corpus are compiled into a minimal acyclic automaton (equal suffixes are shared). Each
transition carries a number; the numbers along a word's path add up to the word's place in a table of id sequences, so
the automaton is a transducer from words to ids. Its arrays lie in one file that workers memory-map. A batch's different
words walk through it side by side; words that it lacks are merged exactly, pair by pair in rank order.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import discard, hashed_share, materialise, passes, ranges, text_buffers, worker_file
from heliograph.llm.pretokens import Distinct, boundaries, code_points

#: Words in the lexicon at most, and the occurrences that one needs. Other words are merged, with the same result.
LEXICON_WORDS, LEAST_COUNT = 1 << 16, 2
#: Bytes of a word in the lexicon at most, so that its size is bounded; longer words are merged.
LONGEST_WORD = 64
#: Different words that a counting task gathers before it hands them on.
GATHERED_WORDS = 200_000
_NONE = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The byte for each character that a byte-level vocabulary is written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab[char]
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in reversed([*enumerate(pairs)])}
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = (np.array([v[k] for v in self.rank.values()], np.int64)[order] for k in (0, 1))
        # a table from hashed pairs to places in keys; the few pairs that collide are found by binary search
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[self._hash(self.keys)] = np.arange(len(self.keys))
        self.lost = np.zeros(1 << 20, bool)
        at = self._hash(self.keys)
        self.lost[at[self.slots[at] != np.arange(len(self.keys))]] = True
        texts = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(texts) + 1
        self.text_ends = np.cumsum([len(texts.get(i, b"")) for i in range(size)])
        self.text_starts = self.text_ends - [len(texts.get(i, b"")) for i in range(size)]
        self.text = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in ``keys``; -1 for a pair that never merges."""
        keys = left << 32 | right
        at = self._hash(keys)
        place = self.slots[at].astype(np.int64)
        place[(place >= 0) & (self.keys[place] != keys)] = -1
        again = np.flatnonzero((place < 0) & self.lost[at])
        if len(again):
            near = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            place[again] = np.where(self.keys[near] == keys[again], near, -1)
        return place

    def one(self, word: bytes) -> list[int]:
        """Ids of one long word: the pair of lowest rank first, the leftmost of equal ones first."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after, gone = [*range(-1, n - 1)], [*range(1, n + 1)], [False] * n
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, made, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], gone[j], after[i] = made, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (p := (ids[a], ids[after[a]])) in self.rank:
                    heapq.heappush(heap, (*self.rank[p], a, p))
        return [x for x, out in zip(ids, gone) if not out]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words end to end and the number of each; every round merges each word's best pair."""
        sizes = np.array([len(w) for w in words], np.int64)
        out: list[np.ndarray | None] = [None] * len(words)
        for i in np.flatnonzero(sizes > 400):
            out[i] = np.array(self.one(words[i]), np.int64)
        active = np.flatnonzero(sizes <= 400)
        symbols = self.byte_id[np.frombuffer(b"".join(words[i] for i in active), np.uint8)]
        counts = sizes[active]
        done_ids, done_counts, done_who = [], [], []
        while len(active):
            starts = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(active)), counts)
            place = np.full(len(symbols), -1, np.int64)
            if len(symbols) > 1:
                place[:-1] = self.find(symbols[:-1], symbols[1:])
                place[np.append(starts[1:] - 1, len(symbols) - 1)] = -1
            ranks = np.where(place >= 0, self.ranks[place], _NONE)
            best = np.minimum.reduceat(ranks, starts)
            live = best < _NONE
            if not live.all():
                over = ~live[owner]
                done_ids.append(symbols[over]), done_counts.append(counts[~live]), done_who.append(active[~live])
                symbols, ranks, place, counts, active, best = symbols[~over], ranks[~over], place[~over], counts[live], active[live], best[live]
                if not len(active):
                    break
                owner = np.repeat(np.arange(len(active)), counts)
            hit = ranks == best[owner]
            at = np.flatnonzero(hit)
            # of equal pairs that overlap, the first, third, fifth ... merge
            chain = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
            first = np.searchsorted(chain, chain)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[place[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            counts = counts - np.bincount(owner[at], minlength=len(active))
            symbols = symbols[keep]
        lengths = np.zeros(len(words), np.int64)
        for who, n in zip(done_who, done_counts):
            lengths[who] = n
        for i, part in enumerate(out):
            if part is not None:
                lengths[i] = len(part)
        begin = np.cumsum(lengths) - lengths
        ids = np.zeros(int(lengths.sum()), np.int64)
        for who, n, got in zip(done_who, done_counts, done_ids):
            ids[ranges(begin[who], n)] = got
        for i, part in enumerate(out):
            if part is not None:
                ids[begin[i] : begin[i] + len(part)] = part
        return ids, lengths

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens."""
        return self.text[ranges(self.text_starts[ids], self.text_ends[ids] - self.text_starts[ids])].tobytes()


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def compile_transducer(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Minimal acyclic transducer of ``words`` (different ones) and their ids, as one .npy file.

    Words are added in byte order; a state whose words are complete is replaced by an equal one met before.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    known: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...))
    open_: list[list] = [[False, []]]
    previous = b""

    def close(depth: int) -> None:
        while len(open_) - 1 > depth:
            final, arcs = open_.pop()
            key = (final, tuple(arcs))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            arcs = open_[-1][1]
            arcs[-1] = (arcs[-1][0], known[key])

    for i in order:
        word = words[i]
        common = next((k for k, (a, b) in enumerate(zip(previous, word)) if a != b), min(len(previous), len(word)))
        close(common)
        for byte in word[common:]:
            open_[-1][1].append((byte, -1))
            open_.append([False, []])
        open_[-1][0] = True
        previous = word
    close(0)
    root = len(states)
    states.append((open_[0][0], tuple(open_[0][1])))
    below = np.zeros(len(states), np.int64)  # words that end at or below a state; targets come before their sources
    for s, (final, arcs) in enumerate(states):
        below[s] = final + sum(below[t] for _, t in arcs)
    keys, targets, numbers = [], [], []
    for s, (final, arcs) in enumerate(states):
        passed = int(final)
        for byte, t in arcs:
            keys.append(s << 8 | byte), targets.append(t), numbers.append(passed)
            passed += int(below[t])
    starts = np.cumsum(counts) - counts
    counts_in_order = np.asarray(counts, np.int64)[order] if order else np.zeros(0, np.int64)
    arrays = [
        np.array([root, len(states), len(keys), len(words)], np.int64), np.array(keys, np.int64), np.array(targets, np.int64), np.array(numbers, np.int64),
        np.array([f for f, _ in states], np.int64), np.cumsum(np.append(0, counts_in_order)), np.asarray(ids, np.int64)[ranges(starts[order] if order else starts, counts_in_order)],
    ]
    out = io.BytesIO()
    np.save(out, np.concatenate(arrays).astype(np.int32 if len(states) < 1 << 22 else np.int64))
    return out.getvalue()


class Transducer:
    """Memory-mapped arrays of :func:`compile_transducer`."""

    def __init__(self, path: str):
        flat = np.load(path, mmap_mode="r")
        self.root, states, arcs, words = (int(x) for x in flat[:4])
        cuts = np.cumsum([4, arcs, arcs, arcs, states, words + 1])
        self.keys, self.targets, self.numbers, self.final, self.ends, self.ids = np.split(flat, cuts)[1:]
        self.arcs = np.searchsorted(self.keys, np.arange(states + 1) << 8)

    def walk(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1 if it isn't in the lexicon; all words take a step at a time."""
        number = np.full(len(words), -1, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        alive, state, total, step = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), 0
        while len(alive) and len(self.keys):
            ended = sizes[alive] == step
            if ended.any():
                good = ended & (self.final[state] == 1)
                number[alive[good]] = total[good]
                alive, state, total = alive[~ended], state[~ended], total[~ended]
                if not len(alive):
                    break
            wanted = state << 8 | raw[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = self.keys[at] == wanted
            alive, at = alive[ok], at[ok]
            state, total = self.targets[at].astype(np.int64), total[ok] + self.numbers[at]
            step += 1
        return number


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _count_words(batches):
    gathered: dict[str, int] = {}

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(gathered), pa.string()), pa.array(list(gathered.values()), pa.int64())], ["word", "n"])
        gathered.clear()

    for batch in batches:
        raw, offsets = text_buffers(batch.column("text"))
        for lo, hi in passes(offsets):
            points, places = code_points(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            tokens = Distinct(points, boundaries(points, places))
            if not len(tokens.first):
                continue
            slot = np.zeros(len(tokens.of), np.int64)
            slot[tokens.first] = np.arange(len(tokens.first))
            counts = np.bincount(slot[tokens.first[tokens.of]], minlength=len(tokens.first))
            for word, n in zip(tokens.words(), counts.tolist()):
                gathered[word] = gathered.get(word, 0) + n
            if len(gathered) > GATHERED_WORDS:
                yield from out()
    if gathered:
        yield from out()


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The commonest pre-tokens of all texts; ``most`` of them at most reach the driver.

    How common a word must be comes from a histogram of counts on a logarithmic scale, some thousand bars at most, so
    that no task gathers or sorts the words. Of the first bar that doesn't fit whole, words are taken by a hash. Words
    of more than ``LONGEST_WORD`` bytes are left out.
    """
    counts = docs.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where((F.col("n") >= least) & (F.octet_length("word") <= LONGEST_WORD)).withColumn("bar", F.floor(64 * F.log2("n")).cast("int")), "word-counts")
    bars = sorted(((r["bar"], r["words"]) for r in counts.groupBy("bar").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    whole, part, share, total = [], None, 0.0, 0
    for bar, words in bars:
        if total + words > most:
            # a little less than what is left, since a hash doesn't share out exactly
            part, share = bar, max(0.0, (most - total - 4 * (most - total) ** 0.5) / words)
            break
        whole.append(bar)
        total += words
    taken = F.col("bar") >= whole[-1] if whole else F.lit(False)
    if part is not None:
        taken = taken | ((F.col("bar") == part) & hashed_share(share, "word"))
    found = sorted(counts.where(taken).select("word").toPandas()["word"])
    discard(counts)
    return found


def build_lexicon(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> bytes:
    words = [w.encode() for w in frequent_words(docs, most, least)]
    return compile_transducer(words, *merges(tokenizer).merge(words))


class Encoder:
    """Ids of texts by the lexicon, and by exact merges for the words that it lacks."""

    def __init__(self, lexicon: bytes, tokenizer: str):
        self.lexicon = transducer(worker_file(f"lexicon-{hashlib.sha256(lexicon).hexdigest()}.npy", lexicon))
        self.merges = merges(tokenizer)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number = self.lexicon.walk(words)
        known = number >= 0
        found = number[known]
        begin, end = self.lexicon.ends[found].astype(np.int64), self.lexicon.ends[found + 1].astype(np.int64)
        rest = np.flatnonzero(~known)
        ids, sizes = self.merges.merge([words[i] for i in rest])
        counts = np.zeros(len(words), np.int64)
        counts[known], counts[rest] = end - begin, sizes
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        out[ranges(starts[known], end - begin)] = self.lexicon.ids[ranges(begin, end - begin)]
        out[ranges(starts[rest], sizes)] = ids
        return out, counts

    def plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, places = code_points(raw, offsets)
        starts = boundaries(points, places)
        tokens = Distinct(points, starts)
        word_ids, counts = self.words([w.encode() for w in tokens.words()])
        slot = np.zeros(len(starts), np.int64)
        slot[tokens.first] = np.arange(len(tokens.first))
        which = slot[tokens.first[tokens.of]] if len(starts) else slot
        begin = np.cumsum(counts) - counts
        ids = word_ids[ranges(begin[which], counts[which])]
        return ids, np.diff(np.concatenate(([0], np.cumsum(counts[which])))[np.searchsorted(starts, places)])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and the number of each text. A special token's string is its id, as in the library."""
        ids, counts = self.plain(raw, offsets)
        whole = raw.tobytes()
        if any(s.encode() in whole for s in self.merges.special):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in range(len(parts)):
                text = whole[offsets[i] : offsets[i + 1]]
                if any(s.encode() in text for s in self.merges.special):
                    parts[i] = self._special(text)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _special(self, text: bytes) -> np.ndarray:
        out = []
        while text:
            found = [(at, -len(s), s) for s in self.merges.special if (at := text.find(s.encode())) >= 0]
            at, _, s = min(found, default=(len(text), 0, ""))
            if at:
                out.append(self.plain(np.frombuffer(text[:at], np.uint8), np.array([0, at]))[0])
            if s:
                out.append(np.array([self.merges.special[s]], np.int64))
            text = text[at + len(s.encode()) :]
        return np.concatenate(out)


def _encode_decode(lexicon, tokenizer: str):
    def run(batches):
        encoder = Encoder(lexicon.value, tokenizer)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in passes(offsets):
                ids, counts = encoder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts = np.split(ids, np.cumsum(counts)[:-1])
                texts = [encoder.merges.decode(p).decode("utf-8", "replace") for p in parts]
                others = [batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.array(counts, pa.int64()), pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])],
                    [*names, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _encode(lexicon, tokenizer: str):
    def run(batches):
        encoder = Encoder(lexicon.value, tokenizer)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in passes(offsets):
                ids, counts = encoder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], ["doc_id", "ids"])

    return run


def _decode(tokenizer: str):
    def run(batches):
        for batch in batches:
            table = merges(tokenizer)
            texts = [table.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bpe_encode(docs: DataFrame, tokenizer: str, lexicon: bytes | None = None) -> DataFrame:
    """Rows (doc_id, ids) of ``docs`` (doc_id, text). A null text has no ids; rows keep their number and repeat if repeated."""
    docs = _inputs(docs)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon or build_lexicon(docs, tokenizer))
    return docs.mapInArrow(_encode(shared, tokenizer), "doc_id long, ids array<int>")


def bpe_decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Texts of rows (doc_id, ids); bytes that form no character become U+FFFD. Null ids give the empty text."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(tokenizer), "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, tokenizer: str, lexicon: bytes | None = None) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text counts as empty.

    A ``lexicon`` of :func:`build_lexicon`, kept from an earlier run, saves a reading of the texts.
    """
    docs = _inputs(docs)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon or build_lexicon(docs, tokenizer))
    return docs.mapInArrow(_encode_decode(shared, tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
