"""Periodic runs, quality votes and spelling variants: against brute force, and on nulls, repeats, ties and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.llm import common, quality_votes, repeat_runs, spelling_groups
from heliograph.llm.queries import QUERIES
from test_text_operators import none, odd, texts_of  # noqa: F401


def brute_runs(words):
    """Every stretch that repeats with some period, by comparing all pairs of places so far apart; the smallest period first."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, k, q) for (s, k), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(0, 9), st.integers(0, 40))
def test_runs_equal_brute_force(words, period, times, place):
    words[place:place] = period * times
    assert repeat_runs.find_runs(np.array(words, np.int64)) == brute_runs(words)


def test_long_runs_take_little_time():
    assert repeat_runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert repeat_runs.find_runs(np.tile(np.arange(50), 2_000)) == [(0, 100_000, 50)]
    lines = np.concatenate([np.concatenate([np.arange(100 * k, 100 * k + 12), np.arange(8)]) for k in range(1, 5_000)])
    assert repeat_runs.find_runs(lines) == []


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def run_row(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(runs), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words))


def same_rows(got, want):
    clean = lambda rows: sorted((tuple(None if pd.isna(v) else v for v in r) for r in rows), key=repr)
    assert clean(got) == clean(want)


def test_runs_of_the_table(spark, folder, odd, none):  # noqa: F811
    docs = texts_of(spark, folder)
    got = QUERIES["op11_periodic_runs"](spark, folder).toPandas()
    assert (got["n_runs"] > 0).sum() > 5
    same_rows([tuple(r) for r in got.astype(object).itertuples(index=False)], [run_row(int(r.doc_id), r.text) for r in docs.itertuples()])
    short = odd.where("text is null or length(text) < 2000")
    same_rows([tuple(r) for r in repeat_runs.run_digests(short).collect()], [run_row(r.doc_id, r.text) for r in short.collect()])
    assert repeat_runs.run_digests(none).count() == 0


def test_collapsed_texts(spark, odd):  # noqa: F811
    got = repeat_runs.collapse_runs(odd.withColumnRenamed("score", "runs"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "rejected", "shard", "node", "items", "n_words", "runs", "collapsed"]
    long = got.where("length(text) > 2000").collect()
    assert len(long) == 3 and {(r["n_words"], tuple(r["runs"][0]), r["collapsed"]) for r in long} == {(30_000, (0, 30_000, 10), "the quick brown fox jumps over the lazy dog again")}
    some = got.where("text is null or trim(text) = ''").collect()
    assert {(r["n_words"], len(r["runs"]), r["collapsed"]) for r in some} == {(0, 0, "")}
    two = spark.createDataFrame([(1, "x a b a b a b a b y" + " z" * 7)], "doc_id long, text string")
    assert repeat_runs.collapse_runs(two).first()["collapsed"] == "x a b y z"
    assert repeat_runs._split(b"a\x1cb\x85c\x0bd\x0ce").__next__() == [b"a\x1cb\x85c", b"d", b"e"]


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = "ab c  é\tfg " * 50
    whole = repeat_runs.word_numbers(text)
    monkeypatch.setattr(repeat_runs, "PIECE", 7)
    cut = repeat_runs.word_numbers(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1] == cut[1] == [b"ab", b"c", "é".encode(), b"fg"]


def test_quality_of_held_out_rows(spark, folder):
    got = QUERIES["op12_quality"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    marks = common.read_table(spark, "/root/testdata/sf0.01", "labels").toPandas()
    held = got[got["held_out"]].merge(marks, on="doc_id")
    good, bad = held[held["quality"] == 1], held[held["quality"] == 0]
    assert len(bad) >= 5 and (good["predicted"] == 1).mean() >= 0.98 and (bad["predicted"] == 0).mean() >= 0.9
    assert good["score"].mean() > bad["score"].mean() + 0.5


def test_votes_equal_plain_cosines(spark, folder):
    docs, labels = common.read_table(spark, folder, "documents"), common.read_table(spark, folder, "labels")
    voters = quality_votes.fit_voters(docs, labels, sample_rows=60, dimensions=10)
    texts = texts_of(spark, folder)
    taken = labels.toPandas().drop_duplicates("doc_id")
    assert len(voters.labels) <= 60 and voters.vectors.shape[1] == 10
    assert len(voters.labels) <= (taken["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 != 0)).sum()
    # shares of terms counted one by one
    n, frequency = len(texts), np.zeros(quality_votes.TERMS)
    rows = [quality_votes._term_counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].astype(float) for t in texts["text"]]
    frequency = sum(r > 0 for r in rows)
    rarity = 1 + np.log((1 + n) / (1 + frequency))
    assert np.allclose(voters.rarity, rarity, rtol=1e-5)
    want = []
    for row in rows:
        parts, lo = [], 0
        for size, weight in zip(quality_votes.BLOCKS, quality_votes.WEIGHTS):
            part = np.sqrt(row[lo : lo + size]) * rarity[lo : lo + size]
            parts.append(weight * part / (np.linalg.norm(part) or 1))
            lo += size
        vector = np.concatenate(parts) @ voters.turn.astype(float)
        alike = voters.vectors.astype(float) @ vector / (np.linalg.norm(vector) or 1)
        near = alike >= np.sort(alike)[-15] - 1e-6
        votes = np.maximum(alike[near], 1e-3) ** 8
        want.append((votes * voters.labels[near]).sum() / votes.sum())
    got = quality_votes.score_quality(docs, voters).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert np.allclose(got, want, atol=2e-3) and np.abs(got - want).mean() < 1e-4


def test_quality_terms():
    raw = "Aa a## A!\nb".encode()
    counts = quality_votes._term_counts(np.frombuffer(raw + b"the the of", np.uint8), np.array([0, 0, len(raw), len(raw), len(raw) + 10, len(raw) + 10]))
    assert counts[[0, 2, 4]].sum() == 0  # empty texts among others
    shapes, words, pairs = np.split(counts, np.cumsum(quality_votes.BLOCKS)[:-1], axis=1)
    assert shapes[1].sum() == 8 and words[1].sum() == 4 and pairs[1].tolist() == [2, 1]  # Aa a is a word twice over
    assert shapes[3].sum() == 3 and pairs[3].tolist() == [1, 1]


def test_labels_of_held_out_rows_are_not_learnt(spark, folder, odd, none):  # noqa: F811
    docs, labels = common.read_table(spark, folder, "documents"), common.read_table(spark, folder, "labels")
    other = labels.selectExpr("doc_id", "case when crc32(string(doc_id)) % 5 = 0 then 1 - quality else quality end as quality", "7 as toxic")
    one, two = (quality_votes.score_quality(docs, quality_votes.fit_voters(docs, x)).toPandas().sort_values("doc_id") for x in (labels, other))
    assert one["score"].tolist() == two["score"].tolist()
    voters = quality_votes.fit_voters(docs, labels)
    got = quality_votes.score_quality(odd.withColumnRenamed("items", "predicted"), voters)
    assert got.columns == [c for c in odd.columns if c not in ("score", "items")] + ["score", "predicted"] and got.count() == odd.count()
    bare = {r["score"] for r in got.where("text is null or trim(text) = ''").collect()}
    assert len(bare) == 1 and abs(bare.pop() - voters.labels.mean()) < 1e-6
    assert got.groupBy("text").agg({"score": "stddev"}).where("`stddev(score)` > 0").count() == 0  # equal texts, equal scores
    assert quality_votes.score_quality(none, voters).count() == 0
    unlearnt = quality_votes.fit_voters(none, labels.limit(0))
    assert {r["score"] for r in quality_votes.score_quality(odd, unlearnt).collect()} == {0.5}
    strange = spark.createDataFrame([(1, None), (None, 1), (2, 7), (3, 0), (3, 1)], "doc_id long, quality int")
    assert sorted(quality_votes.fit_voters(docs, strange).labels) in ([], [0.0, 1.0])


def edits(word, other):
    if abs(len(word) - len(other)) > 1 or word == other:
        return False
    if len(word) == len(other):
        return sum(a != b for a, b in zip(word, other)) == 1
    short, long = sorted((word, other), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(counts):
    words = {w: n for w, n in counts.items() if n >= 5}
    near = {w: [v for v in words if edits(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def groups(frame):
    return {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in frame.collect()}


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                out[w] += 1
    return out


def test_spelling_of_the_table(spark, folder, odd, none):  # noqa: F811
    counts = counted((int(r.doc_id), r.text) for r in texts_of(spark, folder).itertuples())
    assert groups(QUERIES["op13_spelling"](spark, folder)) == brute_groups(counts)
    few = odd.select("doc_id", "text").union(spark.createDataFrame([(k, "ÀBCDEF Abcdéf× abcdef÷ 1abcdef") for k in range(40)], "doc_id long, text string"))
    want = counted((r["doc_id"], r["text"]) for r in few.collect())
    assert {(r["word"], r["n"]) for r in spelling_groups.count_words(few, spelling_groups.without_one).collect()} == set(want.items())
    assert groups(spelling_groups.group_variants(spelling_groups.count_words(few, spelling_groups.without_one))) == brute_groups(want)
    assert spelling_groups.group_variants(spelling_groups.count_words(none)).count() == 0


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_no_pair_is_lost_in_any_alphabet(spark, symbols):
    rng = random.Random(symbols)
    counts = {"".join(rng.choice("abcéÿ") for _ in range(rng.randint(6, 8))): 5 ** rng.randint(1, 6) + rng.randint(0, 1) for _ in range(250)}
    counts |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaab": 700, "aaaaaabb": 3600, "aaaaabbb": 20_000, "x" * 300: 6, "x" * 301: 40, "tieabc": 6, "tieabd": 30, "tieabb": 30}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute_groups(counts)
    assert groups(spelling_groups.group_variants(frame, symbols)) == want
    assert max(Counter(r[5] for r in want).values()) > 3 and ("tieabc", 6, 2, "tieabb", 30, "tieabb") in want


def test_neighbourhoods_are_whole_and_without_repeats():
    words = ["a", "ab", "aabb", "bab", "éüa", "aaaa"]
    for symbols in (2, 3, 8):
        reduced = spelling_groups.Reduced(words, symbols)
        number, near = reduced.neighbours()
        for k, w in enumerate(words):
            own = [int(x) for x in reduced.symbol[reduced.cuts[k] : reduced.cuts[k + 1]]]
            around = {tuple(own)} | {tuple(own[:i] + own[i + 1 :]) for i in range(len(w))}
            around |= {tuple(own[:i] + [s] + own[j:]) for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for s in range(symbols)}
            assert (number == k).sum() == len(around) == len(set(near[number == k].tolist()))


def test_counts_do_not_depend_on_how_many_words_a_task_holds(spark, folder, monkeypatch):
    docs = common.read_table(spark, folder, "documents")
    whole = set(map(tuple, spelling_groups.count_words(docs).collect()))
    monkeypatch.setattr(spelling_groups, "HELD_WORDS", 50)
    assert set(map(tuple, spelling_groups.count_words(docs).collect())) == whole
