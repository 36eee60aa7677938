"""Numpy kernels of the text operators against libraries and brute force."""

from __future__ import annotations

import html
import json
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heliograph.llm import decontaminate, edit_counts, fingerprints, language, lexicon, site_tree, token_ids, tool_calls, words
from heliograph.llm.common import passes, ranges, text_buffers
from heliograph.llm.fm_index import FMIndex, suffix_array
from heliograph.llm.ngram_join import _overlaps, banding
from heliograph.llm.pretokens import Distinct, boundaries, code_points

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = list("abst'''rvelmd  \n\t12.!é  漢²Ⅷ_😀\x1c\x85̀ß\x00")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
some_text = st.text(st.sampled_from(ALPHABET), max_size=60)


def lower_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=200, deadline=None)
@given(st.lists(some_text, max_size=8))
def test_pretokens_follow_the_pattern(texts):
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    points, places = code_points(raw, offsets)
    starts = boundaries(points, places)
    text = points.tobytes().decode("utf-32-le")
    got = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    want = [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]
    assert got == want
    tokens = Distinct(points, starts)
    by_first = dict(zip(tokens.first.tolist(), tokens.words()))
    assert [by_first[i] for i in tokens.first[tokens.of].tolist()] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(some_text | st.sampled_from(["<|endoftext|>", "a<|endoftext|> b!<|endoftext|>", "x" * 500]), min_size=1, max_size=6))
def test_both_encoders_equal_the_library(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    table = lexicon.merges(PATH)
    known = [b" the", b"st", b"abst"]
    for encoder in (token_ids.library_encoder(PATH), lexicon.Encoder(lexicon.compile_transducer(known, *table.merge(known)), PATH)):
        ids, counts = encoder.encode(raw, offsets)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert [table.decode(np.array(w, np.int64)).decode("utf-8", "replace") for w in want] == LIBRARY.decode_batch(want, skip_special_tokens=False)


def test_broken_bytes_decode_as_in_the_library():
    table, r = lexicon.merges(PATH), random.Random(3)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randrange(6))]
        assert table.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_words_merge_as_in_the_library():
    for word in ("a" * 3000, "abaabaabab" * 90, "thethetheth"):
        want = LIBRARY.encode(word, add_special_tokens=False).ids
        table = lexicon.merges(PATH)
        assert table.one(word.encode()) == want
        assert table.merge([word.encode()])[0].tolist() == want


def test_transducer_is_minimal_and_numbers_its_words(tmp_path):
    own = [a + b for a in (b"walk", b"talk", b"balk") for b in (b"", b"s", b"ed", b"ing")]
    (tmp_path / "x.npy").write_bytes(lexicon.compile_transducer(own, np.arange(len(own)), np.ones(len(own), np.int64)))
    t = lexicon.Transducer(str(tmp_path / "x.npy"))
    assert sorted(t.walk(own).tolist()) == list(range(len(own)))
    assert [int(t.ids[t.ends[k]]) for k in t.walk(own)] == list(range(len(own)))
    assert (t.walk([b"wal", b"walkx", b"", b"zzz"]) == -1).all()
    assert len(t.final) == 9  # one shared stem and shared endings
    (tmp_path / "y.npy").write_bytes(lexicon.compile_transducer([], np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert lexicon.Transducer(str(tmp_path / "y.npy")).walk([b"a"]).tolist() == [-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_variable_length_coding_round_trip(values):
    assert token_ids.unpack(*token_ids.pack(np.array(values, np.uint32)), len(values)).tolist() == values


def test_suffix_array_and_index_match_brute_force():
    rng = np.random.default_rng(0)
    for n, s in ((1, 2), (5, 2), (900, 3), (800, 50)):
        text = rng.integers(1, s + 1, n)
        ended = np.append(text, 0)
        assert suffix_array(ended).tolist() == sorted(range(n + 1), key=lambda i: ended[i:].tolist())
        index = FMIndex(text)
        for length in (1, 2, 4):
            wanted = np.array([text[i : i + length] for i in range(0, max(1, n - length), 37) if i + length <= n] + [[s + 5] * length, [-1] * length])
            owner, place = index.locate(*index.search(wanted))
            for k, p in enumerate(wanted):
                assert sorted(place[owner == k].tolist()) == [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]


def brute_windows(texts, items, size):
    windows: dict[tuple, set] = {}
    for name, text in items:
        own = lower_words(text)
        for k in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(name)
    out = []
    for text in texts:
        own, hit, names = lower_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if found := windows.get(tuple(own[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((len(own), len(hit), sorted(names)))
    return out


def found_windows(texts, items, size):
    phrases, out = decontaminate.Phrases(tuple(items), size), []
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    for lo, hi in passes(offsets, 500):
        own, begins, ends, hits = decontaminate.find(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], phrases)
        owner = np.searchsorted(own.cuts, begins, "right") - 1
        out += [(int(own.cuts[t + 1] - own.cuts[t]), int((ends - begins)[owner == t].sum()), sorted(hits.get(t, ()))) for t in range(hi - lo)]
    return out


@pytest.mark.parametrize("size", [1, 4, 10])
def test_windows_match_brute_force(size):
    r = random.Random(size)
    make = lambda n: " ".join(r.choice("a b C, d é 1".split()) for _ in range(n))
    texts = [make(r.randint(0, 40)) for _ in range(200)] + [None, ""]
    items = [(str(i), make(r.randint(0, 13))) for i in range(20)] + [("n", None)]
    assert found_windows(texts, items, size) == brute_windows(texts, items, size)
    assert found_windows(texts, [], size) == brute_windows(texts, [], size)


def test_shingles_are_sets_of_word_runs():
    texts = ["A b c d e f", "a B c d e", "a b", "", "x a b c d e f"]
    raw, offsets = text_buffers(pa.array(texts))
    codes, cuts = words.shingles(words.Words(raw, offsets), 5)
    own = [codes[cuts[i] : cuts[i + 1]].tolist() for i in range(5)]
    assert [len(x) for x in own] == [2, 1, 1, 0, 3]
    assert own[0][0] == own[1][0] and own[4][1:] == own[0] and own[2] != own[1]


def test_overlap_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    assert _overlaps(sets[:5], sets[5:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    bands, rows = banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distances():
    r = random.Random(0)
    make = lambda: "".join(r.choice("abcd") for _ in range(r.choice([0, 1, 5, 30, 63, 64])))
    a, b = [make() for _ in range(80)], [make() for _ in range(80)]
    assert fingerprints.edit_distances(a, b).tolist() == [plain_distance(x, y) for x, y in zip(a, b)]


def test_fingerprints_depend_on_their_text_alone():
    r = random.Random(1)
    texts = ["", "a", "abc " * 900] + [" ".join(str(r.randrange(999)) for _ in range(n)) for n in (3, 60, 700, 5000)]
    together = fingerprints.fingerprints([t.encode() for t in texts])
    assert together == [fingerprints.fingerprints([t.encode()])[0] for t in texts]
    assert all(len(part) <= 64 for f in together for part in f.split(":")[1:])
    half = [t[: len(t) - len(t) // 2] + "".join(r.choice("xyz ") for _ in range(len(t) // 2)) for t in texts]
    near = fingerprints.likeness(together, fingerprints.fingerprints([t.encode() for t in half]))
    assert (near[4:] > 0.3).all() and fingerprints.likeness(together, together).tolist() == [1.0] * len(texts)
    assert fingerprints.likeness([together[5]], [together[6]])[0] < 0.2


@settings(max_examples=150, deadline=None)
@given(some_text, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 40), some_text), max_size=4))
def test_edited_counts_equal_counting_again(text, edits):
    count = edit_counts.word_counts(PATH)
    split = regex.compile(edit_counts.PATTERN).findall
    tree = edit_counts.CountTree(text, [len(w) for w in split(text)], count(split(text)), count)
    for start, removed, inserted in edits:
        tree.edit(start, removed, inserted)
        at = min(start, len(text))
        text = text[:at] + inserted + text[at + removed :]
        assert tree.text == text and tree.total == sum(count(split(text))) and tree.pretokens == len(split(text))


def test_small_edits_count_little_again():
    count = edit_counts.word_counts(PATH)
    text = "the quick brown fox jumps over the lazy dog. " * 3000
    own = regex.findall(edit_counts.PATTERN, text)
    tree = edit_counts.CountTree(text, [len(w) for w in own], count(own), count)
    tree.edit(60_000, 10, "a few new words")
    assert tree.counted < 20
    tree.edit(10, 0, "word " * 4000)
    assert tree.pretokens == len(regex.findall(edit_counts.PATTERN, tree.text))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav>
<header>Top</header><div class="cookie-notice">We use cookies</div><!-- x --><article><h1>One &amp; two</h1><p><b>bold<br>next<p>last   para</p><form><p>mail</p></form>
<section class="comments"><p>nice</p></section><aside>side</aside><p>caf&eacute; &#233; &lt;b&gt;</p></article><div class=ad>Buy</div><footer>&copy; foot</footer></body>"""


def test_main_text():
    assert site_tree.main_text(PAGE, set()) == "One & two\nbold next\nlast para\ncafé é <b>"
    assert site_tree.main_text(None, set()) == site_tree.main_text("", set()) == site_tree.main_text("<p", set()).strip("<p") == ""
    assert site_tree.main_text("<p>a<p>b <i>c</i>d</div>", set()) == "a\nb cd"
    assert site_tree.main_text("<main>x<nav>y</main>", set()) == "x"


def test_main_text_drops_unimportant_nodes_outside_articles():
    blocks, layouts = site_tree.parse("<body><div>same</div><p>own</p></body>")
    assert [b[1] for b in blocks] == ["same", "own"] and layouts
    assert site_tree.main_text("<body><div>same</div><p>own</p></body>", {site_tree._code(blocks[0][0])}) == "own"
    assert html.unescape("&am") == "&am"


@pytest.mark.parametrize(("value", "schema", "wrong"), [
    ({"a": 1}, {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 3}}}, False), ({"a": 4}, {"properties": {"a": {"maximum": 3}}}, True),
    ({}, {"required": ["a"]}, True), ({"b": 1}, {"properties": {}, "additionalProperties": False}, True), ([1, "x"], {"items": {"type": "number"}}, True), (True, {"type": "integer"}, True),
    ("é", {"minLength": 1, "maxLength": 1, "pattern": "^.$"}, False), (None, {"type": ["null", "string"]}, False), ("c", {"enum": ["a", "b"]}, True), (2.0, {"type": "integer"}, False),
])
def test_schemas(value, schema, wrong):
    assert bool(tool_calls.violation(value, schema)) is wrong


def test_canonical_json():
    assert tool_calls.canonical({"b": [1, None], "a": {"é": "\n"}}) == '{"a":{"é":"\\n"},"b":[1,null]}'
    assert json.loads(tool_calls.canonical({"x": 1e300})) == {"x": 1e300}


def test_language_rejects_what_has_no_letters():
    two = (("de", language.letters("der die und das ist nicht ein eine mit von zu sich auch " * 20)), ("en", language.letters("the and of is not a an with from to also itself which " * 20)))
    assert language.classify("the end of it is not with us", two)[0] == "en"
    assert language.classify("DAS IST NICHT MIT DER UND!!", two)[0] == "de"
    assert [language.classify(x, two)[0] for x in (None, "", "12 34 !?", "—")] == ["und"] * 4
    assert language.classify("words", ())[2] and language.classify("words", two[:1]) == ("de", 1.0, False)


def test_ranges():
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
