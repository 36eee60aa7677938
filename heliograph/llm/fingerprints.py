"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text into chunks where it meets a block size's condition; a chunk gives one
character of a signature. Block sizes are 3 * 2**level, and the cuts of a level are among those of the level below. A
fingerprint has the lowest level whose signature has at most 64 characters, and the signatures of that level and the two
above: ``level:signature:signature:signature``. Where that signature is short, as for texts that repeat themselves, the
level below is taken, and the last character stands for all the rest of the text. Two fingerprints are compared at the
levels that both have, by the edit distance of their signatures; signatures without five characters in a row in common
are unlike.

Documents follow each other by descending doc_id; equal ids by text, a null id last, and the last is followed by the
first. A document that is alone follows itself. A null text is empty; an empty text has the fingerprint ``0:::``. Repeated
rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import ordered_shards, shard_count
from heliograph.llm.pretokens import powers
from heliograph.llm.words import mix

REACH, LONGEST, SHORT, LEVELS, DEPTH, COMMON = 7, 64, 16, 3, 40, 5
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _levels(raw: np.ndarray) -> np.ndarray:
    """Highest level whose cut condition holds after each byte; -1 for none."""
    wide = raw.astype(np.uint32)
    rolled = np.zeros(len(raw), np.uint32)
    for k in range(REACH):
        shifted = wide[: len(raw) - k]
        rolled[k:] += shifted * np.uint32(REACH + 1 - k)
    turned = np.zeros(len(raw), np.uint32)
    for k in range(REACH):
        turned[k:] ^= wide[: len(raw) - k] << np.uint32(5 * k if 5 * k < 32 else 0)
    value = (mix(rolled.astype(np.uint64) << np.uint64(32) | turned.astype(np.uint64)) >> np.uint64(8)) + np.uint64(1)
    lowest = value & (~value + np.uint64(1))
    level = np.log2(lowest.astype(np.float64)).astype(np.int64)
    return np.where(value % np.uint64(3) == 0, np.minimum(level, DEPTH), -1)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of UTF-8 texts; each depends on its own text alone."""
    gap = b"\0" * REACH
    raw = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + REACH) - sizes
    ends = starts + sizes
    level = _levels(raw)
    at = np.flatnonzero(level >= 0)
    owner = np.searchsorted(starts, at, "right") - 1
    inside = (owner >= 0) & (at < ends[np.maximum(owner, 0)] - 1)  # the last byte ends a chunk anyway
    at, owner = at[inside], owner[inside]
    counts = np.bincount(owner * (DEPTH + 1) + level[at], minlength=len(texts) * (DEPTH + 1)).reshape(-1, DEPTH + 1)
    above = counts[:, ::-1].cumsum(1)[:, ::-1]
    least = np.argmax(above < LONGEST, axis=1)
    least -= (least > 0) & (above[np.arange(len(texts)), least] < SHORT)
    forth, back = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * forth[: len(raw)], out=sums[1:])
    filled = np.flatnonzero(sizes)
    parts = []
    for k in range(LEVELS):
        cut = np.flatnonzero(level[at] >= least[owner] + k)
        cut = cut[np.arange(len(cut)) - np.searchsorted(owner[cut], owner[cut]) < LONGEST - 1]
        stops = np.concatenate((at[cut] + 1, ends[filled]))
        who = np.concatenate((owner[cut], filled))
        order = np.lexsort((stops, who))
        stops, who = stops[order], who[order]
        begins = np.concatenate(([0], stops[:-1])) if len(stops) else stops
        first = np.concatenate(([True], who[1:] != who[:-1])) if len(who) else np.zeros(0, bool)
        begins = np.where(first, starts[who], begins)
        code = mix((sums[stops] - sums[begins]) * back[begins] + (stops - begins).astype(np.uint64))
        chars = _CHARS[(code >> np.uint64(58)).astype(np.int64)].tobytes().decode()
        cuts = np.searchsorted(who, np.arange(len(texts) + 1))
        parts.append([chars[cuts[i] : cuts[i + 1]] for i in range(len(texts))])
    return [":".join((str(n), *own)) for n, *own in zip(least.tolist(), *parts)]


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of pairs of strings of at most 64 characters, by bit-parallel columns, all pairs side by side."""
    n = len(left)
    sizes_a, sizes_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    a, b = (np.zeros((n, LONGEST), np.uint8) for _ in range(2))
    for i, (x, y) in enumerate(zip(left, right)):
        a[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)
        b[i, : len(y)] = np.frombuffer(y.encode(), np.uint8)
    equal = np.zeros((n, 128), np.uint64)
    rows = np.arange(n)
    for k in range(int(sizes_a.max(initial=0))):
        some = rows[sizes_a > k]
        equal[some, a[some, k]] |= np.uint64(1 << k)
    one = np.uint64(1)
    last = np.where(sizes_a > 0, one << np.maximum(sizes_a - 1, 0).astype(np.uint64), np.uint64(0))
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), sizes_a.copy()
    for k in range(int(sizes_b.max(initial=0))):
        match = equal[rows, b[:, k]]
        same = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(same | plus), same & plus
        live = sizes_b > k
        score += live & ((up & last) != 0)
        score -= live & ((down & last) != 0)
        up, down = up << one | one, down << one
        plus, minus = down | ~(same | up), up & same
    return np.where(sizes_a == 0, sizes_b, score)


def _share_run(x: str, y: str) -> bool:
    if len(x) < COMMON or len(y) < COMMON:
        return True
    runs = {x[i : i + COMMON] for i in range(len(x) - COMMON + 1)}
    return any(y[i : i + COMMON] in runs for i in range(len(y) - COMMON + 1))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness from 0 to 1 of pairs of fingerprints: the best over the levels that both have."""
    out = np.zeros(len(left))
    which, one, two = [], [], []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        (n, *a), (m, *b) = x.split(":"), y.split(":")
        n, m = int(n), int(m)
        for level in range(max(n, m), min(n, m) + LEVELS):
            p, q = a[level - n], b[level - m]
            if p and q and (level == max(n, m) or min(len(p), len(q)) >= 2 * COMMON) and _share_run(p, q):
                which.append(i), one.append(p), two.append(q)
    if which:
        longest = np.array([max(len(p), len(q)) for p, q in zip(one, two)])
        np.maximum.at(out, np.array(which), 1 - edit_distances(one, two) / longest)
    return out


def _batches(batches):
    held = None  # the last row so far: (shard, doc_id, text); its successor comes with the next batch
    for batch in batches:
        rows = [*zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "text", "copy")))]
        if held is not None:
            rows.insert(0, held)
        for lo in range(0, len(rows) - 1, 500):
            part = rows[lo : lo + 501]
            texts = [r[2] or "" for r in part]
            edited, own = [], []
            for i in range(len(part) - 1):
                if part[i][3] == 0:  # what follows is of the same shard: its next document, or a copy of it
                    half = len(texts[i]) // 2
                    edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
                    own.append(i)
            marks = fingerprints([t.encode() for t in texts])
            changed = fingerprints([t.encode() for t in edited])
            mine = [marks[i] for i in own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part[i][1] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(mine, pa.string()), pa.array(changed, pa.string()),
                    pa.array(likeness(mine, changed), pa.float64()), pa.array(likeness(mine, [marks[i + 1] for i in own]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        held = rows[-1] if rows else held


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text, and their likenesses.

    The texts are shuffled once, into ranges of doc_id. A range also gets a copy of the first document of the next
    range, so that no task needs another's rows. One row for each range reaches the driver's plan, not its memory.
    """
    spark = docs.sparkSession
    rows = ordered_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", shard_count(spark))
    rows = rows.withColumn("shard", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("shard")))
    tops = rows.groupBy("shard").agg(F.max("doc_id").alias("top")).orderBy("shard").collect()  # a row for each shard
    if not tops:
        return spark.createDataFrame([], SCHEMA)
    before = {r["shard"]: tops[(k + 1) % len(tops)]["shard"] for k, r in enumerate(tops)}
    table = spark.createDataFrame([(r["shard"], r["top"], before[r["shard"]]) for r in tops], "shard int, top long, above int")
    rows = rows.join(F.broadcast(table), "shard")
    own = F.struct(F.col("shard"), F.lit(0).alias("copy"))
    copied = F.struct(F.col("above").alias("shard"), F.lit(1).alias("copy"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, copied)).otherwise(F.array(own))
    dealt = rows.withColumn("place", F.explode(places)).select("place.shard", "place.copy", "doc_id", "text")
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "copy", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_batches, SCHEMA)
