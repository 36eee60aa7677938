"""Quality by votes of nearest labelled texts in a latent-semantic space.

A text is three blocks of term shares: how its runs of letters, digits and signs follow each other (three at a time, hashed),
its words (hashed), and how often a word repeats the one before. Shares are square-rooted and weighted by how few of all
texts have a term, then turned by the leading right singular vectors of the labelled texts' matrix. The labelled vectors
are broadcast; each task multiplies blocks of its texts' vectors with all of them, so cosines are exact, and the
``NEIGHBOURS`` nearest, with all that tie with the last, vote with their similarity to the power of ``SHARPNESS``.

Bounds of the fit, all parameters: ``SAMPLE_ROWS`` labelled rows drawn by hash, each a vector of ``DIMENSIONS`` numbers;
only they reach the driver. Document frequencies are counted over all texts, as ``TERMS`` sums.
Defined cases: a text without terms (null, empty, white space only) is alike to none, so all labels vote alike. Without
labelled rows all scores are 0.5. Null labels and labels other than 0 and 1 are left out; several labels of a document
each count. Repeated rows get equal results; a null doc_id is never learnt from and not held out; an empty table gives
no rows. Extra columns are kept, but for those named like results, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import hashed_share, passes, text_buffers
from heliograph.llm.words import Words, mix

#: Labelled rows of a fit, numbers of a vector, neighbours that vote, the power of their similarity, and the score from which a text is good.
SAMPLE_ROWS, DIMENSIONS, NEIGHBOURS, SHARPNESS, GOOD = 8_000, 48, 15, 8.0, 0.3
#: Terms of the blocks (shapes, words, repeats), their weights, and texts multiplied at a time.
BLOCKS, WEIGHTS, TEXTS_AT_ONCE = (512, 1534, 2), (1.0, 0.5, 1.0), 512
TERMS = sum(BLOCKS)
RESULTS = ("score", "predicted")
# Small letters and all bytes beyond ASCII, capitals, digits, blanks, line ends; every other sign is a kind of its own.
_KIND = np.array([1 if b > 127 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in b" \t\r\x0b\x0c" else 5 if b == 10 else b + 8 for b in range(256)], np.uint64)


def _term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of all terms, a row for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(raw):
        return out
    # offsets of empty texts are repeated: each byte belongs to the last text that starts at or before it
    kind = _KIND[raw]
    edge = np.zeros(len(raw), bool)
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(edge | np.concatenate(([True], kind[1:] != kind[:-1])))
    run, text = kind[at], np.searchsorted(offsets, at, "right") - 1
    three = np.flatnonzero(text[2:] == text[:-2])
    shape = mix((run[three] * np.uint64(257) + run[three + 1]) * np.uint64(257) + run[three + 2])
    terms = [(text[three], (shape % np.uint64(BLOCKS[0])).astype(np.int64))]
    words = Words(raw, offsets)
    text = np.repeat(np.arange(n), np.diff(words.cuts))
    terms.append((text, BLOCKS[0] + (mix(words.code) % np.uint64(BLOCKS[1])).astype(np.int64)))
    two = np.flatnonzero(text[1:] == text[:-1])
    terms.append((text[two], BLOCKS[0] + BLOCKS[1] + (words.code[two] == words.code[two + 1])))
    for rows, columns in terms:
        out += np.bincount(rows * TERMS + columns, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    return out


def term_counts(texts: pa.Array):
    """Blocks (first row, counts) of at most ``TEXTS_AT_ONCE`` texts."""
    raw, offsets = text_buffers(texts)
    for lo, hi in passes(offsets):
        for a in range(lo, hi, TEXTS_AT_ONCE):
            b = min(hi, a + TEXTS_AT_ONCE)
            yield a, _term_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def weigh(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Weighted square roots of each block's shares; every block of a text has its weight as length, or none."""
    out, lo = np.empty_like(counts), 0
    for size, weight in zip(BLOCKS, WEIGHTS):
        part = np.sqrt(counts[:, lo : lo + size]) * rarity[lo : lo + size]
        out[:, lo : lo + size] = part * (weight / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9))
        lo += size
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


@dataclass(frozen=True)
class Voters:
    """A fitted model: weights of the terms, the turning matrix, and the labelled vectors with their labels."""

    rarity: np.ndarray
    turn: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        alike = unit(weigh(counts, self.rarity) @ self.turn) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        last = np.partition(alike, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
        row, column = np.nonzero(alike >= last - 1e-6)
        vote = np.maximum(alike[row, column].astype(np.float64), 1e-3) ** SHARPNESS
        total = np.bincount(row, vote, len(counts))
        return np.bincount(row, vote * self.labels[column], len(counts)) / total


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of texts, then of texts that have each term: sums of one row for each batch and block of terms."""

    def run(batches):
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for _, counts in term_counts(batch.column("text")):
                total[0] += len(counts)
                total[1:] += (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit_voters(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS) -> Voters:
    """Learn from the rows of ``labels`` (doc_id, quality) that aren't held out; quality and text are all that is taken."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("_id"))
    n = marks.count()
    order = F.xxhash64(F.col("_id").cast("string"))
    drawn = marks.where(hashed_share(min(1.0, 1.3 * sample_rows / max(n, 1)), F.col("_id").cast("string"), F.lit("drawn"))).orderBy(order, "_id", "quality").limit(sample_rows)
    pairs = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # sample_rows rows at most

    def run(batches):
        for batch in batches:
            held = [row for _, counts in term_counts(batch.column("text")) for row in counts]
            places = [np.flatnonzero(row) for row in held]
            sparse = [pa.array([x.tobytes() for x in part], pa.binary()) for part in ([at.astype("<u2") for at in places], [row[at] for row, at in zip(held, places)])]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("quality"), *sparse], ["_id", "quality", "terms", "counts"])

    kind = dict(drawn.dtypes)["_id"]
    got: pd.DataFrame = pairs.select("_id", "quality", "text").mapInArrow(run, f"_id {kind}, quality int, terms binary, counts binary").orderBy("_id", "quality", F.xxhash64("terms", "counts")).limit(2 * sample_rows).toPandas()
    frequency = document_frequencies(docs)
    rarity = (1 + np.log((1 + frequency[0]) / (1 + frequency[1:]))).astype(np.float32)

    def weighed():
        """Blocks of the sample's matrix, which is never held whole."""
        for lo in range(0, len(got), TEXTS_AT_ONCE):
            part = got.iloc[lo : lo + TEXTS_AT_ONCE]
            counts = np.zeros((len(part), TERMS), np.float32)
            for row, at, n in zip(counts, part["terms"], part["counts"]):
                row[np.frombuffer(at, "<u2")] = np.frombuffer(n, np.float32)
            yield weigh(counts, rarity)

    products = np.zeros((TERMS, TERMS))
    for rows in weighed():
        products += rows.T @ rows
    _, axes = np.linalg.eigh(products)  # right singular vectors, the leading ones last
    turn = np.ascontiguousarray(axes[:, ::-1][:, :dimensions].astype(np.float32))
    vectors = [unit(rows @ turn) for rows in weighed()]
    return Voters(rarity, turn, np.concatenate(vectors) if vectors else np.zeros((0, turn.shape[1]), np.float32), got["quality"].to_numpy(np.float64))


def score_quality(docs: DataFrame, voters: Voters) -> DataFrame:
    """``docs`` with ``score``, the share of votes for label 1, and ``predicted``. The broadcast is bounded by the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    kept = docs.drop(*RESULTS)

    def run(batches):
        model = shared.value
        for batch in batches:
            parts = [model.scores(counts) for _, counts in term_counts(batch.column("text"))]
            score = np.round(np.concatenate(parts), 6) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= GOOD).astype(np.int32))], [*batch.schema.names, *RESULTS])

    return kept.mapInArrow(run, kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
