"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from its training texts. A text's different words are
compressed with every dictionary, piece by piece so that a long text can't live off itself, and it gets the language of
the smallest sum. Languages that are level there are compressed once more with shorter matches and all words. The score
is the margin to the second smallest, as a share of it; a margin below ``LEAST_MARGIN`` rejects, so that texts of languages
not learned and gibberish go. A text of which another language has one half is rejected with score 0.

A null text, or one without a letter, is ``und`` with score 0 and rejected. Sizes still equal go to the
language with most training text drawn, then the first in alphabetical order, and are rejected. Without training rows all texts are ``und``. Extra columns of the input are kept,
but for those named like results, which are replaced.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import hashed_share

#: Training rows drawn for a language, characters taken from each in how many pieces, and the length of a dictionary: the
#: bounds of the fit. Pieces lie spread over the whole of a text that is longer.
SAMPLE_ROWS, ROW_CHARS, ROW_PIECES, DICTIONARY_BYTES = 400, 1_000, 5, 250_000
#: Bytes of a text compressed at a time, the compression level, and the margin from which a result stands: the least whole
#: per cent at which dictionaries of one half of sf0.1's learning rows reject 85 % of the other half's texts of 30 words or
#: more in any one language that they don't have. Held-out rows had no part in it; of those, it rejects 27 of 3,358.
PIECE, LEVEL, LEAST_MARGIN = 2_048, 3, 0.04
#: Bytes from which a text is judged by halves too, and the margin of a half at which another language has it.
HALVED_FROM, LEAST_HALF = 200, -0.02
UNDETERMINED = "und"
_NOT_ASCII_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def letters(text: str) -> bytes:
    """Lower-case words in UTF-8 with single blanks: digits, signs and marks carry no language."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_NOT_ASCII_LETTERS).split())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of the rows (doc_id, text, lang) that aren't held out.

    Each language gives the share of its rows by hash that makes ``SAMPLE_ROWS`` of them; only those are shuffled, and
    no more than ``SAMPLE_ROWS`` of a language reach the driver.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    shares = {r["lang"]: min(1.0, 1.3 * SAMPLE_ROWS / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "piece")
    length, size = F.char_length("text"), ROW_CHARS // ROW_PIECES
    piece = lambda k: F.substring(F.col("text"), (F.floor((length - size) * k / (ROW_PIECES - 1)) + 1).cast("int"), F.lit(size))
    spread = F.concat_ws(" ", *[F.regexp_replace(piece(k), r"^\S+\s|\s\S+$", "") for k in range(ROW_PIECES)])  # without the words cut in two
    drawn = rows.where(hashed_share(share, "doc_id")).select("lang", "doc_id", F.when(length <= ROW_CHARS, F.col("text")).otherwise(spread).alias("piece"))
    picked = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_ROWS)
    found: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "k").select("lang", "piece").toLocalIterator():
        found.setdefault(row["lang"], []).append(letters(row["piece"]))
    return {lang: b" ".join(parts)[:DICTIONARY_BYTES] for lang, parts in sorted(found.items()) if any(parts)}


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    import zstandard as z

    first, again = [], []
    for _, content in dictionaries:
        shared = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        for out, level, shortest in ((first, LEVEL, 4), (again, 2 * LEVEL, 3)):
            params = z.ZstdCompressionParameters.from_level(level, min_match=shortest, write_content_size=0, write_checksum=0, write_dict_id=0)
            out.append(z.ZstdCompressor(dict_data=shared, compression_params=params))
    return [lang for lang, _ in dictionaries], first, again


def _pieces(words: bytes) -> list[bytes]:
    pieces = [words[i : i + PIECE] for i in range(0, len(words), PIECE)]
    if len(pieces) > 1 and len(pieces[-1]) < PIECE // 4:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    if len(pieces) == 1 and len(words) >= HALVED_FROM:
        cut = words.find(b" ", len(words) // 2)
        pieces = [words[:cut], words[cut:]] if cut > 0 else pieces
    return pieces


def _sizes(words: bytes, names: list[str], compressors: list) -> list[tuple[int, str, int]]:
    """Size, name, and the size of the first half of the pieces."""
    pieces = _pieces(words)
    own = [[len(c.compress(p)) for p in pieces] for c in compressors]
    return sorted((sum(x), name, sum(x[: (len(x) + 1) // 2])) for name, x in zip(names, own))


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """Language, score and whether the result is rejected."""
    if not text or not dictionaries or not _LETTER.search(text):
        return UNDETERMINED, 0.0, True
    words = letters(text)
    names, compressors, again = _compressors(dictionaries)
    sizes = _sizes(b" ".join(dict.fromkeys(words.split())), names, compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    halves = [(sizes[0][2], min(x[2] for x in sizes[1:])), (sizes[0][0] - sizes[0][2], min(x[0] - x[2] for x in sizes[1:]))]
    if sizes[0][0] == sizes[1][0]:
        level = {name for size, name, _ in sizes if size == sizes[0][0]}
        sizes = [x for x in _sizes(words, names, again) if x[1] in level]
        if sizes[0][0] == sizes[1][0]:
            drawn = {name: len(content) for name, content in dictionaries}
            return min((-drawn[name], name) for size, name, _ in sizes if size == sizes[0][0])[1], 0.0, True
    score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    if all(mine > 0 for mine, _ in halves):  # the half in which another language comes nearest, or wins
        lost = min((other - mine) / max(other, mine) for mine, other in halves)
        if lost < LEAST_HALF:
            return sizes[0][1], 0.0, True
    return sizes[0][1], score, score < LEAST_MARGIN


def _classify_batches(shared):
    def run(batches):
        dictionaries = shared.value
        for batch in batches:
            got = [classify(t, dictionaries) for t in batch.column("text").to_pylist()]
            names = [c for c in batch.schema.names if c not in ("lang_pred", "score", "rejected")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return run


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score and rejected. Dictionaries are bounded by ``DICTIONARY_BYTES`` each."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))
    kept = docs.drop("lang_pred", "score", "rejected")
    return kept.mapInArrow(_classify_batches(shared), kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema)
