"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A token file is a Parquet folder of blocks. A block holds consecutive documents of one shard: their ids, token counts and
running start, a stream of control bytes (four 2-bit lengths each) and a stream of data bytes. An id is written as its
rank by frequency in the whole corpus, so that the commonest 256 ids take one byte. The rank table is a second folder.
Parquet's committer makes a lost executor's half-written block invisible, and any file system that Spark reads will do.

Shards are ranges of ``doc_id``, dealt to the files in order: files by name, and blocks within a file, ascend with it.
Rows with the same ``doc_id`` are in the order of their text's first ``TIE_CHARS`` characters, then of their ids; a null
``doc_id`` comes last; a null text is empty and holds the end id alone; an empty table gives empty files. Other columns
are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import discard, materialise, ordered_shards, passes, ranges, scratch_path, shard_count, text_buffers
from heliograph.llm.lexicon import byte_alphabet
from heliograph.llm.pretokens import Distinct, WordValues, boundaries, code_points

#: Tokens in a block at most, unless a single document has more.
BLOCK_TOKENS = 1 << 18
#: Pre-tokens whose ids a worker keeps; beyond it the memory is emptied and filled anew.
KEPT_WORDS = 500_000
#: Characters of a text that order rows with one doc_id.
TIE_CHARS = 64
# Lengths in bytes of the four values that a control byte describes, and the places of their bytes in the data stream.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
WIDTH = LENGTHS.sum(1).astype(np.int64)
PLACE = np.cumsum(LENGTHS, 1).astype(np.int64) - LENGTHS


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-len(values) % 4 + len(values), np.uint8)
    code[: len(values)] = size - 1
    control = code.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again; tables by control byte give each value's place and length."""
    codes = np.frombuffer(control, np.uint8)
    group = np.cumsum(WIDTH[codes]) - WIDTH[codes]
    place = (group[:, None] + PLACE[codes]).ravel()[:count]
    size = LENGTHS[codes].ravel()[:count]
    stream = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = stream[place].astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(size > k)
        if not len(some):
            break
        out[some] |= stream[place[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, special


#: A byte-level vocabulary's character for each byte, as a table for str.translate.
BYTE_CHARS = {byte: char for char, byte in byte_alphabet().items()}


def model_ids(model, words: list[str]) -> Iterator[list[int]]:
    """Ids of pre-tokens by a byte-level model of the library."""
    for word in words:
        yield [token.id for token in model.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARS))]


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each different pre-token of a byte-level model.

    Texts in which an added token's string occurs go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer, special = _tokenizer(path)
        self.model = self.tokenizer.model
        self.special = [s.encode() for s in special]
        self.known = WordValues(KEPT_WORDS)

    def each(self, tokens: Distinct) -> tuple[np.ndarray, np.ndarray]:
        """Starts in ``known.values`` and numbers of ids of all different pre-tokens."""
        if 2 * len(tokens.codes) > self.known.most:  # a text of its own size: what it needs has to fit at once
            self.known = WordValues(4 * len(tokens.codes))
        checks = tokens.checks()
        while True:
            start, length = self.known.find(tokens.codes, checks)
            new = np.flatnonzero(start < 0)
            if not len(new):
                return start, length
            ids = [*model_ids(self.model, tokens.words(new))]
            sizes = np.array([len(x) for x in ids], np.int64)
            # a full memory is emptied first, and then the loop's second round adds what it held
            self.known.add(tokens.codes[new], checks[new], np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text."""
        points, places = code_points(raw, offsets)
        starts = boundaries(points, places)
        tokens = Distinct(points, starts)
        begin, size = self.each(tokens)
        slot = np.zeros(len(starts), np.int64)
        slot[tokens.first] = np.arange(len(tokens.first))
        which = slot[tokens.first[tokens.of]] if len(starts) else slot
        ids = self.known.values[ranges(begin[which], size[which])].astype(np.uint32)
        ends = np.concatenate(([0], np.cumsum(size[which])))[np.searchsorted(starts, places)]
        counts = np.diff(ends)
        whole = raw.tobytes()
        if any(s in whole for s in self.special):
            parts = np.split(ids, ends[1:-1])
            for i in range(len(parts)):
                text = whole[offsets[i] : offsets[i + 1]]
                if any(s in text for s in self.special):
                    parts[i] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One per worker process and file, so that tasks share the pre-tokens seen before."""
    return LibraryEncoder(path)


def _encode_batches(path: str, end_id: int):
    def run(batches):
        encoder = library_encoder(path)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in passes(offsets):
                ids, counts = encoder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts = [np.append(p, np.uint32(end_id)).astype("<u4") for p in np.split(ids, np.cumsum(counts)[:-1])]
                short = all(int(p.max()) < 1 << 16 for p in parts)
                kept = [batch.column(c).slice(lo, hi - lo) for c in ("shard", "doc_id", "tie")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(counts + 1, pa.int64()), pa.array([2 if short else 4] * len(parts), pa.int32()), pa.array([(p.astype("<u2") if short else p).tobytes() for p in parts], pa.binary())],
                    ["shard", "doc_id", "tie", "n_tokens", "width", "ids"],
                )

    return run


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2" if w == 2 else "<u4") for x, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]


def _count_batches(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for part in _ids(batch):
            got = np.bincount(part)
            if len(got) > len(total):
                total = np.concatenate((total, np.zeros(len(got) - len(total), np.int64)))
            total[: len(got)] += got
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])


def _block_batches(rank):
    """Blocks of consecutive rows of a shard; a shard's rows lie in one task, one after the other."""

    def block(shard: int, start: int, rows: list[tuple[int | None, np.ndarray]], table: np.ndarray) -> pa.RecordBatch:
        control, data = pack(table[np.concatenate([ids for _, ids in rows])])
        row = [[shard], [start], [[d for d, _ in rows]], [[len(ids) for _, ids in rows]], [control], [data]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["shard", "shard_start", "doc_ids", "lengths", "control", "data"])

    def run(batches):
        table = rank.value
        shard, start, rows, size = None, 0, [], 0
        for batch in batches:
            for own, doc_id, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), _ids(batch)):
                if rows and (own != shard or size + len(ids) > BLOCK_TOKENS):
                    yield block(shard, start, rows, table)
                    start, rows, size = start + size, [], 0
                if own != shard:
                    shard, start = own, 0
                rows.append((doc_id, ids))
                size += len(ids)
        if rows:
            yield block(shard, start, rows, table)

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id`` to each and write the files under ``path``.

    Texts are encoded where they lie; one shuffle moves their ids, some quarter of the bytes, into ranges of ``doc_id``.
    What reaches the driver is one count for each id that occurs, which the vocabulary bounds.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    shards = shard_count(spark, 4)
    sharded = ordered_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.substring(text, 1, TIE_CHARS).alias("tie")), "doc_id", shards)
    encoded = sharded.mapInArrow(_encode_batches(tokenizer, end_id), "shard int, doc_id long, tie string, n_tokens long, width int, ids binary")
    encoded = materialise(encoded, "token-ids")
    counted = encoded.select("width", "ids").mapInArrow(_count_batches, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counted = counted.sort_values(["n", "id"], ascending=[False, True])
    by_rank = counted["id"].to_numpy(np.uint32)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids_by_rank binary").write.parquet(f"{path}/ranks")
    files = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = encoded.repartitionById(files, F.floor(F.col("shard") * files / (shards + 1)).cast("int"))
    ordered = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "tie", "ids").select("shard", "doc_id", "width", "ids")
    ordered.mapInArrow(_block_batches(spark.sparkContext.broadcast(rank)), "shard int, shard_start long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(encoded)


def _read_batches(by_rank):
    def run(batches):
        table = by_rank.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = table[unpack(row["control"], row["data"], int(lengths.sum()))].astype("<u4")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(lengths), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["shard_start"] + ends - lengths), pa.array(lengths), pa.array([p.tobytes() for p in np.split(ids, ends[:-1])], pa.binary())],
                    ["shard", "doc_id", "shard_start", "n_tokens", "ids"],
                )

    return run


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard, doc_id, shard_start, n_tokens, ids) of a token file; ids are little-endian unsigned 32-bit integers."""
    got = spark.read.schema("ids_by_rank binary").parquet(f"{path}/ranks").first()
    by_rank = np.frombuffer(bytes(got["ids_by_rank"]), "<u4") if got else np.zeros(0, np.uint32)
    blocks = spark.read.schema("shard int, shard_start long, doc_ids array<long>, lengths array<long>, control binary, data binary").parquet(f"{path}/blocks")
    return blocks.mapInArrow(_read_batches(spark.sparkContext.broadcast(by_rank)), "shard int, doc_id long, shard_start long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before a row, to rows of :func:`read_token_file`.

    The window without a partition runs over one row for each shard only.
    """
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def _digest_batches(batches):
    for batch in batches:
        crc = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id", "shard_start", "n_tokens")), pa.array(crc, pa.int64())], ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"])


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder, read it back, and digest each document's ids."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-file")
    write_token_file(docs, path, tokenizer, end_id)
    rows = read_token_file(spark, path).mapInArrow(_digest_batches, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    return with_starts(materialise(rows, "token-digests")).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
