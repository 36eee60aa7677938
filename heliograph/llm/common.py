"""Helpers shared by the text operators: shared scratch tables, Arrow text buffers, ordered shards."""

from __future__ import annotations

import contextlib
import os
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.sources.scratch import clear_scratch, discard, materialise, scratch_path, shared_dir, small_batches  # noqa: F401

#: Upper bound of the text bytes that one numpy pass works on; a longer document makes a pass of its own.
PASS_BYTES = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of a single longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) over all rows."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - base, lengths)


def shard_count(spark: SparkSession, per_partition: int = 8) -> int:
    """More shards than shuffle partitions, so that hashing deals them out evenly."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ordered_shards(df: DataFrame, key: str, shards: int, column: str = "shard") -> DataFrame:
    """Add an ordered shard number from quantiles of ``key``; a null key gets the last shard.

    Only the quantile bounds, ``shards`` numbers at most, reach the driver.
    """
    cuts = [i / shards for i in range(1, shards)]
    bounds: list[float] = []
    if cuts:
        got = df.select(F.percentile_approx(F.col(key).cast("double"), cuts, 10 * shards).alias("q")).first()["q"]
        bounds = sorted({float(x) for x in got or []})
    if not bounds:
        return df.withColumn(column, F.when(F.col(key).isNull(), 1).otherwise(0))
    splits = [-float("inf"), *bounds, float("inf")]
    binned = Bucketizer(splits=splits, inputCol="_shard_key", outputCol="_shard_bin", handleInvalid="keep").transform(
        df.withColumn("_shard_key", F.col(key).cast("double"))
    )
    return binned.withColumn(column, F.coalesce(F.col("_shard_bin").cast("int"), F.lit(len(splits) - 1))).drop("_shard_key", "_shard_bin")


def hashed_share(share, *columns):
    """Rows whose hash of ``columns`` falls in the first ``share``: a sample that needs no order and no shuffle."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < F.lit(float(1 << 40)) * share


def worker_file(name: str, content: bytes) -> str:
    """Local file of this worker process with ``content``, for memory mapping; written once and renamed into place.

    Of files with the same beginning, up to the first ``-``, all but the newest few go after an hour, which no mapping
    needs; a mapped file lives on until closed, and a lost one is written again from the broadcast.
    """
    folder = os.path.join(tempfile.gettempdir(), f"heliograph-{os.getuid()}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with contextlib.suppress(FileNotFoundError):
        os.utime(path)  # in use: other workers leave it for another hour
        return path
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as out:
        out.write(content)
    os.replace(out.name, path)
    own, stem = [], name.split("-")[0] + "-"
    for e in os.scandir(folder):
        with contextlib.suppress(FileNotFoundError):  # another worker may be at the same
            if e.name.startswith(stem):
                own.append((e.stat().st_mtime, e.path))
    for written, old in sorted(own)[:-3]:
        if written < time.time() - 3600:
            with contextlib.suppress(FileNotFoundError):
                os.remove(old)
    return path
