"""Progress and sessions, over finished tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators.epochs import sessions


def parse_progress(lines: DataFrame) -> DataFrame:
    """Lines ``partition_status_rows_included_seconds`` as columns; malformed lines give nulls."""
    parts = F.split("value", "_")
    at = lambda i, kind: F.get(parts, i).try_cast(kind)
    return lines.select(at(0, "int").alias("part"), F.get(parts, 1).alias("status"), at(2, "long").alias("rows"), at(3, "long").alias("included"), at(4, "double").alias("seconds"))


def progress(log: DataFrame, total: int) -> DataFrame:
    """Rows done, their share of ``total``, rows a second, and seconds to go."""
    out = log.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("done"), F.sum("seconds").alias("seconds"))
    rate = F.try_divide(F.col("done"), F.col("seconds"))
    return out.select("done", (F.col("done") / total).alias("share"), rate.alias("rate"), F.try_divide(total - F.col("done"), rate).alias("seconds_left"))


def progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same sums over log files as they arrive; the state holds the numbers of the parts met, some thousands."""
    return parse_progress(spark.readStream.text(folder)).groupBy("status").agg(F.sum("rows").alias("rows"), F.size(F.collect_set("part")).cast("long").alias("parts"))


def completion_stream(lines: DataFrame) -> DataFrame:
    """Parts, rows and seconds by status, each (part, status) counted once whatever is written or read again.

    The first line of a part and status counts. The state holds one entry for each part and status, and the sums.
    """
    known = parse_progress(lines).where("part is not null and status is not null").dropDuplicates(["part", "status"])
    return known.groupBy("status").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("included").alias("included"))


def log_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start writing a stream's batches to ``path``, each to a folder of its number: a batch that is replayed replaces itself.

    The query goes on from ``checkpoint`` when started again, and ends when all that has arrived is written.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row of each key over all batches of :func:`log_sink` in update mode."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max(F.struct("batch", F.struct("*").alias("row"))).alias("last")).select("last.row.*").drop("batch")


def session_stream(spark: SparkSession, folder: str, schema, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions of an event stream; those that ended before the watermark are final and leave the state."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late)
    return sessions(events, key, time, gap)
