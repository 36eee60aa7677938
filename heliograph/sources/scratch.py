"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Only a session on one machine may leave it unset; a cluster without it is an error, since executors would write into
    folders of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="heliograph-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of this session under the shared folder; :func:`clear_scratch` removes all of them."""
    return f"{shared_dir(spark)}/heliograph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def has_path(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Rows of an Arrow batch where :func:`small_batches` holds. Spark's own 10,000 are a task's whole part of many tables.
BATCH_ROWS = 1_000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of ``rows`` at most in what is run inside: the JVM, outside its heap, and the worker hold a batch each.

    Spark reads the setting when it runs a query, so that this is for tables written inside. The session's own value, if
    smaller, stays, and is back afterwards.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove_path(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything that this session has written to the shared folder; results not yet read are lost with it."""
    remove_path(spark, f"{shared_dir(spark)}/heliograph-{spark.sparkContext.applicationId}")
