"""Sources and sinks: partitioned Parquet roots, pruned lookups, CSV and JSON, packed and enriched writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import ids
from heliograph.sources.scratch import has_path, remove_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def union_of_roots(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Hive-partitioned Parquet folders (one a year, say) as one table; partition columns are found in each."""
    out = spark.read.parquet(roots[0])
    for root in roots[1:]:
        out = out.unionByName(spark.read.parquet(root), allowMissingColumns=True)
    return out


def with_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among ``keys``; Spark picks the join and may filter the scan at run time."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def lookup(df: DataFrame, source: int, key: str = "source_id", partition: str = "partition") -> DataFrame:
    """One source's rows: the partition comes from the id's bits, so that other folders aren't listed or read."""
    return df.where((F.col(partition) == (source >> 48)) & (F.col(key) == source))


def write_partitioned(df: DataFrame, path: str, key: str = "source_id", partition: str = "partition", rows_per_file: int = 5_000_000) -> None:
    """Parquet by the partition that an id carries; a crowded partition is dealt to several files by a salt."""
    rows = df.withColumn(partition, ids.partition_of(F.col(key)))
    salt = F.pmod(F.xxhash64(key), F.lit(16))
    rows.repartition(partition, salt).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(partition).parquet(path)


def enrich(spark: SparkSession, source: str, target: str, add) -> DataFrame:
    """Write ``add(table)`` to a new folder, never over its input, and read it back."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("an enriched table goes to a folder of its own")
    add(spark.read.parquet(source)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def enrich_partitions(spark: SparkSession, path: str, partition: str, added: Sequence[str], add: Callable[[DataFrame], DataFrame], at_once: int = 64, most: int | None = None) -> int:
    """Columns ``added`` to a partitioned Parquet table in its place, by ``add`` on rows without them; the partitions done.

    ``at_once`` partitions are written to a folder beside the table, replace their old ones, and are noted as done. A run
    that is stopped goes on where it was: a whole staged folder is put in place first, a part of one is thrown away,
    partitions noted as done are skipped, and one replaced but not noted is done again from the same rows. ``most``
    partitions at most are done in a run. Partition values, some thousands, reach the driver; null is one of them.
    """
    staged, noted = f"{path.rstrip('/')}.staged", f"{path.rstrip('/')}.done"

    def put_in_place() -> int:
        kind = spark.read.parquet(path).schema[partition].dataType  # a folder of the null partition alone doesn't tell
        rows = spark.read.option("mergeSchema", True).parquet(staged)
        rows = rows.withColumn(partition, F.col(partition).cast(kind))
        values = rows.select(partition).distinct()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        values.withColumn("done", F.lit(True)).coalesce(1).write.mode("append").parquet(noted)
        n = values.count()
        remove_path(spark, staged)
        return n

    count = 0
    if has_path(spark, f"{staged}/_SUCCESS"):
        count += put_in_place()
    while most is None or count < most:
        rows = spark.read.option("mergeSchema", True).parquet(path)
        todo = rows.select(partition).distinct()
        if has_path(spark, noted):
            done = spark.read.parquet(noted).select(F.col(partition).alias("_done")).distinct()
            todo = todo.join(done, F.col(partition).eqNullSafe(F.col("_done")), "left_anti")
        some = [r[0] for r in todo.orderBy(partition).limit(at_once if most is None else min(at_once, most - count)).collect()]
        if not some:
            break
        wanted = F.col(partition).isin([v for v in some if v is not None])
        plain = rows.drop(*added).where(wanted | F.col(partition).isNull() if None in some else wanted)
        add(plain).write.mode("overwrite").partitionBy(partition).parquet(staged)
        count += put_in_place()
    return count


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table in ``path`` whose rows are dealt to ``buckets`` by key, sorted in each: joins and sums by the key need no exchange."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV files with a header and a stated schema; an empty field is null, and missing files of a glob aren't read."""
    return spark.read.schema(schema).option("header", True).option("ignoreMissingFiles", True).csv(path)


def write_csv(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = (df.repartition(partition) if partition else df).write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def partition_sizes(counts: DataFrame, partition: str, rows: str) -> DataFrame:
    """Rows of each partition over all years' sidecar tables."""
    return counts.groupBy(partition).agg(F.sum(rows).alias("rows"))


def file_parts(df: DataFrame, pattern: str, column: str = "part") -> DataFrame:
    """Add a number parsed from the file that a row came from."""
    return df.withColumn(column, F.regexp_extract(F.input_file_name(), pattern, 1).cast("long"))
