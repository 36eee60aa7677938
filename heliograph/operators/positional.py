"""Matching by position or by key where both sides have to be whole: a difference in length ends the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, column: str = "row") -> DataFrame:
    """Rows of a table read from Parquet files, numbered from 0 over all files in order of their names.

    A row's place in its file comes from the reader; only a count for each file goes through a window, and is joined back,
    so that rows are neither sorted nor gathered. Files without rows take no numbers.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select("_file", before.alias("_before"))
    return placed.join(offsets, "_file").withColumn(column, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def _both(left: DataFrame, right: DataFrame, key: str, message: str, suffix: str) -> DataFrame:
    """Full join by a key that each side must have once and the other too, else an error with ``message``."""
    renamed = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c != key})

    def once(df: DataFrame, name: str) -> DataFrame:
        values = F.struct(*[c for c in df.columns if c != key], F.lit(1).alias("_there"))
        return df.groupBy(key).agg(F.min(values).alias(name), F.count(F.lit(1)).alias(f"{name}n"))

    joined = once(left, "_l").join(once(renamed, "_r"), key, "full")
    whole = (F.col("_ln") == 1) & (F.col("_rn") == 1)
    # the error stands in the key, so that no column can be read past it
    checked = joined.withColumn(key, F.when(whole, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(left.schema[key].dataType)))
    checked = checked.where(F.col(key).isNotNull())
    return checked.select(key, *[F.col(f"_l.{c}").alias(c) for c in left.columns if c != key], *[F.col(f"_r.{c}").alias(c) for c in renamed.columns if c != key])


def match_by_position(left: DataFrame, right: DataFrame, column: str = "row", suffix: str = "_r") -> DataFrame:
    """Row i of one Parquet table beside row i of the other; fails if one is longer. Columns of both, by number."""
    return _both(numbered(left, column), numbered(right, column), column, "tables of different lengths, at row", suffix)


def full_one_to_one(left: DataFrame, right: DataFrame, key: str, suffix: str = "_r") -> DataFrame:
    """Both tables side by side by a key; fails if a key is null, repeated, or on one side only."""
    return _both(left, right, key, f"{key} isn't on both sides once", suffix)
