"""Queries on sources and sinks: the given tables are written into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions import ids
from heliograph.operators import positional
from heliograph.operators.lightcurve import histogram, nan_to_null
from heliograph.plans.adapters import rounded
from heliograph.plans.registry import query
from heliograph.sources import tables
from heliograph.sources.scratch import scratch_path
from heliograph.sources.tables import table
from heliograph.streaming import monitor


def _packed_id() -> Column:
    k = F.col("o_custkey")
    return ids.encode(k % 40, (k % 3600) / 10.0, (k % 170) - F.lit(85.0))


_ID = "(((o_custkey % 40) << 48) | ((o_custkey % 3600) * 1000 << 24) | (175 - o_custkey % 170) * 10000)"


@query(f"SELECT {_ID} AS source_id, o_orderkey, CAST(o_custkey % 40 AS INT) AS partition FROM orders")
def partitioned_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Two partitioned folders, by year of order, written by the partition that an id carries and read as one table."""
    orders = table(spark, folder, "orders").select(_packed_id().alias("source_id"), "o_orderkey", (F.year("o_orderdate") % 2).alias("half"))
    roots = []
    for half in (0, 1):
        roots.append(scratch_path(spark, "root"))
        tables.write_partitioned(orders.where(F.col("half") == half).drop("half"), roots[-1])
    return tables.union_of_roots(spark, roots)


@query(f"SELECT {_ID} AS source_id, o_orderkey FROM orders WHERE {_ID} = (SELECT max({_ID}) FROM orders)")
def source_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One source's rows; the partition comes from the id's bits."""
    path = scratch_path(spark, "sources")
    tables.write_partitioned(table(spark, folder, "orders").select(_packed_id().alias("source_id"), "o_orderkey"), path)
    rows = spark.read.parquet(path)
    return tables.lookup(rows, rows.agg(F.max("source_id")).first()[0]).select("source_id", "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, round(c_acctbal, 2) AS balance, c_nationkey FROM customer")
def csv_by_partition(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files by nation, read back with a stated schema; a missing value stays missing."""
    path = scratch_path(spark, "csv")
    rows = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.round("c_acctbal", 2).alias("balance"), "c_nationkey")
    tables.write_csv(rows, path, "c_nationkey")
    return tables.read_csv(spark, path, "c_custkey long, segment string, balance double, c_nationkey int")


@query("SELECT CAST(least(floor(value / 25), 39) AS INT) AS bin, count(*) AS n, round(log10(count(*) + 1), 6) AS log_n FROM events WHERE value BETWEEN 0 AND 1000 GROUP BY 1")
def json_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """A histogram written as JSON and read back."""
    path = scratch_path(spark, "json")
    tables.write_json(rounded(histogram(table(spark, folder, "events"), "value", 40, 0.0, 1000.0)), path)
    return tables.read_json(spark, path, "bin int, n long, log_n double")


@query("SELECT p_partkey, round(p_retailprice, 2) AS price, round(round(p_retailprice, 2) * 2, 2) AS twice FROM part")
def enriched_copy(spark: SparkSession, folder: str) -> DataFrame:
    """A column added in a new folder, never over the input."""
    source, target = scratch_path(spark, "plain"), scratch_path(spark, "enriched")
    table(spark, folder, "part").select("p_partkey", F.round("p_retailprice", 2).alias("price")).write.parquet(source)
    return tables.enrich(spark, source, target, lambda df: df.withColumn("twice", F.round(F.col("price") * 2, 2)))


@query("SELECT event_id, round(value, 6) AS value FROM events WHERE event_id % 9 <> 0")
def missing_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """NaN counts as missing, and rows that miss a needed column go."""
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"))
    return rounded(nan_to_null(rows).na.drop(subset=["value"]))


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1")
def nested_written(spark: SparkSession, folder: str) -> DataFrame:
    """A nested table of parallel arrays, written and read back."""
    path = scratch_path(spark, "nested")
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_linenumber").alias("lines"))
    rows.write.parquet(path)
    back = spark.read.schema("l_suppkey long, lines array<int>").parquet(path)
    return back.select("l_suppkey", F.size("lines").cast("long").alias("n"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x).alias("lines"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders")
def positional_match(spark: SparkSession, folder: str) -> DataFrame:
    """Ids in one table and values in another, over several files each, matched by their places; unequal lengths would fail."""
    ids_at, values_at = scratch_path(spark, "ids"), scratch_path(spark, "values")
    orders = table(spark, folder, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    orders.select("o_orderkey").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(ids_at)
    orders.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").select("price").write.parquet(values_at)
    return positional.match_by_position(spark.read.parquet(ids_at), spark.read.parquet(values_at)).select("o_orderkey", "price", "row")


@query("SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def whole_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables that must have the same keys, once each, side by side."""
    rows = table(spark, folder, "customer")
    return positional.full_one_to_one(rows.select("c_custkey", F.col("c_acctbal").alias("balance")), rows.select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")


@query("SELECT c_custkey, round(c_acctbal, 2) AS balance, c_nationkey, round(avg(round(c_acctbal, 2)) OVER (PARTITION BY c_nationkey), 4) AS nation_mean FROM customer")
def enriched_in_place(spark: SparkSession, folder: str) -> DataFrame:
    """A column added to a partitioned table in its place, ten partitions in a first run and the others in a second."""
    path = scratch_path(spark, "in-place")
    rows = table(spark, folder, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"), "c_nationkey")
    rows.repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    means = lambda df: df.withColumn("nation_mean", F.round(F.avg("balance").over(Window.partitionBy("c_nationkey")), 4))
    tables.enrich_partitions(spark, path, "c_nationkey", ["nation_mean"], means, at_once=5, most=10)
    tables.enrich_partitions(spark, path, "c_nationkey", ["nation_mean"], means)
    return spark.read.option("mergeSchema", True).parquet(path).select("c_custkey", "balance", "c_nationkey", "nation_mean")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, any_value(c_mktsegment) AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def bucketed_join(spark: SparkSession, folder: str) -> DataFrame:
    """A left 1:1 join of two tables dealt to the same buckets, without an exchange."""
    at = [scratch_path(spark, n) for n in ("bucketed-orders", "bucketed-customers")]
    names = [path.rsplit("/", 1)[-1].replace("-", "_") for path in at]
    orders = tables.write_bucketed(table(spark, folder, "orders").select("o_custkey", "o_totalprice"), names[0], at[0], "o_custkey", 8)
    customers = tables.write_bucketed(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), names[1], at[1], "o_custkey", 8)
    sums = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sums.join(customers.hint("merge"), "o_custkey", "left")


@query("""WITH l AS (SELECT o_custkey % 300 AS part, CAST(o_orderkey % 3 <> 0 AS INT) AS status, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT CAST(status AS VARCHAR) AS status, count(*) AS parts, CAST(sum(k % 1000) AS BIGINT) AS rows, CAST(sum(k % 100) AS BIGINT) AS included FROM l GROUP BY 1""")
def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress lines as a stream of files, each part and status counted once, through a sink that a replay doesn't double."""
    lines, out, state = (scratch_path(spark, n) for n in ("log", "progress", "progress-state"))
    orders = table(spark, folder, "orders")
    part, status, k = F.col("o_custkey") % 300, (F.col("o_orderkey") % 3 != 0).cast("int"), F.col("o_orderkey")
    line = F.concat_ws("_", part, status, k % 1000, k % 100, F.lit("1.5"))
    # a part's first line comes first; others of the same part and status are in later files
    first = orders.groupBy(part.alias("p"), status.alias("s")).agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    orders.join(first, "o_orderkey", "left_semi").select(line.alias("value")).coalesce(1).write.text(lines)
    monitor.log_sink(monitor.completion_stream(spark.readStream.schema("value string").text(lines)), out, state, "complete").awaitTermination()
    orders.select(line.alias("value")).write.mode("append").text(lines)
    monitor.log_sink(monitor.completion_stream(spark.readStream.schema("value string").text(lines)), out, state, "complete").awaitTermination()
    return monitor.latest(spark, out, "status")


@query("SELECT c_nationkey AS part, count(*) AS n, CAST(count(DISTINCT c_custkey % 2) AS BIGINT) AS runs FROM customer GROUP BY 1")
def outputs_by_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Partial outputs of two runs, grouped by the partition number in their files' names."""
    path = scratch_path(spark, "outputs")
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    for run in (0, 1):
        tables.write_csv(rows.where(F.col("c_custkey") % 2 == run), f"{path}/run{run}", "c_nationkey")
    parts = [tables.file_parts(tables.read_csv(spark, f"{path}/run{run}", "c_custkey long"), r"c_nationkey=(\d+)/").withColumn("run", F.lit(run)) for run in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"))
