"""Queries on scalar and array functions: positions, pixels, identifiers, magnitudes, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import arrays, geo, healpix, ids
from heliograph.operators import graph
from heliograph.plans.adapters import positions, rounded, sky_sql
from heliograph.plans.registry import query
from heliograph.sources.tables import table

_C = "WITH c AS (" + sky_sql("customer", "c_custkey") + ")"


@query("WITH c AS (" + sky_sql("customer", "c_custkey", extra=", c_nationkey") + """), s AS (SELECT c_nationkey, count(*) AS n, avg(cos(radians(dec)) * cos(radians(ra))) AS x, avg(cos(radians(dec)) * sin(radians(ra))) AS y, avg(sin(radians(dec))) AS z FROM c GROUP BY 1)
SELECT c_nationkey, n, round(degrees(atan2(y, x)) - 360 * floor(degrees(atan2(y, x)) / 360), 6) AS ra, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS dec FROM s""")
def centroid(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder, "customer", "c_custkey").join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return rounded(graph.centroids(rows, "c_nationkey", "ra", "dec"))


_IDS = _C + ", i AS (SELECT *, CAST(c_custkey % 12288 AS BIGINT) AS part, CAST(round(ra * 10000) AS BIGINT) AS a, CAST(round((90 - dec) * 10000) AS BIGINT) AS d FROM c), e AS (SELECT *, (part << 48) | (a << 24) | d AS source FROM i)"


@query(_IDS + " SELECT c_custkey, source FROM e")
def id_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder, "customer", "c_custkey")
    return rows.select("c_custkey", ids.encode(F.col("c_custkey") % 12288, F.col("ra"), F.col("dec")).alias("source"))


@query(_IDS + " SELECT c_custkey, CAST(source >> 48 AS INT) AS part, round(((source >> 24) & 16777215) / 10000, 6) AS ra, round(90 - (source & 16777215) / 10000, 6) AS dec FROM e")
def id_decode(spark: SparkSession, folder: str) -> DataFrame:
    ra, dec = ids.position_of(F.col("source"))
    return rounded(id_encode(spark, folder).select("c_custkey", ids.partition_of(F.col("source")).alias("part"), ra.alias("ra"), dec.alias("dec")))


@query("SELECT o_orderkey, (o_orderkey * 7919) % 805306368 AS pixel, ((o_orderkey * 7919) % 805306368) >> 16 AS parent5, ((((o_orderkey * 7919) % 805306368) >> 16) << 2) + 3 AS last_child6 FROM orders")
def healpix_parent(spark: SparkSession, folder: str) -> DataFrame:
    pixel = (F.col("o_orderkey") * 7919) % 805306368
    parent = healpix.parent(pixel, 13, 5)
    return table(spark, folder, "orders").select("o_orderkey", pixel.alias("pixel"), parent.alias("parent5"), F.element_at(healpix.children(parent, 5, 6), -1).alias("last_child6"))


_PIX = """, b AS (SELECT *, sin(radians(dec)) AS z, (ra - 360 * floor(ra / 360)) / 90 AS t FROM c),
 q AS (SELECT *, CAST(floor(32 * (0.5 + t) - 32 * z * 0.75) AS BIGINT) AS up, CAST(floor(32 * (0.5 + t) + 32 * z * 0.75) AS BIGINT) AS dn, least(3, CAST(floor(t) AS BIGINT)) AS n, 32 * sqrt(3 * (1 - abs(z))) AS r FROM b),
 f AS (SELECT *, abs(z) <= 2.0::DOUBLE / 3 AS belt, least(31, CAST(floor((t - n) * r) AS BIGINT)) AS p1, least(31, CAST(floor((1 - t + n) * r) AS BIGINT)) AS p2 FROM q),
 g AS (SELECT *, CASE WHEN belt THEN CASE WHEN up >> 5 = dn >> 5 THEN ((up >> 5) & 3) + 4 WHEN up >> 5 < dn >> 5 THEN up >> 5 ELSE (dn >> 5) + 8 END WHEN z >= 0 THEN n ELSE n + 8 END AS face,
 CASE WHEN belt THEN dn & 31 WHEN z >= 0 THEN 31 - p2 ELSE p1 END AS x, CASE WHEN belt THEN 31 - (up & 31) WHEN z >= 0 THEN 31 - p1 ELSE p2 END AS y FROM f)
SELECT c_custkey, face * 1024 + (x & 1) + ((x >> 1) & 1) * 4 + ((x >> 2) & 1) * 16 + ((x >> 3) & 1) * 64 + ((x >> 4) & 1) * 256 + 2 * ((y & 1) + ((y >> 1) & 1) * 4 + ((y >> 2) & 1) * 16 + ((y >> 3) & 1) * 64 + ((y >> 4) & 1) * 256) AS pixel FROM g"""


@query(_C + _PIX)
def healpix_pixel(spark: SparkSession, folder: str) -> DataFrame:
    return positions(spark, folder, "customer", "c_custkey").select("c_custkey", healpix.pixel(F.col("ra"), F.col("dec"), 5).alias("pixel"))


@query("""WITH p AS (SELECT l_partkey, count(*) * 5000000.0::DOUBLE AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, CAST(greatest(5, CASE WHEN n < 80000000 THEN ceil(0.5 * log2(n / 19e6)) ELSE least(12, 5 + ceil(0.5 * log2(n / 1e6))) END) AS INT) AS k FROM p""")
def subdivision_order(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "lineitem").groupBy("l_partkey").agg((F.count(F.lit(1)) * 5e6).alias("n"))
    return counts.select("l_partkey", healpix.subdivision_order(F.col("n")).alias("k"))


@query(_C + """, b AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, sin(radians(dec)) * sin(radians(27.12825)) + cos(radians(dec)) * cos(radians(27.12825)) * cos(radians(ra - 192.85948)))))) AS b FROM c)
SELECT c_custkey, round(b, 6) AS b, round(greatest(0.0, (10 - abs(b)) / 10), 6) AS modifier FROM b""")
def galactic_latitude(spark: SparkSession, folder: str) -> DataFrame:
    b = geo.galactic_latitude(F.col("ra"), F.col("dec"))
    return rounded(positions(spark, folder, "customer", "c_custkey").select("c_custkey", b.alias("b"), geo.galactic_modifier(b).alias("modifier")))


@query(_C + """, t AS (SELECT *, CAST(round(ra / 15 * 360000) AS BIGINT) AS k, CAST(floor(abs(dec) * 36000 + 1e-6) AS BIGINT) AS d FROM c)
SELECT c_custkey, 'J' || lpad(CAST((k // 360000) % 24 AS VARCHAR), 2, '0') || lpad(CAST((k // 6000) % 60 AS VARCHAR), 2, '0') || lpad(CAST((k // 100) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0')
 || CASE WHEN dec < 0 THEN '-' ELSE '+' END || lpad(CAST(d // 36000 AS VARCHAR), 2, '0') || lpad(CAST((d // 600) % 60 AS VARCHAR), 2, '0') || lpad(CAST((d // 10) % 60 AS VARCHAR), 2, '0') || '.' || CAST(d % 10 AS VARCHAR) AS name FROM t""")
def designation(spark: SparkSession, folder: str) -> DataFrame:
    return positions(spark, folder, "customer", "c_custkey").select("c_custkey", ids.designation(F.col("ra"), F.col("dec")).alias("name"))


@query("SELECT p_partkey, round(CASE WHEN p_size > 0 THEN p_retailprice / 100 - 5 * (log10(p_size) - 1) END, 6) AS absolute_mag FROM part")
def absolute_magnitude(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(table(spark, folder, "part").select("p_partkey", geo.absolute_magnitude(F.col("p_retailprice") / 100, F.col("p_size")).alias("absolute_mag")))


_LIST = "list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH e AS (SELECT vec_id, {_LIST} AS a FROM embeddings), g AS (SELECT vec_id, a, list_transform(a, lambda x: exp(x - list_max(a))) AS g FROM e)
SELECT vec_id, CAST(list_position(a, list_max(a)) - 1 AS INT) AS class, round(list_max(g) / list_sum(g), 6) AS confidence FROM g""")
def softmax_argmax(spark: SparkSession, folder: str) -> DataFrame:
    a = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    rows = table(spark, folder, "embeddings").select("vec_id", a.alias("a"))
    return rounded(rows.select("vec_id", arrays.argmax(F.col("a")).alias("class"), F.array_max(arrays.softmax(F.col("a"))).alias("confidence")))


@query("SELECT vec_id, list_transform(range(0, 10), lambda i: CAST(i = label AS INT)) AS hot FROM embeddings".replace("list_transform(range(0, 10), lambda i: CAST(i = label AS INT)) AS hot", "array_to_string(list_transform(range(0, 10), lambda i: CAST(CAST(i = label AS INT) AS VARCHAR)), '') AS hot"))
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.array_join(F.transform(arrays.one_hot(F.col("label"), 10), lambda x: x.cast("string")), "").alias("hot"))


@query(f"""WITH e AS (SELECT vec_id, {_LIST} AS a FROM embeddings), s AS (SELECT vec_id, list_sum(list_transform(range(0, 10), lambda i: a[i + 1] * cos(-2 * pi() * 2 * i / 10))) AS c, list_sum(list_transform(range(0, 10), lambda i: a[i + 1] * sin(-2 * pi() * 2 * i / 10))) AS d FROM e)
SELECT vec_id, round(sqrt(c * c + d * d) / sqrt(10), 6) AS amplitude FROM s""")
def fourier_amplitude(spark: SparkSession, folder: str) -> DataFrame:
    a = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    rows = table(spark, folder, "embeddings").select("vec_id", a.alias("a"))
    return rounded(rows.select("vec_id", arrays.fourier_amplitude(F.col("a"), 2).alias("amplitude")))


@query(f"""WITH e AS (SELECT vec_id, {_LIST} AS a FROM embeddings), r AS (SELECT vec_id, list_position(a, list_min(a)) AS k, a FROM e)
SELECT vec_id, round(a[k], 6) AS first, round(CASE WHEN k < 10 THEN a[k + 1] ELSE a[1] END, 6) AS second, round(a[1] + a[3] + a[5] + a[7] + a[9], 6) AS even_sum FROM r""")
def rotate_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays turned so that the least value is first, and every other value of an array."""
    a = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    rows = table(spark, folder, "embeddings").select("vec_id", a.alias("a")).withColumn("r", arrays.rotated(F.col("a"), (F.array_position("a", F.array_min("a")) - 1).cast("int")))
    return rounded(rows.select("vec_id", F.element_at("r", 1).alias("first"), F.element_at("r", 2).alias("second"), arrays.total(arrays.every(F.col("a"), 2)).alias("even_sum")))


@query("SELECT p_partkey, round_even(p_retailprice / 7, 3) AS half_even, round(p_retailprice / 7, 3) AS half_up, CAST(trunc(p_retailprice / 7) AS BIGINT) AS cut, lpad(CAST(p_size AS VARCHAR), 4, '0') AS filled, split_part(p_name, ' ', 1) AS first_word, trim('  ' || p_brand || ' ') AS trimmed FROM part")
def scalar_formats(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("p_retailprice") / 7
    return table(spark, folder, "part").select(
        "p_partkey", F.bround(v, 3).alias("half_even"), F.round(v, 3).alias("half_up"), F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).alias("cut"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("filled"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("first_word"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
    )


@query("SELECT DISTINCT pixel, true AS own FROM (" + _C + _PIX + ")")
def pixel_centres(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of the customers: whether each holds its own centre."""
    pixels = healpix_pixel(spark, folder).select("pixel").distinct()
    ra, dec = healpix.centre(F.col("pixel").cast("long"), 5)
    at = pixels.withColumns({"_ra": ra, "_dec": dec})
    return at.select("pixel", (healpix.pixel(F.col("_ra"), F.col("_dec"), 5) == F.col("pixel")).alias("own"))
