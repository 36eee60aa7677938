"""Queries on joins: positions, keys, labels, clustering, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import geo
from heliograph.operators import density, graph, reach
from heliograph.operators import joins as jn
from heliograph.plans.adapters import haversine_sql, positions, rounded, sky_sql
from heliograph.plans.registry import query
from heliograph.sources.scratch import materialise
from heliograph.sources.tables import table, with_keys

_ON = lambda key: (key, "ra", "dec")
_CS = "WITH c AS (" + sky_sql("customer", "c_custkey", 0.7) + "), p AS (" + sky_sql("part", "p_partkey", extra=", p_retailprice, p_size") + f"), m AS (SELECT c_custkey, p_partkey, p_retailprice, p_size, {haversine_sql('c', 'p')} AS arcsec FROM c JOIN p ON abs(c.dec - p.dec) < 0.6 WHERE {haversine_sql('c', 'p')} <= {{r}})"


def _pairs(spark: SparkSession, folder: str, arcsec: float) -> DataFrame:
    return jn.within_radius(positions(spark, folder, "customer", "c_custkey", 0.7), positions(spark, folder, "part", "p_partkey"), arcsec, _ON("c_custkey"), _ON("p_partkey"))


@query(_CS.format(r=1500) + " SELECT c_custkey, p_partkey, round(arcsec, 4) AS arcsec FROM m")
def radius_join(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_pairs(spark, folder, 1500), 4)


@query(_CS.format(r=1500) + " SELECT c_custkey, arg_min(p_partkey, (arcsec, p_partkey)) AS p_partkey, round(min(arcsec), 4) AS arcsec FROM m GROUP BY 1")
def nearest_join(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reach.nearest(positions(spark, folder, "customer", "c_custkey", 0.7), positions(spark, folder, "part", "p_partkey"), 1500, _ON("c_custkey"), _ON("p_partkey")), 4)


@query(_CS.format(r=1800) + " SELECT c.c_custkey, count(m.p_partkey) AS n_in_radius FROM c LEFT JOIN m USING (c_custkey) GROUP BY 1")
def radius_count(spark: SparkSession, folder: str) -> DataFrame:
    return jn.radius_count(positions(spark, folder, "customer", "c_custkey", 0.7), positions(spark, folder, "part", "p_partkey"), 1800, _ON("c_custkey"), _ON("p_partkey"))


@query(_CS.format(r=1800) + ", n AS (SELECT c_custkey, p_partkey, p_retailprice AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS size FROM m) SELECT c_custkey, round(arg_min(price, (price, p_partkey)), 6) AS price, arg_min(size, (price, p_partkey)) AS size FROM n GROUP BY 1")
def brightest_match(spark: SparkSession, folder: str) -> DataFrame:
    """The brightest partner within the radius; each column's first value that isn't missing."""
    ra, dec = geo.spread_position(F.col("p_partkey").cast("double"))
    right = table(spark, folder, "part").select("p_partkey", ra.alias("ra"), dec.alias("dec"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("size"))
    return rounded(jn.best_within(positions(spark, folder, "customer", "c_custkey", 0.7), right, 1800, _ON("c_custkey"), _ON("p_partkey"), "price", ["price", "size"]))


@query("WITH p AS (" + sky_sql("part", "p_partkey") + "), q AS (SELECT 187.5::DOUBLE AS ra, -2.4::DOUBLE AS dec), d AS (SELECT p_partkey, " + haversine_sql("p", "q") + " AS arcsec FROM p, q) SELECT p_partkey, round(arcsec, 4) AS arcsec FROM d WHERE arcsec < 36000")
def haversine_cone(spark: SparkSession, folder: str) -> DataFrame:
    from heliograph.functions import geo

    rows = positions(spark, folder, "part", "p_partkey")
    d = geo.haversine_arcsec(F.col("ra"), F.col("dec"), F.lit(187.5), F.lit(-2.4))
    return rounded(rows.select("p_partkey", d.alias("arcsec")).where(F.col("arcsec") < 36000), 4)


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer")
def semi_flag(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return jn.member_flag(table(spark, folder, "customer").select("c_custkey"), "c_custkey", urgent, "urgent")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def key_set_filter(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return with_keys(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_ids(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("WITH f AS (SELECT o_custkey, min(o_orderkey) AS c_name, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1) SELECT c_custkey, customer.c_name, f.c_name AS c_name_r, top FROM customer LEFT JOIN f ON o_custkey = c_custkey")
def left_1to1(spark: SparkSession, folder: str) -> DataFrame:
    """A left join whose right side must not repeat a key; clashing names get a suffix."""
    first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("c_name"), F.round(F.max("o_totalprice"), 2).alias("top"))
    return jn.left_one_to_one(table(spark, folder, "customer").select("c_custkey", "c_name"), first, "c_custkey")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def two_left(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").where(F.col("n_nationkey") % 2 == 0)
    out = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dedupe_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    first = jn.first_row(table(spark, folder, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS a, CASE WHEN event_id % 4 = 1 THEN event_type END AS b FROM events)
SELECT user_id, round(arg_min(a, (ts, event_id)), 6) AS a, arg_min(b, (ts, event_id)) AS b FROM e GROUP BY 1""")
def first_non_null(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, folder, "events").withColumns({"a": F.when(e % 3 == 0, F.col("value")), "b": F.when(e % 4 == 1, F.col("event_type"))})
    return rounded(jn.first_present(rows, ["user_id"], [F.col("ts"), e], ["a", "b"]))


@query("""WITH p AS (SELECT user_id, event_type, event_id FROM events)
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'signup') THEN 'signup' ELSE arg_min(event_type, event_id) END AS label FROM p GROUP BY 1""")
def priority_label(spark: SparkSession, folder: str) -> DataFrame:
    return jn.priority_label(table(spark, folder, "events"), "user_id", "event_type", F.col("event_id"), ["purchase", "signup"])


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, folder, "orders").select("o_custkey").subtract(rich)


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, folder, "orders").select("o_custkey").intersect(rich)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, folder, "supplier").select("s_nationkey")).distinct()


_PTS = "pts AS (SELECT event_id AS id, user_id % 40 AS g, (user_id // 40) % 3000 AS strip, (user_id % 40) * 9.0::DOUBLE + value / 2000 AS ra, (user_id % 40) - 20.0::DOUBLE + ((user_id // 40) % 3000) * 0.02::DOUBLE AS dec FROM events)"


@query("WITH " + _PTS + " SELECT a.id, count(*) AS neighbours FROM pts a JOIN pts b ON a.g = b.g AND a.strip = b.strip AND " + haversine_sql("a", "b") + " <= 3.0 GROUP BY 1")
def eps_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours within three arc seconds, the point itself included."""
    pts = reach.vectors(_points(table(spark, folder, "events")), "ra", "dec")
    return reach.counts(pts, pts, 3.0, "id").withColumnRenamed("n", "neighbours")


def _points(events: DataFrame) -> DataFrame:
    """Events as positions: a strip of its own for each user, so that density doesn't grow with the number of users."""
    g, strip = F.col("user_id") % 40, F.floor(F.col("user_id") / 40) % 3000
    return events.select(F.col("event_id").alias("id"), (g * 9.0 + F.col("value") / 2000).alias("ra"), (g - 20.0 + strip * 0.02).alias("dec"))


_PAIRS = "pairs AS (SELECT a.id AS a, b.id AS b, " + haversine_sql("a", "b") + " AS d FROM pts a JOIN pts b ON a.g = b.g AND a.strip = b.strip WHERE " + haversine_sql("a", "b") + " <= {})"


@query("WITH RECURSIVE " + _PTS + ", " + _PAIRS.format("3.0") + """, core AS (SELECT a AS id FROM pairs GROUP BY 1 HAVING count(*) >= 3),
 links AS (SELECT a, b FROM pairs JOIN core x ON x.id = a JOIN core y ON y.id = b), t AS (SELECT id AS node, id AS root FROM core UNION SELECT b, root FROM t JOIN links ON a = node), named AS (SELECT node, min(root) AS cluster FROM t GROUP BY 1)
SELECT node AS id, cluster FROM named UNION ALL SELECT a AS id, min(cluster) AS cluster FROM pairs JOIN named ON node = b WHERE a NOT IN (SELECT id FROM core) GROUP BY 1""")
def dbscan(spark: SparkSession, folder: str) -> DataFrame:
    """Density clusters of all events on the sky."""
    return graph.dbscan(_points(table(spark, folder, "events")), 3.0, 3)


RADII, LEAST = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (2, 3, 5, 8)
_CORES = "cores AS (SELECT a AS id, least, list_sort(list(d))[least] AS core FROM pairs, (SELECT unnest([" + ", ".join(map(str, LEAST)) + "]) AS least) GROUP BY 1, 2 HAVING count(*) >= least)"
_GRID = "grid AS (SELECT unnest([" + ", ".join(map(str, LEAST)) + "]) AS least, radius FROM (SELECT unnest([" + ", ".join(f"{r}::DOUBLE" for r in RADII) + "]) AS radius))"


@query("WITH RECURSIVE " + _PTS + ", " + _PAIRS.format("6.0") + ", " + _CORES + ", " + _GRID + """, known AS (SELECT DISTINCT a AS id FROM pairs JOIN events ON event_id = b WHERE event_type = 'purchase' AND d <= 4.0),
 joins AS (SELECT a AS id, least, min(greatest(d, core)) AS since FROM pairs JOIN cores ON cores.id = b GROUP BY 1, 2), n AS (SELECT least, radius, count(*) AS n_points, count(known.id) AS n_matched FROM grid JOIN joins USING (least) LEFT JOIN known USING (id) WHERE since <= radius GROUP BY 1, 2),
 within AS (SELECT id, least, radius FROM cores JOIN grid USING (least) WHERE core <= radius), t AS (SELECT id AS node, id AS root, least, radius FROM within UNION SELECT b, root, t.least, t.radius FROM t JOIN pairs ON a = node AND d <= t.radius JOIN within w ON w.id = b AND w.least = t.least AND w.radius = t.radius),
 c AS (SELECT least, radius, count(DISTINCT cluster) AS n_clusters FROM (SELECT node, least, radius, min(root) AS cluster FROM t GROUP BY ALL) GROUP BY 1, 2), x AS (SELECT count(*) AS x FROM known)
SELECT least, radius, coalesce(n_clusters, 0) AS n_clusters, coalesce(n_points, 0) AS n_points, coalesce(n_matched, 0) AS n_matched, round(0.3::DOUBLE * (x - coalesce(n_matched, 0)) / x::DOUBLE + (n_points - n_matched) / n_points::DOUBLE, 6) AS loss FROM grid LEFT JOIN n USING (least, radius) LEFT JOIN c USING (least, radius), x""")
def clustering_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters, clustered points and loss for each radius and least number of points, off one forest for all of them."""
    events = table(spark, folder, "events")
    pts = _points(events)
    truth = pts.join(events.where("event_type = 'purchase'").select(F.col("event_id").alias("id")), "id", "left_semi")
    near = jn.within_radius(truth.select(F.col("id").alias("t"), "ra", "dec"), pts, 4.0, ("t", "ra", "dec"), ("id", "ra", "dec")).select("id").distinct()
    known = materialise(near, "matched")
    densities, forest = density.density_forest(pts, max(RADII), LEAST)
    return rounded(density.parameter_grid(densities, forest, known, known.count(), RADII))


@query("WITH RECURSIVE " + _PTS + ", " + _PAIRS.format("6.0") + """, cores AS (SELECT a AS id, list_sort(list(d))[4] AS core FROM pairs GROUP BY 1 HAVING count(*) >= 4), r AS (SELECT unnest([2.0::DOUBLE, 4.0::DOUBLE]) AS radius),
 within AS (SELECT id, radius FROM cores, r WHERE core <= radius), t AS (SELECT id AS node, id AS root, radius FROM within UNION SELECT b, root, t.radius FROM t JOIN pairs ON a = node AND d <= t.radius JOIN within w ON w.id = b AND w.radius = t.radius), named AS (SELECT node, radius, min(root) AS cluster FROM t GROUP BY 1, 2),
 joins AS (SELECT a AS id, arg_min(b, (greatest(d, core), b)) AS taker, min(greatest(d, core)) AS since FROM pairs JOIN cores ON cores.id = b GROUP BY 1)
SELECT radius, j.id, cluster FROM joins j JOIN r ON since <= radius LEFT JOIN cores c ON c.id = j.id JOIN named USING (radius) WHERE node = CASE WHEN core <= radius THEN j.id ELSE taker END""")
def density_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters at two radii, read off the same forest."""
    densities, forest = density.density_forest(_points(table(spark, folder, "events")), 6.0, [4])
    at = [density.clusters_at(densities, forest, r, 4).withColumn("radius", F.lit(r)) for r in (2.0, 4.0)]
    return at[0].unionByName(at[1]).select("radius", "id", "cluster")


@query("WITH p AS (" + sky_sql("part", "p_partkey") + ") SELECT p_partkey, round(sqrt((ra - 187.5::DOUBLE) * (ra - 187.5::DOUBLE) + (dec + 2.4::DOUBLE) * (dec + 2.4::DOUBLE)), 6) AS degrees FROM p WHERE ra BETWEEN 177.5 AND 197.5 AND dec BETWEEN -12.4 AND 7.6 AND sqrt((ra - 187.5::DOUBLE) * (ra - 187.5::DOUBLE) + (dec + 2.4::DOUBLE) * (dec + 2.4::DOUBLE)) < 10")
def box_and_cone(spark: SparkSession, folder: str) -> DataFrame:
    """A box that prunes and a planar cone within it."""
    from heliograph.functions import geo

    rows = positions(spark, folder, "part", "p_partkey").where(F.col("ra").between(177.5, 197.5) & F.col("dec").between(-12.4, 7.6))
    return rounded(rows.select("p_partkey", geo.planar_distance(F.col("ra"), F.col("dec"), F.lit(187.5), F.lit(-2.4)).alias("degrees")).where(F.col("degrees") < 10))


@query("WITH c AS (" + sky_sql("customer", "c_custkey") + ") SELECT c_custkey, round(" + haversine_sql("c", "d") + " / nullif(" + haversine_sql("e", "f") + ", 0), 4) AS ratio FROM c, LATERAL (SELECT c.ra AS ra, c.dec * 0.99::DOUBLE AS dec) d, LATERAL (SELECT c.dec AS ra, c.ra AS dec) e, LATERAL (SELECT c.dec * 0.99::DOUBLE AS ra, c.ra AS dec) f".replace("LATERAL ", "LATERAL "))
def swapped_angles(spark: SparkSession, folder: str) -> DataFrame:
    """How wrong a distance is whose right ascension and declination were swapped."""
    from heliograph.functions import geo

    ra, dec = F.col("ra"), F.col("dec")
    right, wrong = geo.haversine_arcsec(ra, dec, ra, dec * 0.99), geo.haversine_arcsec(dec, ra, dec * 0.99, ra)
    return rounded(positions(spark, folder, "customer", "c_custkey").select("c_custkey", F.try_divide(right, wrong).alias("ratio")), 4)


@query()
def pixel_halo(spark: SparkSession, folder: str) -> DataFrame:
    """Points of each pixel and those that its margin borrows; tests hold it against a search of all pixels."""
    halo = graph.with_halo(positions(spark, folder, "customer", "c_custkey"), 3600.0, 5, _ON("c_custkey"))
    return halo.groupBy("pixel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("owner").cast("long")).alias("owned"))


@query()
def dbscan_by_pixel(spark: SparkSession, folder: str) -> DataFrame:
    """The same clusters by pixels with margins; tests hold it against the clustering without pixels."""
    return graph.dbscan_by_pixel(_points(table(spark, folder, "events")), 3.0, 3, margin_arcsec=120.0)


@query("WITH c AS (" + sky_sql("customer", "c_custkey") + """), s AS (SELECT c_custkey, ra, dec, degrees(asin(greatest(-1.0, least(1.0, sin(radians(dec)) * sin(radians(27.12825::DOUBLE)) + cos(radians(dec)) * cos(radians(27.12825::DOUBLE)) * cos(radians(ra - 192.85948::DOUBLE)))))) AS b FROM c)
SELECT 'belt' AS region, c_custkey FROM s WHERE abs(b) <= 12 UNION ALL SELECT 'circle' AS region, c_custkey FROM s WHERE """ + haversine_sql("s", "(SELECT 266.4::DOUBLE AS ra, 66.5::DOUBLE AS dec)").replace("(SELECT 266.4::DOUBLE AS ra, 66.5::DOUBLE AS dec).ra", "266.4::DOUBLE").replace("(SELECT 266.4::DOUBLE AS ra, 66.5::DOUBLE AS dec).dec", "66.5::DOUBLE") + " <= 15 * 3600")
def region_members(spark: SparkSession, folder: str) -> DataFrame:
    """Positions in a belt and in a circle: first by pixels of the region's cover, an equi-join, then exactly."""
    from heliograph.functions import geo, healpix

    rows = positions(spark, folder, "customer", "c_custkey").withColumn("pixel", healpix.pixel(F.col("ra"), F.col("dec"), 5).cast("long"))
    belt = F.abs(geo.galactic_latitude(F.col("ra"), F.col("dec"))) <= 12
    circle = geo.haversine_arcsec(F.col("ra"), F.col("dec"), F.lit(266.4), F.lit(66.5)) <= 15 * 3600
    out = []
    for name, outside, exactly in (("belt", healpix.from_belt(12.0), belt), ("circle", healpix.from_circle(266.4, 66.5, 15.0), circle)):
        cover = healpix.tree_cover(spark, outside, [5]).select("pixel")
        out.append(rows.join(cover, "pixel", "left_semi").where(exactly).select(F.lit(name).alias("region"), "c_custkey"))
    return out[0].unionByName(out[1])
