"""Queries on catalog assembly: harmonising, flags, decoding, purity, packing, printing, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import catalog as ct
from heliograph.plans.adapters import rounded
from heliograph.plans.registry import query
from heliograph.sources.tables import partition_sizes, table
from heliograph.streaming.monitor import progress


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R' AND l_discount > 0.05")
def scan_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Three columns and predicates that reach the Parquet scan."""
    rows = table(spark, folder, "lineitem").where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05))
    return rows.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("l_extendedprice"))


@query("""SELECT 'c' AS catalog, 'C' || c_custkey AS source_id, CASE c_nationkey WHEN 0 THEN NULL ELSE c_mktsegment END AS type, round(c_acctbal, 2) AS period FROM customer
UNION ALL SELECT 's', 'S' || s_suppkey, 'SUPPLY', NULL FROM supplier""")
def harmonise_union(spark: SparkSession, folder: str) -> DataFrame:
    c = {"source_id": F.concat(F.lit("C"), F.col("c_custkey").cast("string")), "type": F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment")), "period": F.round("c_acctbal", 2)}
    s = {"source_id": F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), "type": F.lit("SUPPLY"), "period": F.lit(None).cast("double")}
    return ct.harmonise([(table(spark, folder, "customer"), "c", c), (table(spark, folder, "supplier"), "s", s)], ["source_id", "type", "period"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'passive' END AS label FROM events")
def value_map(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", ct.mapped(F.col("event_type"), {"click": "active", "purchase": "active", "view": "passive"}).alias("label"))


_PHOT = "WITH p AS (SELECT p_partkey, p_retailprice / 100 AS m1, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS m2, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size * 0.5::DOUBLE END AS m3, CAST(p_partkey % 3 AS INT) AS kind, p_partkey % 5 = 0 AS extra, CAST(p_partkey % 9 AS INT) AS tree FROM part)"


def _photometry(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        "p_partkey", (F.col("p_retailprice") / 100).alias("m1"), F.when(k % 3 != 0, F.col("p_size").cast("double")).alias("m2"), F.when(k % 2 != 0, F.col("p_size") * 0.5).alias("m3"),
        (k % 3).cast("int").alias("kind"), (k % 5 == 0).alias("extra"), (k % 9).cast("int").alias("tree"),
    )


@query(_PHOT + " SELECT p_partkey, round(m1 - m1, 6) AS m1, round(m2 - m1, 6) AS m2, round(m3 - m1, 6) AS m3 FROM p")
def colour_index(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ct.colours(_photometry(spark, folder), "m1", ["m2", "m3"]).select("p_partkey", "m1", "m2", "m3"))


@query(_PHOT + " SELECT p_partkey, CASE WHEN m2 IS NULL AND m3 IS NULL THEN CASE WHEN kind = 1 THEN 0 ELSE 1 END ELSE 0 END AS blended FROM p")
def blend_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _photometry(spark, folder).select("p_partkey", ct.blend_flag(F.col("kind"), [F.col("m2"), F.col("m3")]).alias("blended"))


@query(_PHOT + " SELECT p_partkey, CASE WHEN kind = 1 AND extra THEN 'sn' WHEN kind = 1 THEN 'cv' WHEN kind = 2 AND extra THEN 'agn' WHEN kind = 2 THEN coalesce(['ew','ea','cep','rr','lpv','rot','yso'][tree + 1], 'Unknown') ELSE 'Unknown' END AS type FROM p")
def classify_decode(spark: SparkSession, folder: str) -> DataFrame:
    return _photometry(spark, folder).select("p_partkey", ct.decoded(F.col("kind"), F.col("extra"), F.col("tree")).alias("type"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 7 = 0 AS INT) AS b, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size / 5.0::DOUBLE END AS snr, ['sn','cv','rot','ew'][p_partkey % 4 + 1] AS t, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0::DOUBLE END AS conf, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 50) / 20.0::DOUBLE END AS ps, p_retailprice / 100 AS m FROM part)
SELECT p_partkey FROM p WHERE NOT coalesce(b = 1, false) AND NOT coalesce(CASE WHEN t IN ('sn', 'cv') THEN snr < 4.25 ELSE snr < 4.75 END, false) AND NOT coalesce(conf < 0.8 AND snr < 8, false)
 AND NOT (t = 'rot' AND (coalesce(conf < 0.95, false) OR coalesce(ps < 1.1, false))) AND NOT coalesce(m > 15.5, false)""")
def purity(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        "p_partkey", (k % 7 == 0).cast("int").alias("b"), F.when(k % 11 != 0, F.col("p_size") / 5.0).alias("snr"), F.get(F.array(*[F.lit(x) for x in ("sn", "cv", "rot", "ew")]), (k % 4).cast("int")).alias("t"),
        F.when(k % 13 != 0, (k % 100) / 100.0).alias("conf"), F.when(k % 6 != 0, (k % 50) / 20.0).alias("ps"), (F.col("p_retailprice") / 100).alias("m"),
    )
    return rows.where(ct.pure(*(F.col(c) for c in ("b", "snr", "t", "conf", "ps", "m")))).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, ['ew','ea','cep','rr','lpv','rot'][p_partkey % 6 + 1] AS t, p_size / 4.0::DOUBLE AS d FROM part)
SELECT p_partkey, t FROM p WHERE (t = 'ew' AND d < 1.5) OR (t = 'ea' AND d > 0.5) OR (t = 'cep' AND d > 1 AND d < 75) OR (t = 'rr' AND d < 2) OR (t = 'lpv' AND d > 50) OR (t = 'rot' AND d < 10)""")
def sensible_labels(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, folder, "part").select("p_partkey", F.get(F.array(*[F.lit(x) for x in ("ew", "ea", "cep", "rr", "lpv", "rot")]), (k % 6).cast("int")).alias("t"), (F.col("p_size") / 4.0).alias("d"))
    return rows.where(ct.sensible(F.col("t"), F.col("d"))).select("p_partkey", "t")


_FINAL = "f AS (SELECT p_partkey AS id, (p_partkey * 137.50776405::DOUBLE) - 360 * floor((p_partkey * 137.50776405::DOUBLE) / 360) AS ra, (p_partkey % 120) - 60 + 0.125::DOUBLE AS dec, p_retailprice / 100 + 0.0013::DOUBLE AS m, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size / 8.0::DOUBLE END AS s, ['sn','cv','rot','ew'][p_partkey % 4 + 1] AS t FROM part)"


@query("WITH " + _FINAL + """ SELECT id AS cluster_id, round_even(ra, 5) AS RAJ2000, round_even(dec, 4) AS DecJ2000, round_even(m, 2) AS W1mag, round_even(m + 0.5, 2) AS W2mag, round_even(s, 2) AS W3mag, round_even(s * 3, 3) AS variability_snr, round_even(s / 7, 7) AS period_peak_1,
 CASE WHEN t IN ('sn', 'cv') THEN NULL ELSE round_even(s / 3, 3) END AS period_significance, round_even(s / 10, 4) AS confidence, t AS type FROM f WHERE NOT coalesce(round_even(m, 2) < 7.5, false)""")
def final_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The final catalog's projection, rounding and saturation cut over made-up photometry of all parts."""
    shown = ["cluster_id", "RAJ2000", "DecJ2000", "W1mag", "W2mag", "W3mag", "variability_snr", "period_peak_1", "period_significance", "confidence", "type"]
    return ct.final_catalog(table(spark, folder, "part"), _final_names()).select(*shown)


def _final_names() -> dict[str, Column]:
    k, m = F.col("p_partkey"), F.col("p_retailprice") / 100 + 0.0013
    s = F.when(k % 3 != 0, F.col("p_size") / 8.0)
    kind = F.get(F.array(*[F.lit(x) for x in ("sn", "cv", "rot", "ew")]), (k % 4).cast("int"))
    names = {"id": k, "ra": F.pmod(k * F.lit(137.50776405), F.lit(360.0)), "dec": k % 120 - 60 + F.lit(0.125), "mag1": m, "mag2": m + 0.5, "mag3": s, "mag4": s, "j": m, "h": m, "k": m, "amp1": s, "amp2": s, "snr": s * 3}
    names |= {"peak1": s / 7, "peak2": s / 9, "peak3": s / 11, "significance": s / 3, "blended": (k % 2).cast("int"), "score": s / 10, "type": kind}
    return names


_NAMED = """(SELECT *, 'J' || lpad(CAST((a // 360000) % 24 AS VARCHAR), 2, '0') || lpad(CAST((a // 6000) % 60 AS VARCHAR), 2, '0') || lpad(CAST((a // 100) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 100 AS VARCHAR), 2, '0')
 || CASE WHEN dec < 0 THEN '-' ELSE '+' END || lpad(CAST(d // 36000 AS VARCHAR), 2, '0') || lpad(CAST((d // 600) % 60 AS VARCHAR), 2, '0') || lpad(CAST((d // 10) % 60 AS VARCHAR), 2, '0') || '.' || CAST(d % 10 AS VARCHAR) AS name
 FROM (SELECT *, CAST(round(ra / 15 * 360000) AS BIGINT) AS a, CAST(floor(abs(dec) * 36000 + 1e-6) AS BIGINT) AS d FROM f))"""


@query("WITH " + _FINAL + f""" SELECT id AS cluster_id, name AS "Designation", round_even(ra, 5) AS "RAJ2000", round_even(dec, 4) AS "DecJ2000", round_even(m, 2) AS "W1mag", round_even(m + 0.5, 2) AS "W2mag", round_even(s, 2) AS "W3mag", round_even(s + 0.25, 2) AS "W4mag", round_even(m + 0.11, 2) AS "Jmag", round_even(m + 0.22, 2) AS "Hmag",
 round_even(m - 0.33, 2) AS "Kmag", round_even(s / 6, 2) AS "W1_amp", round_even(s / 13, 2) AS "W2_amp", round_even(s * 3, 3) AS variability_snr, round_even(s / 7, 7) AS period_peak_1, round_even(s / 9, 7) AS period_peak_2, round_even(s / 11, 7) AS period_peak_3,
 CASE WHEN t IN ('sn', 'cv') THEN NULL ELSE round_even(s / 3, 3) END AS period_significance, CAST(id % 2 AS INT) AS blended, round_even(s / 10, 4) AS confidence, t AS type FROM {_NAMED} WHERE NOT coalesce(round_even(m, 2) < 7.5, false)""")
def final_columns(spark: SparkSession, folder: str) -> DataFrame:
    """All twenty-one columns of the final catalog."""
    names = _final_names()
    m, s = names["mag1"], names["mag3"]
    names |= {"mag4": s + 0.25, "j": m + 0.11, "h": m + 0.22, "k": m - 0.33, "amp1": s / 6, "amp2": s / 13}
    return ct.final_catalog(table(spark, folder, "part"), names)


@query("""WITH p AS (SELECT *, p_partkey % 13 AS i, (p_partkey % 3600) / 10.0::DOUBLE AS ra, (p_partkey % 170) - 85.0::DOUBLE AS dec, ['chen-neowise','chen-ztf','petrosky','gaia-cepheids','gaia-ebs','gaia-lpvs','gaia-oscillators','gaia-rotators','gaia-rrlyrae','gaia-sts','spicy','assef-agn','gaia-general'][p_partkey % 13 + 1] AS catalog FROM part)
SELECT catalog, CAST(p_partkey AS VARCHAR) AS source_id, ra, dec, CASE WHEN i IN (10, 11, 12) THEN NULL ELSE CAST(p_size AS DOUBLE) END AS period,
 CASE i WHEN 2 THEN 'EB' WHEN 4 THEN 'EB' WHEN 6 THEN 'oscillator' WHEN 7 THEN 'rotator' WHEN 9 THEN 'short-timescale' WHEN 11 THEN 'agn' ELSE p_brand END AS type FROM p WHERE NOT (i = 2 AND p_partkey % 2 = 0) AND NOT (i = 12 AND (p_size % 10) / 10.0::DOUBLE <= 0.5)""")
def harmonised_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """Thirteen catalogs with columns of their own, cut from the parts, brought together by their rules."""
    k = F.col("p_partkey")
    base = table(spark, folder, "part").withColumns({"ra_": (k % 3600) / 10.0, "dec_": k % 170 - F.lit(85.0)})
    raw = {}
    for i, rule in enumerate(ct.RULES):
        columns = {rule.id: k, rule.ra: F.col("ra_"), rule.dec: F.col("dec_")}
        if rule.period:
            columns[rule.period] = F.col("p_size")
        if rule.type:
            columns[rule.type] = (k % 2).cast("int") if rule.types else F.col("p_brand")
        if rule.least_score:
            columns[rule.least_score[0]] = (F.col("p_size") % 10) / 10.0
        raw[rule.name] = base.where(k % 13 == i).select(*[v.alias(n) for n, v in columns.items()])
    return ct.harmonise_catalogs(raw)


@query("""WITH p AS (SELECT p_partkey, ['ew','yso','cep','yso'][p_partkey % 4 + 1] AS t, p_size / 4.0::DOUBLE AS d, p_retailprice / 100 AS a, p_size * 0.4::DOUBLE AS b, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 0.3::DOUBLE END AS c FROM part)
SELECT p_partkey, t FROM p WHERE (t = 'ew' AND d < 1.5) OR (t = 'cep' AND d > 1 AND d < 75) OR (t = 'yso' AND (a - b > -1 OR coalesce(a - c > 0, false)))""")
def sensible_colours(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with plausible periods, and young stars that aren't too blue."""
    k = F.col("p_partkey")
    mags = (F.col("p_retailprice") / 100, F.col("p_size") * 0.4, F.when(k % 3 != 0, F.col("p_size") * 0.3))
    rows = table(spark, folder, "part").withColumn("t", F.get(F.array(*[F.lit(x) for x in ("ew", "yso", "cep", "yso")]), (k % 4).cast("int")))
    return rows.where(ct.sensible(F.col("t"), F.col("p_size") / 4.0, mags)).select("p_partkey", "t")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def topk_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)


@query("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS rows FROM lineitem GROUP BY 1")
def partition_rows(spark: SparkSession, folder: str) -> DataFrame:
    return partition_sizes(table(spark, folder, "lineitem"), "l_suppkey", "l_linenumber")


@query("WITH s AS (SELECT *, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - length(text) AS b FROM documents) SELECT doc_id, source, CAST(floor(b / 20000) AS BIGINT) AS file FROM s")
def size_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive rows packed into files of bounded size by a running sum."""
    return ct.packed(table(spark, folder, "documents"), ["source"], ["doc_id"], F.char_length("text"), 20000).select("doc_id", "source", "file")


@query("SELECT event_id, user_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 5 = 0")
def every_kth(spark: SparkSession, folder: str) -> DataFrame:
    return ct.every_kth(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id")


@query("SELECT n_nationkey, rpad(n_name, CAST((SELECT greatest(max(length(n_name)), 6) FROM nation) AS INT), ' ') || ' | ' || rpad(CAST(n_regionkey AS VARCHAR), CAST((SELECT greatest(max(length(CAST(n_regionkey AS VARCHAR))), 11) FROM nation) AS INT), ' ') AS line FROM nation")
def pretty_table(spark: SparkSession, folder: str) -> DataFrame:
    return ct.pretty_lines(table(spark, folder, "nation"), ["n_name", "n_regionkey"], "n_nationkey")


@query("WITH p AS (SELECT sum(l_linenumber) AS done, sum(l_quantity) AS seconds FROM lineitem) SELECT CAST(done AS BIGINT) AS done, round(done / 1000000.0, 6) AS share, round(done / seconds, 6) AS rate, round((1000000 - done) / (done / seconds), 4) AS seconds_left FROM p")
def progress_rate(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("rows"), F.col("l_quantity").alias("seconds"))
    return progress(log, 1_000_000).select("done", F.round("share", 6).alias("share"), F.round("rate", 6).alias("rate"), F.round("seconds_left", 4).alias("seconds_left"))
