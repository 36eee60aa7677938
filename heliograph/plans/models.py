"""Queries on evaluation, splits, small models and synthetic light curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import evaluation as ev
from heliograph.operators import features as ft
from heliograph.operators import synthetic
from heliograph.operators.lightcurve import Curve, dealt
from heliograph.plans.adapters import rounded
from heliograph.plans.registry import query
from heliograph.sources.tables import table

_M = "WITH m AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2)"
_S = _M + """, t AS (SELECT truth AS label, sum(n) AS support, coalesce(sum(n) FILTER (WHERE truth = predicted), 0) AS hits FROM m GROUP BY 1), g AS (SELECT predicted AS label, sum(n) AS guesses FROM m GROUP BY 1),
 b AS (SELECT coalesce(t.label, g.label) AS label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(guesses, 0) AS guesses FROM t FULL JOIN g ON t.label = g.label),
 p AS (SELECT label, support, coalesce(hits / nullif(guesses, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM b),
 f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p)"""


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return ev.confusion(table(spark, folder, "labels"), "quality", "toxic")


@query(_M + " SELECT * FROM m")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _matrix(spark, folder)


@query(_S + " SELECT label, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.class_scores(_matrix(spark, folder)))


@query(_S + " SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.summary_scores(_matrix(spark, folder)))


@query("""WITH i AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY (doc_id * 7919) % 104729, doc_id) AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, CASE WHEN i <= floor(n * 0.8::DOUBLE + 1e-9) THEN 'train' WHEN i <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE) + 1e-9) THEN 'valid' ELSE 'test' END AS split FROM i""")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    order = [(F.col("doc_id") * 7919) % 104729, F.col("doc_id")]
    return ev.stratified_split(table(spark, folder, "labels"), "toxic", order, [("train", 0.8), ("valid", 0.1), ("test", 0.1)]).select("doc_id", "split")


@query("SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 104729, vec_id) <= 20")
def per_class_sample(spark: SparkSession, folder: str) -> DataFrame:
    return ev.per_class_sample(table(spark, folder, "embeddings"), "label", 20, [(F.col("vec_id") * 7919) % 104729, F.col("vec_id")]).select("vec_id", "label")


@query()
def group_split(spark: SparkSession, folder: str) -> DataFrame:
    """Hash split by group; tests check shares and that groups stay whole. DuckDB has no such hash."""
    return ev.group_split(table(spark, folder, "events").select("event_id", "user_id"), "user_id", [("train", 0.7), ("valid", 0.15), ("test", 0.15)])


@query()
def kmeans2_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Two means per supplier by rounds of aggregation; tests hold it against numpy."""
    rows = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(ev.two_means(rows, "l_suppkey", "x", "y"), 4)


@query("""WITH i AS (SELECT unnest(range(64)) AS i), e AS (SELECT vec_id, c, sum(embedding[i + 1]::DOUBLE * cos(3 * i + c)) AS z FROM embeddings, i, (SELECT unnest([0, 1, 2]) AS c) GROUP BY 1, 2),
 m AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM e)
SELECT vec_id, CAST(arg_max(c, (z, -c)) AS INT) AS class, round(1 / sum(exp(z - top)), 6) AS confidence FROM m GROUP BY 1""")
def score_hook(spark: SparkSession, folder: str) -> DataFrame:
    """A model given as a function and broadcast weights, over all vectors."""
    weights = np.cos(np.arange(64 * 3)).reshape(64, 3)
    scored = ev.score(table(spark, folder, "embeddings").select("vec_id", "embedding"), ev.linear_softmax, "vec_id long, class int, confidence double", (weights, np.zeros(3)))
    return rounded(scored)


@query()
def tree_classify(spark: SparkSession, folder: str) -> DataFrame:
    """A forest fitted on labelled vectors of even ids, applied to all of them."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", *[F.get("embedding", k).cast("double").alias(f"f{k}") for k in range(16)])
    features = [f"f{k}" for k in range(16)]
    model = ev.fit_trees(rows.where(F.col("vec_id") % 2 == 0), features, "label")
    return rounded(ev.apply_trees(rows, model, features).select("vec_id", "label", "tree_prediction", "tree_score"))


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Keys in parts of a few thousand, since each becomes a whole curve."""
    return dealt(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source_id")), "source_id", 2_000)


@query()
def synthetic_features(spark: SparkSession, folder: str) -> DataFrame:
    """Synthetic light curves for every supplier, and their variability statistics beside the known class."""
    keys = _suppliers(spark, folder)
    curves = synthetic.light_curves(keys, "source_id").withColumn("chi", F.lit(1.0))
    c = Curve(ties=("flux",))
    known = curves.groupBy("source_id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"), F.min("period").alias("period"))
    return rounded(ft.von_neumann(curves, c).join(ft.spreads(curves, c).select("source_id", "i90r").hint("merge"), "source_id").join(known.hint("merge"), "source_id"), 4)


@query()
def synthetic_augmented(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse nulls, noise, outliers and missing visits for every supplier's curve; tests check each against its rule."""
    keys = _suppliers(spark, folder)
    rows = synthetic.augmented(synthetic.sparse_nulls(synthetic.light_curves(keys, "source_id"), "source_id"), "source_id")
    return rounded(rows.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outlier").cast("long")).alias("outliers"), F.median("flux").alias("median_flux"), F.max("mjd").alias("span")), 4)


@query()
def synthetic_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """A burst and a pulse of random shape for every supplier: points, attempts taken, range; tests hold them against their rules."""
    keys = _suppliers(spark, folder)
    common = [F.count(F.lit(1)).alias("n"), F.median("flux").alias("median_flux"), (F.max("flux") - F.min("flux")).alias("range")]
    bursts = synthetic.bursts(keys, "source_id").groupBy("source_id").agg(*common, F.min("attempt").alias("attempt")).withColumn("kind", F.lit("burst"))
    pulses = synthetic.pulses(keys, "source_id").groupBy("source_id").agg(*common, F.lit(0).alias("attempt")).withColumn("kind", F.lit("pulse"))
    return rounded(bursts.unionByName(pulses), 4)


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_x, round(avg(l_discount), 6) AS mean_y, round(var_pop(l_quantity), 6) AS var_x, round(var_pop(l_discount), 6) AS var_y, round(covar_pop(l_quantity, l_discount), 6) AS cov_xy FROM lineitem GROUP BY 1")
def gaussian_fit(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.gaussian_fit(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity", "l_discount"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 9) GROUP BY 1, 2)
SELECT user_id, arg_min(event_type, (-n, event_type)) AS label, max(n) AS votes FROM c GROUP BY 1""")
def recent_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest of each key's last nine labels; the smallest of equal ones."""
    last = ev.per_class_sample(table(spark, folder, "events"), "user_id", 9, [F.col("ts").desc(), F.col("event_id").desc()])
    counts = last.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("label"), (-F.col("b.m")).alias("votes"))


@query()
def mixture_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Two normal components against one, per supplier; tests hold it against numpy."""
    return rounded(ft.mixture_ratio(table(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice"), 4)


@query()
def threshold_split(spark: SparkSession, folder: str) -> DataFrame:
    """A tree of depth one that finds the threshold of one feature; tests check what it separates."""
    rows = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("price"), (F.col("l_quantity") > 25).cast("double").alias("large"))
    cut = ev.threshold(rows, "price", "large")
    return rows.groupBy("large").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("price") > cut).cast("long")).alias("above")).withColumn("threshold", F.round(F.lit(cut), 4))
