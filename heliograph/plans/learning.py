"""Queries on models that are trained or applied here: boosted trees, networks, spectra and shapes of phase bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import arrays
from heliograph.operators import boosting, network, periods, training
from heliograph.operators.catalog import TREE_CLASSES
from heliograph.operators.lightcurve import nest, parallel
from heliograph.plans.adapters import LC, lc_sql, light_curves, rounded
from heliograph.plans.registry import query
from heliograph.sources.scratch import discard, materialise, scratch_path
from heliograph.sources.tables import table


@query()
def boosted_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Seven classes by boosted trees fitted on vectors of even ids, applied to all; a named probability for each class."""
    names = [f"f{k}" for k in range(16)]
    kind = F.get(F.array(*[F.lit(c) for c in TREE_CLASSES]), F.col("label") % len(TREE_CLASSES))
    rows = table(spark, folder, "embeddings").select("vec_id", kind.alias("kind"), *[F.get("embedding", k).cast("double").alias(f"f{k}") for k in range(16)])
    model = boosting.fit_boosted(rows.where("vec_id % 2 = 0"), names, "kind", TREE_CLASSES, rounds=4)
    return rounded(boosting.best_per_source(boosting.apply_boosted(rows, model), "vec_id").drop(*names))


def curve_arrays(spark: SparkSession, folder: str) -> DataFrame:
    rows = light_curves(spark, folder).withColumns({"flux": F.asinh(F.col("flux") / 1000), "sig": F.asinh(F.col("sig") / 1000), "mjd": F.col("mjd") / 4000})
    return parallel(nest(rows, LC, ["flux", "sig"]), "source_id", ["flux", "sig", "mjd"])


@query()
def network_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three scores for every supplier's curve by convolutions, a wavelet and a Fourier layer; tests hold the layers against loops."""
    scored = network.network_scores(curve_arrays(spark, folder), "source_id", ["flux", "sig", "mjd"], network.wave_network(), 3)
    p = arrays.softmax(F.col("scores"))
    return rounded(scored.withColumn("p", p).select("source_id", arrays.argmax(F.col("p")).alias("class"), F.array_max("p").alias("confidence")))


@query("WITH " + lc_sql() + """, o AS (SELECT source_id, flux / 1000 AS flux, row_number() OVER (PARTITION BY source_id ORDER BY mjd, t1, t2, t3, flux) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM lc), f AS (SELECT k, k / 7::DOUBLE AS f FROM range(8) r(k)),
 a AS (SELECT source_id, k, -2 * pi() * f * (n - 1) / n * i AS angle, flux, n FROM o, f) SELECT source_id, CAST(k AS INT) AS k, round(sqrt(sum(flux * cos(angle)) ** 2 + sum(flux * sin(angle)) ** 2) / sqrt(max(n)), 5) AS amplitude FROM a GROUP BY 1, 2""")
def finite_fourier(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of eight Fourier coefficients of each curve in order of time, by the network's Fourier layer."""
    curves = parallel(nest(light_curves(spark, folder).withColumn("flux", F.col("flux") / 1000), LC, ["flux"]), "source_id", ["flux"])
    spectra = network.network_scores(curves, "source_id", ["flux"], [("fourier", np.linspace(0, 1, 8)), ("flatten",)], 8)
    return rounded(spectra.select("source_id", F.posexplode("scores").alias("k", "amplitude")), 5)


@query()
def trained_classes(spark: SparkSession, folder: str) -> DataFrame:
    """A network of one hidden layer trained by summed gradients on four fifths of the vectors, by hash; tests hold the weights against numpy."""
    rows = table(spark, folder, "embeddings")
    known = materialise(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(5)) > 0).select("embedding", "label"), "training")
    state, kept = training.train(known, "embedding", "label", list(range(10)), 12, 12, folder=scratch_path(spark, "checkpoints"), least_f1=0.1)
    discard(known)
    last = training.load_checkpoint(spark, kept[-1]) if kept else state
    return rounded(training.predict(rows, "vec_id", "embedding", last, [str(k) for k in range(10)], 12), 4)


_SHAPE = "WITH " + lc_sql() + """, p AS (SELECT *, ((mjd - 23.3713::DOUBLE * floor(mjd / 23.3713::DOUBLE)) / 23.3713::DOUBLE) * 64 AS p FROM lc), i AS (SELECT unnest(range(64)) AS bin),
 f AS (SELECT source_id, bin, median(flux) AS m FROM p JOIN i ON p >= bin - 0.25::DOUBLE AND p < bin + 1.25::DOUBLE GROUP BY 1, 2 HAVING count(*) >= 2),
 w AS (SELECT s.source_id, i.bin, coalesce(m, 0) AS m FROM (SELECT DISTINCT source_id FROM lc) s CROSS JOIN i LEFT JOIN f ON f.source_id = s.source_id AND f.bin = i.bin), g AS (SELECT source_id, bin, (m - min(m) OVER o) / nullif(max(m) OVER o - min(m) OVER o, 0) AS level FROM w WINDOW o AS (PARTITION BY source_id))"""


def _shapes(spark: SparkSession, folder: str) -> DataFrame:
    return periods.phase_shape(light_curves(spark, folder).withColumn("period", F.lit(23.3713)), LC, "period", 64, 0.25).select("source_id", "level")


@query(_SHAPE + " SELECT source_id, CAST(k AS INT) AS k, round(sqrt(sum(level * cos(-2 * pi() * k * bin / 64)) ** 2 + sum(level * sin(-2 * pi() * k * bin / 64)) ** 2) / 8, 6) AS amplitude FROM g, range(8) r(k) GROUP BY 1, 2")
def phase_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """Fourier amplitudes of the 64 scaled medians over the phase, as column expressions."""
    spectra = F.array(*[arrays.fourier_amplitude(F.col("level"), k) for k in range(8)])
    return rounded(_shapes(spark, folder).select("source_id", F.posexplode(spectra).alias("k", "amplitude")))


@query()
def morphology(spark: SparkSession, folder: str) -> DataFrame:
    """Four numbers for the shape of each supplier's phase bins, by an encoder fitted on the shapes of even suppliers, and its error."""
    shapes = materialise(_shapes(spark, folder), "shapes")
    mean, directions = training.low_rank(shapes.where("source_id % 2 = 0"), "level", 4)
    coded = training.encode(shapes, "level", mean, directions)
    return rounded(coded.select("source_id", *[F.get("code", k).alias(f"code_{k}") for k in range(4)], F.col("code_error").alias("error")), 4)
