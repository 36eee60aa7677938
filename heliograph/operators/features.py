"""Variability features of light curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.lightcurve import Curve, moment_parts
from heliograph.operators.periods import significance
from heliograph.sources.scratch import discard, materialise


#: Rows with helper columns, and aggregates over them by source: parts that share one shuffle.
Part = tuple[DataFrame, list[Column]]


def _von_neumann(df: DataFrame, c: Curve) -> Part:
    rows = df.withColumns({"_step": F.col(c.flux) - F.lag(c.flux).over(c.ordered())})
    n = F.count(F.lit(1))
    return rows, [F.try_divide((n - 1) * F.var_pop(c.flux) * n, n * F.sum(F.col("_step") * F.col("_step"))).alias("inv_von_neumann")]


def von_neumann(df: DataFrame, c: Curve) -> DataFrame:
    """Inverse von Neumann ratio: (n - 1) sum (x - mean)^2 over n sum of squared steps."""
    rows, found = _von_neumann(df, c)
    return rows.groupBy(c.key).agg(F.count(F.lit(1)).alias("n"), *found)


def _stetson(df: DataFrame, c: Curve) -> Part:
    own = c.whole()
    n = F.count(F.lit(1)).over(own)
    rows = df.withColumn("_d", F.sqrt(F.try_divide(n, n - 1)) * F.try_divide(F.col(c.flux) - F.avg(c.flux).over(own), F.col(c.sigma)))
    rows = rows.withColumn("_p", F.col("_d") * F.lead("_d").over(c.ordered()))
    m = F.count("_p")
    return rows, [
        (F.sqrt(F.try_divide(F.lit(1.0), F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))) * F.sum("_p")).alias("stetson_i"),
        F.try_divide(F.sum(F.signum("_p") * F.sqrt(F.abs("_p"))), m).alias("stetson_j"),
        F.try_divide(F.avg(F.abs("_d")), F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("stetson_k"),
    ]


def stetson(df: DataFrame, c: Curve) -> DataFrame:
    """Stetson I, J and K from residuals sqrt(n / (n - 1)) (x - mean) / error and products of neighbours."""
    rows, found = _stetson(df, c)
    return rows.groupBy(c.key).agg(*found)


def spreads(df: DataFrame, c: Curve) -> DataFrame:
    """Interquantile ranges, median deviation, chi and error statistics.

    Both sides of the join are shuffled: either may be far larger than Spark's estimate, so none is broadcast.
    """
    levels = [0.1, 0.25, 0.4, 0.6, 0.75, 0.9]  # of one sorted table of values, not a table for each
    rows = df.join(df.groupBy(c.key).agg(F.median(c.flux).alias("_m"), F.median(c.sigma).alias("_s")).hint("merge"), c.key)
    stats = rows.groupBy(c.key).agg(
        F.percentile(c.flux, F.array(*[F.lit(p) for p in levels])).alias("_q"), F.median(F.abs(F.col(c.flux) - F.col("_m"))).alias("mad"),
        F.avg(c.chi).alias("mean_chi"), F.stddev_pop(c.chi).alias("std_chi"), F.max("_s").alias("median_sigma"), F.median(F.abs(F.col(c.sigma) - F.col("_s"))).alias("mad_sigma"),
    )
    q = lambda p: F.get("_q", levels.index(p))
    return stats.select(
        c.key, (q(0.6) - q(0.4)).alias("i60r"), (q(0.75) - q(0.25)).alias("i75r"), (q(0.9) - q(0.1)).alias("i90r"), "mad", "mean_chi", "std_chi", "median_sigma", "mad_sigma",
        F.try_divide(q(0.75) - q(0.25), F.col("median_sigma")).alias("iqr_over_sigma"),
    )


def _beside(df: DataFrame, c: Curve, chi2: bool) -> DataFrame:
    """Moments, von Neumann ratio, Stetson indices and, with ``chi2``, the distance from a normal distribution: one shuffle, one aggregation."""
    rows, ratio = _von_neumann(df, c)
    rows, indices = _stetson(rows, c)
    rows, distance = _gaussian_chi2(rows, c) if chi2 else (rows, [])
    raw, finished = moment_parts(c.flux)
    sums = rows.groupBy(c.key).agg(*raw, *ratio, *indices, *distance)
    return sums.select(c.key, *finished, "inv_von_neumann", "stetson_i", "stetson_j", "stetson_k", *(["gaussian_chi2"] if chi2 else []))


def feature_table(df: DataFrame, c: Curve, chi2: bool = False) -> DataFrame:
    """All statistics of a source side by side, keyed by the source; those that need no medians share a shuffle."""
    return spreads(df, c).join(_beside(df, c, chi2).hint("merge"), c.key)


def full_features(df: DataFrame, c: Curve, period: str, others: Sequence[DataFrame] = ()) -> DataFrame:
    """All seventeen statistics of a source in one row, with the columns of ``others`` (one row for each key) beside them.

    ``period`` is a column that is constant within a source. A source that ``others`` lack keeps its row, with nulls.
    """
    out = feature_table(df, c, True).join(significance(df, c, period), c.key)
    for other in others:
        out = out.join(other, c.key, "left")
    return out


# A published rational approximation of the normal integral, exact to some 1e-15, by falling powers.
NORMAL_TOP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
NORMAL_BOTTOM = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def normal_cdf(z: Column) -> Column:
    """The normal distribution's integral; null for null and NaN."""
    x = F.abs(z)

    def polynomial(factors: list[float]) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * x + f
        return out

    fraction = x + 0.65
    for k in (4, 3, 2, 1):
        fraction = x + k / fraction
    tail = F.exp(-x * x / 2) * F.when(x < 7.07106781186547, polynomial(NORMAL_TOP) / polynomial(NORMAL_BOTTOM)).otherwise(1 / (fraction * 2.506628274631))
    return F.when(~F.isnan(z), F.when(z > 0, 1 - tail).otherwise(tail))


def _gaussian_chi2(df: DataFrame, c: Curve) -> Part:
    own = c.whole()
    n = F.count(F.lit(1)).over(own)
    rank = F.row_number().over(Window.partitionBy(c.key).orderBy(c.flux, *c.ties))
    z = F.try_divide(F.col(c.flux) - F.avg(c.flux).over(own), F.stddev_pop(c.flux).over(own))
    rows = df.withColumns({"_empirical": rank / n, "_z": z}).withColumn("_expected", normal_cdf(F.col("_z")))
    away = F.col("_empirical") - F.col("_expected")
    return rows, [F.sum(F.try_divide(away * away, F.col("_expected"))).alias("gaussian_chi2")]


def gaussian_chi2(df: DataFrame, c: Curve) -> DataFrame:
    """Squared differences between a source's empirical distribution and a normal one, over the normal one, summed."""
    rows, found = _gaussian_chi2(df, c)
    return rows.groupBy(c.key).agg(*found)


def band_choice(df: DataFrame, c: Curve, second: tuple[str, str]) -> DataFrame:
    """The band of better mean signal-to-noise per source, as flux and sigma columns of the curve's names."""
    flux, sigma = second
    own = c.whole()
    first = F.coalesce(F.avg(F.try_divide(F.col(c.flux), F.col(c.sigma))).over(own), F.lit(0.0))
    other = F.coalesce(F.avg(F.try_divide(F.col(flux), F.col(sigma))).over(own), F.lit(0.0))
    rows = df.withColumn("_second", other > first)
    return rows.withColumns({c.flux: F.when(F.col("_second"), F.col(flux)).otherwise(F.col(c.flux)), c.sigma: F.when(F.col("_second"), F.col(sigma)).otherwise(F.col(c.sigma))}).drop("_second")


def robust(df: DataFrame, c: Curve) -> DataFrame:
    """Median deviation over the median error, median skew, and interquantile ranges over the median error."""
    q = lambda p: F.percentile(c.flux, F.lit(p))
    rows = df.join(df.groupBy(c.key).agg(F.median(c.flux).alias("_m"), F.median(c.sigma).alias("_s")).hint("merge"), c.key)
    s = F.max("_s")
    return rows.groupBy(c.key).agg(
        F.try_divide(F.median(F.abs(F.col(c.flux) - F.col("_m"))), s).alias("mad_over_noise"), F.try_divide(F.avg(c.flux) - F.max("_m"), F.stddev_pop(c.flux)).alias("median_skew"),
        F.try_divide(q(0.6) - q(0.4), s).alias("i60r"), F.try_divide(q(0.75) - q(0.25), s).alias("iqr"), F.try_divide(q(0.85) - q(0.15), s).alias("i85r"),
    )


def gaussian_fit(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Mean and covariance of two columns per key."""
    return df.groupBy(key).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_pop(x).alias("var_x"), F.var_pop(y).alias("var_y"), F.covar_pop(x, y).alias("cov_xy"))


def mixture_ratio(df: DataFrame, key: str, value: str, rounds: int = 12, tolerance: float = 1e-4) -> DataFrame:
    """Mean log-likelihood of two normal components less that of one, per key.

    Expectation-maximisation by rounds of aggregation: a key's rows never meet in one task. Rounds are written, and end
    when no key's means move by more than ``tolerance`` of its deviation, or after ``rounds``.
    """
    rows = df.select(key, F.col(value).alias("v")).where(F.col(value).isNotNull())
    base = rows.groupBy(key).agg(F.avg("v").alias("m"), F.greatest(F.var_pop("v"), F.lit(1e-12)).alias("s"), F.percentile("v", F.lit(0.25)).alias("a"), F.percentile("v", F.lit(0.75)).alias("b"))
    state = base.withColumns({"sa": F.col("s"), "sb": F.col("s"), "wa": F.lit(0.5)})
    density = lambda m, s: F.exp(-(F.col("v") - m) * (F.col("v") - m) / (2 * s)) / F.sqrt(2 * math.pi * s)
    both = lambda: (F.col("wa") * density(F.col("a"), F.col("sa")), (1 - F.col("wa")) * density(F.col("b"), F.col("sb")))
    state = materialise(state, "mixture")
    for _ in range(rounds):
        pa, pb = both()
        r = rows.join(state, key).withColumn("r", F.coalesce(F.try_divide(pa, pa + pb), F.lit(0.5)))
        v, w = F.col("v"), F.col("r")
        sums = r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("na"), F.sum(w * v).alias("xa"), F.sum(w * v * v).alias("xxa"), F.sum(v).alias("x"), F.sum(v * v).alias("xx"), F.max("m").alias("m"), F.max("s").alias("s"), F.max("a").alias("_a"), F.max("b").alias("_b"))
        nb = F.col("n") - F.col("na")
        mean_a, mean_b = F.col("xa") / F.greatest("na", F.lit(1e-9)), (F.col("x") - F.col("xa")) / F.greatest(nb, F.lit(1e-9))
        floor = F.col("s") * 1e-3
        moved = sums.select(
            key, "m", "s", "_a", "_b", mean_a.alias("a"), mean_b.alias("b"), F.greatest(F.col("xxa") / F.greatest("na", F.lit(1e-9)) - mean_a * mean_a, floor).alias("sa"),
            F.greatest((F.col("xx") - F.col("xxa")) / F.greatest(nb, F.lit(1e-9)) - mean_b * mean_b, floor).alias("sb"), (F.col("na") / F.col("n")).alias("wa"),
        )
        moved = materialise(moved, "mixture")
        discard(state)
        state = moved.drop("_a", "_b")
        state._scratch = moved._scratch
        if moved.where(F.greatest(F.abs(F.col("a") - F.col("_a")), F.abs(F.col("b") - F.col("_b"))) > tolerance * F.sqrt("s")).isEmpty():
            break
    pa, pb = both()
    return rows.join(state, key).groupBy(key).agg((F.avg(F.log(F.greatest(pa + pb, F.lit(1e-300)))) - F.avg(F.log(density(F.col("m"), F.col("s"))))).alias("ratio"))


def uneven_fourier(df: DataFrame, c: Curve, frequencies: list[float]) -> DataFrame:
    """Amplitude of each frequency in an unevenly sampled curve, over the square root of its rows."""
    rows = df.withColumn("frequency", F.explode(F.array(*[F.lit(float(f)) for f in frequencies])))
    w = -2 * math.pi * F.col("frequency") * F.col(c.time)
    sums = rows.groupBy(c.key, "frequency").agg(F.sum(F.col(c.flux) * F.cos(w)).alias("x"), F.sum(F.col(c.flux) * F.sin(w)).alias("y"), F.count(F.lit(1)).alias("n"))
    return sums.select(c.key, "frequency", (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.sqrt("n")).alias("amplitude"))
