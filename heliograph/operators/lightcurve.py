"""Light curves: quality filters, observation masks, clipping, nesting and per-source statistics.

A light curve is a set of rows of one source, ordered by time and tie-breakers. Operators take column names, so that any
table of repeated measurements will do; missing values are null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import geo


@dataclass(frozen=True)
class Curve:
    """Names of a light-curve table's columns."""

    key: str = "source_id"
    time: str = "mjd"
    flux: str = "flux"
    sigma: str = "sig"
    chi: str = "chi"
    quality: str = "qual"
    ties: tuple[str, ...] = ("tie",)

    def ordered(self):
        return Window.partitionBy(self.key).orderBy(self.time, *self.ties)

    def whole(self):
        return Window.partitionBy(self.key)


#: Rows of a task's share of :func:`dealt` tables, on average at most.
TASK_ROWS = 250_000


def dealt(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` by ``key``, in as many parts as its rows ask for: what follows by that key moves and holds no more than a part."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, key)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column, so that one missing value has one form."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def snr(flux: Column, sigma: Column) -> Column:
    """Flux over its error; 0 where the error is missing."""
    return F.when(sigma.isNotNull(), F.try_divide(flux, sigma)).otherwise(0.0)


def quality_filter(df: DataFrame, bands: Sequence[tuple[str, str, str]], least_snr: float = 4, flags: int = 511) -> DataFrame:
    """Rows with an error in some band, enough signal in some band, and no artefact bit in any; a null bit field drops."""
    errors = [F.col(sigma).isNotNull() for _, sigma, _ in bands]
    strong = [snr(F.col(flux), F.col(sigma)) > least_snr for flux, sigma, _ in bands]
    clean = [F.col(bits).bitwiseAND(F.lit(flags).cast(df.schema[bits].dataType)) == 0 for _, _, bits in bands]
    any_of = lambda cs: F.greatest(*[F.coalesce(c, F.lit(False)) for c in cs]) if len(cs) > 1 else F.coalesce(cs[0], F.lit(False))
    out = df.where(any_of(errors)).where(any_of(strong))
    for c in clean:
        out = out.where(c)
    return out


def observation_mask(c: Curve, least_snr: float = 4, most_chi: float = 10) -> Column:
    return (F.col(c.flux) > 0) & (F.col(c.sigma) > 0) & (F.col(c.quality) > 0) & (F.try_divide(F.col(c.flux), F.col(c.sigma)) > least_snr) & (F.col(c.chi) < most_chi)


def clip(df: DataFrame, c: Curve, factor: float = 4) -> DataFrame:
    """Rows nearer to their source's mean than ``factor`` population deviations; a constant source loses all rows."""
    own = c.whole()
    out = df.withColumns({"_mean": F.avg(c.flux).over(own), "_dev": F.stddev_pop(c.flux).over(own)})
    return out.where(F.abs(F.col(c.flux) - F.col("_mean")) < factor * F.col("_dev")).drop("_mean", "_dev")


def min_points(df: DataFrame, c: Curve, least: int = 20) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(c.whole())).where(F.col("_n") >= least).drop("_n")


def prepare(df: DataFrame, c: Curve, least: int = 20) -> DataFrame:
    """Masked, clipped and long enough light curves. The windows share one shuffle by source."""
    return min_points(clip(df.where(observation_mask(c)), c), c, least)


def nest(df: DataFrame, c: Curve, values: Sequence[str]) -> DataFrame:
    """One row per source with its observations as an array of structs in time order."""
    fields = list(dict.fromkeys([c.time, *c.ties, *values]))
    return df.groupBy(c.key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("obs"))


def parallel(nested: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The parallel-array form, for sinks: an array for each field, all in the order of ``obs``."""
    return nested.select(key, *[F.col("obs")[f].alias(f) for f in fields])


def amplitudes(df: DataFrame, c: Curve, zero: float = geo.ZERO_JY_1) -> DataFrame:
    """Per source: points, median magnitude, amplitude (q95 - q05), (q90 - q10) / median error."""
    mag = geo.magnitude(F.col(c.flux), zero)
    rows = df.withColumn("_mag", mag)
    return rows.groupBy(c.key).agg(
        F.count(F.lit(1)).alias("n_points"), F.median("_mag").alias("median_mag"), (F.percentile("_mag", F.lit(0.95)) - F.percentile("_mag", F.lit(0.05))).alias("amplitude"),
        F.try_divide(F.percentile(c.flux, F.lit(0.9)) - F.percentile(c.flux, F.lit(0.1)), F.median(c.sigma)).alias("variability_snr"),
    )


def normalise(df: DataFrame, key: str, value: str) -> DataFrame:
    """Add asinh((x - median) / iqr) and (x - mean) / population deviation within each ``key``."""
    stats = df.groupBy(key).agg(
        F.median(value).alias("_m"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("_iqr"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev")
    )
    out = df.join(stats, key)
    return out.withColumns({"asinh_norm": F.asinh(F.try_divide(F.col(value) - F.col("_m"), F.col("_iqr"))), "zscore": F.try_divide(F.col(value) - F.col("_mean"), F.col("_dev"))}).drop("_m", "_iqr", "_mean", "_dev")


def histogram(values: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts in equal bins with the last one closed, and log10(n + 1); values outside are left out."""
    width = (high - low) / bins
    inside = values.where(F.col(column).between(low, high))
    bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10(F.col("n") + 1))


def moment_parts(value: str) -> tuple[list[Column], list[Column]]:
    """Aggregates, and what :func:`corrected_moments` makes of them."""
    n = F.col("n").cast("double")
    return [F.count(value).alias("n"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2")], [
        F.col("n"),
        F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).alias("kurt"),
    ]


def corrected_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Bias-corrected skewness and kurtosis, from Spark's population forms."""
    raw, finished = moment_parts(value)
    return df.groupBy(key).agg(*raw).select(key, *finished)
