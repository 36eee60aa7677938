"""Epochs: stretches of a light curve without long gaps, and the scores and rules that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import geo
from heliograph.operators import graph
from heliograph.operators.lightcurve import Curve, prepare


def gaps(df: DataFrame, c: Curve) -> DataFrame:
    """Add ``gap``, the time since the row before; 0 for a source's first row."""
    return df.withColumn("gap", F.coalesce(F.col(c.time) - F.lag(c.time).over(c.ordered()), F.lit(0.0)))


def cadence(df: DataFrame, c: Curve, split: float = 10) -> DataFrame:
    """Mean of the gaps below and from ``split``, and the time span, per source."""
    rows = df.withColumn("_gap", F.col(c.time) - F.lag(c.time).over(c.ordered()))
    return rows.groupBy(c.key).agg(
        F.avg(F.when(F.col("_gap") < split, F.col("_gap"))).alias("short_gap"), F.avg(F.when(F.col("_gap") >= split, F.col("_gap"))).alias("long_gap"), (F.max(c.time) - F.min(c.time)).alias("span")
    )


def epochs(df: DataFrame, c: Curve, gap: float = 10, longer_than: int = 0) -> DataFrame:
    """Add ``epoch``, counted from 0. A stretch that starts after a gap counts only if it has more than ``longer_than``
    rows; else it belongs to the stretch before. Both passes use one ordering, so one shuffle by source."""
    order = c.ordered()
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = gaps(df, c).withColumn("_starts", (F.col("gap") > gap).cast("int")).withColumn("epoch", F.sum("_starts").over(running))
    if longer_than:
        out = out.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(c.key, "epoch")))
        out = out.withColumn("_starts", F.when(F.col("_rows") > longer_than, F.col("_starts")).otherwise(0))
        out = out.withColumn("epoch", F.sum("_starts").over(running)).drop("_rows")
    return out.withColumn("epoch", F.col("epoch").cast("int")).drop("_starts", "gap")


def epoch_table(df: DataFrame, c: Curve) -> DataFrame:
    """Per source and epoch: median flux, median error, rows."""
    return df.groupBy(c.key, "epoch").agg(F.median(c.flux).alias("flux"), F.median(c.sigma).alias("sigma"), F.count(F.lit(1)).alias("n"))


def scores(table: DataFrame, key: str) -> DataFrame:
    """Zigzag and variance scores of epoch medians.

    The signs of the changes from epoch to epoch form a pattern; ``zig`` is the number of rises that a fall follows over
    half the pattern's length, 0 with fewer than two signs. ``var`` is the smaller variance of the even or the odd epochs
    over the variance of all, 1 where there is nothing to compare.
    """
    order = Window.partitionBy(key).orderBy("epoch")
    rows = table.withColumn("_sign", F.signum(F.col("flux") - F.lag("flux").over(order)))
    rows = rows.withColumn("_next", F.lead("_sign").over(order))
    even = F.col("epoch") % 2 == 0
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_epochs"), F.sum(F.when((F.col("_sign") > 0) & (F.col("_next") < 0), 1).otherwise(0)).alias("_turns"), F.var_pop("flux").alias("_all"),
        F.var_pop(F.when(even, F.col("flux"))).alias("_even"), F.var_pop(F.when(~even, F.col("flux"))).alias("_odd"),
    )
    signs = F.col("n_epochs") - 1
    zig = F.when(signs < 2, 0.0).otherwise(F.col("_turns") / F.floor(signs / 2))
    var = F.when((F.col("n_epochs") < 2) | (F.col("_all") == 0), 1.0).otherwise(F.least(F.coalesce("_even", "_odd"), F.coalesce("_odd", "_even")) / F.col("_all"))
    return out.select(key, "n_epochs", zig.alias("zig"), var.alias("var"))


def is_latent(zig: Column, var: Column) -> Column:
    """An artefact's alternation: true or null, never false."""
    return F.when(((zig > 0.8) & (var < 0.3)) | (var < 0.1), True)


def transient_rule(df: DataFrame, c: Curve, gap: float = 10, longer_than: int = 7, least: int = 20, rise: float = 3, strength: float = 5) -> DataFrame:
    """Per source: its scores, its brightest epoch, and whether it is a transient.

    ``df`` may carry ``modifier``, 0 away from the galactic plane and up to 1 in it, which raises the thresholds.
    """
    rows = df if "modifier" in df.columns else df.withColumn("modifier", F.lit(0.0))
    marked = epochs(rows, c, gap, longer_than)
    table = epoch_table(marked, c)
    best = table.groupBy(c.key).agg(F.max_by(F.struct("flux", "sigma"), F.struct(F.col("flux"), -F.col("epoch"))).alias("top"))
    whole = rows.groupBy(c.key).agg(F.count(F.lit(1)).alias("n_points"), F.median(c.flux).alias("_flux"), F.median(c.sigma).alias("_sigma"), F.max("modifier").alias("_g"))
    out = whole.join(best, c.key).join(scores(table, c.key), c.key)
    top, sigma = F.col("top.flux"), F.col("top.sigma")
    alternates = ((F.col("zig") > 0.8) & (F.col("var") < 0.3)) | (F.col("var") < 0.1)
    faint = F.abs(top - F.col("_flux")) < (rise + 3 * F.col("_g")) * F.col("_sigma")
    weak = F.try_divide(top, sigma) < strength + 5 * F.col("_g")
    no = (F.col("n_points") < least) | alternates | faint | weak
    return out.select(c.key, "n_points", "n_epochs", "zig", "var", top.alias("max_epoch_flux"), (~F.coalesce(no, F.lit(False))).alias("transient"))


def periodic_rule(df: DataFrame, c: Curve, least: int = 120, spread: float = 3, zero: float = geo.ZERO_JY_1) -> DataFrame:
    """Per source: whether its spread is large against its errors and, for bright ones, against their magnitude."""
    rows = df if "modifier" in df.columns else df.withColumn("modifier", F.lit(0.0))
    q = lambda p: F.percentile(c.flux, F.lit(p))
    stats = rows.groupBy(c.key).agg(F.count(F.lit(1)).alias("n_points"), (q(0.8) - q(0.15)).alias("range65"), (q(0.75) - q(0.25)).alias("iqr"), F.median(c.sigma).alias("_sigma"), F.avg(c.flux).alias("_mean"), F.max("modifier").alias("_g"))
    mag = geo.magnitude(F.col("_mean"), zero)
    no = (F.col("n_points") < least) | (F.col("range65") < (spread + 2 * F.col("_g")) * F.col("_sigma")) | ((mag < 8) & (F.col("iqr") < F.try_divide(F.lit(2.0), mag)))
    return stats.select(c.key, "n_points", "range65", "iqr", (~F.coalesce(no, F.lit(False))).alias("variable"))


def rule_catalog(df: DataFrame, c: Curve, scored: DataFrame, places: DataFrame, confident: float = 0.0, transient: dict | None = None, periodic: dict | None = None) -> DataFrame:
    """(key, ra, dec, type, confidence) of sources that a score calls variable and that their class's rule confirms.

    ``scored`` has (key, class, confidence), class 1 for transient and 2 for periodic; others, and those of ``confident`` or
    less, go before any light curve is looked at. ``places`` has (key, ra, dec), one or more rows a source, averaged on the
    sphere and rounded to seven digits. A source whose curve the masks leave too short has no rule's word and goes.
    """
    flagged = scored.where(F.col("class").isin(1, 2) & (F.col("confidence") > confident)).select(c.key, "class", "confidence")
    rows = prepare(df.join(flagged.select(c.key, "class"), c.key), c)
    one = transient_rule(rows.where("class = 1"), c, **(transient or {})).where("transient").select(c.key)
    two = periodic_rule(rows.where("class = 2"), c, **(periodic or {})).where("variable").select(c.key)
    kept = flagged.join(one.unionByName(two), c.key, "left_semi")
    centres = graph.centroids(places.join(kept.select(c.key), c.key, "left_semi"), c.key, "ra", "dec")
    names = F.when(F.col("class") == 1, "transient").otherwise("periodic")
    return kept.join(centres, c.key).select(c.key, F.round("ra", 7).alias("ra"), F.round("dec", 7).alias("dec"), names.alias("type"), "confidence")


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Session windows of events, in batch or, with a watermark, in a stream."""
    return df.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
