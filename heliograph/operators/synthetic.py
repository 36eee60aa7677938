"""Seeded synthetic light curves: quiet, transient, eclipsing and pulsating sources with a survey's cadence."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.lightcurve import dealt
from heliograph.sources.scratch import discard, materialise

#: Shares of the kinds in five sources, and the class of each: 0 quiet, 1 transient, 2 periodic.
KINDS = ["quiet", "quiet", "transient", "pulsating", "eclipsing"]
CLASSES = {"quiet": 0, "transient": 1, "pulsating": 2, "eclipsing": 2}
SEASON, SPAN, VISITS, STEP = 180.0, 3500.0, 12, 0.13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that recomputed tasks agree."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def normal(*parts: Column) -> Column:
    u, v = uniform(*parts, F.lit("u")), uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def light_curves(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows (key, kind, label, period, mjd, flux, sig) for each key: bursts of visits every season, over ten years."""
    k, s = F.col(key), F.lit(seed)
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.pmod(k, F.lit(len(KINDS))) + 1).cast("int"))
    rows = keys.select(key, kind.alias("kind"), (0.5 + 9 * uniform(k, s, F.lit("period"))).alias("period"), (200 + 2800 * uniform(k, s, F.lit("at"))).alias("_at"), (5 + 20 * uniform(k, s, F.lit("amp"))).alias("_amp"))
    rows = rows.withColumn("_season", F.explode(F.sequence(F.lit(0), F.lit(int(SPAN // SEASON))))).withColumn("_visit", F.explode(F.sequence(F.lit(0), F.lit(VISITS - 1))))
    t = F.col("_season") * SEASON + 10 * uniform(k, s, F.col("_season")) + F.col("_visit") * STEP
    rows = rows.withColumn("mjd", t)
    phase = F.pmod(F.col("mjd"), F.col("period")) / F.col("period")
    dip = lambda at, depth: -depth * F.exp(-((phase - at) * (phase - at)) / (2 * 0.05 * 0.05))
    after = F.col("mjd") - F.col("_at")
    shape = (
        F.when(F.col("kind") == "transient", F.when(after > 0, 8 * F.exp(-after / 250)).otherwise(0.0))
        .when(F.col("kind") == "pulsating", F.sin(2 * math.pi * phase) + 0.3 * F.sin(4 * math.pi * phase))
        .when(F.col("kind") == "eclipsing", dip(0.25, 3.0) + dip(0.75, 1.5)).otherwise(0.0)
    )
    flux = 100 + F.col("_amp") * shape + normal(k, s, F.col("_season"), F.col("_visit"))
    label = F.when(F.col("kind") == "transient", 1).when(F.col("kind").isin("pulsating", "eclipsing"), 2).otherwise(0)
    return rows.select(key, "kind", label.alias("label"), "period", "mjd", flux.alias("flux"), F.lit(1.0).alias("sig"))


#: Attempts drawn at a time, at most, for curves that may be refused, and points of a curve that is taken.
ATTEMPTS, LEAST_VISITS = 8, 40
#: Values of a pulse's control grid, its zeros at both ends, and the reach of the kernel that smooths it.
GRID, MARGIN, KERNEL = 110, 13, 40


def visits(keys: DataFrame, key: str, *parts: Column) -> DataFrame:
    """Visits (mjd, season, visit) of each row of ``keys``: bursts every season, over ten years."""
    rows = keys.withColumn("season", F.explode(F.sequence(F.lit(0), F.lit(int(SPAN // SEASON))))).withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(VISITS - 1))))
    return rows.withColumn("mjd", F.col("season") * SEASON + 10 * uniform(F.col(key), *parts, F.col("season")) + F.col("visit") * STEP)


def _log_normal(x: Column, duration: Column, width: Column, centre: Column) -> Column:
    away = F.acosh(duration / x) - centre
    return F.exp(-away * away / (2 * width * width)) / (x * width * math.sqrt(2 * math.pi))


def _burst(keys: DataFrame, key: str, s: Column) -> DataFrame:
    """Visits of bursts for each (key, attempt), those that are seen: some only while the burst lasts, some sparse elsewhere."""
    k, n = F.col(key), F.col("attempt")
    draw = lambda what, low=0.0, high=1.0: between(low, high, k, s, n, F.lit(what))
    rows = keys.withColumns({
        "_sigma": F.pow(F.lit(10.0), draw("sigma", 0.0, 1.0)), "_base": 50 + 150 * draw("base"), "_only": draw("only") < 0.5, "_sparse": draw("sparse") < 0.4, "_gone": draw("gone", 0.4, 1.0),
        "_wide": F.pow(F.lit(3.0), draw("wide")), "_duration": draw("duration", 300.0, 2000.0), "_width": draw("width", 0.9, 1.75), "_centre": draw("centre", 1.0, 1.75), "_missed": F.greatest(F.lit(0.0), draw("missed", -0.25, 0.15)),
    })
    rows = rows.withColumns({"_amp": F.col("_sigma") * F.pow(F.lit(10.0), draw("amp", 0.5, 1.75)), "_start": draw("start") * (4000 - F.col("_duration"))})
    rows = visits(rows, key, s, n).where(uniform(k, s, n, F.col("season"), F.lit("missed")) >= F.col("_missed"))
    x, length = F.col("mjd") - F.col("_start"), F.col("_duration")
    during = (x > 0) & (x < length)
    top = length * (F.exp(-F.col("_width")) - 0.065)
    raw = lambda at: _log_normal(at, length, F.col("_width"), F.col("_centre"))
    level = F.when(during, F.col("_base") + F.col("_amp") / raw(top) * (raw(x) - raw(length))).otherwise(F.col("_base"))
    far = ~during | (x > 0.5 * length)
    hidden = (F.col("_only") & (far | (during & (x < top)))) | (F.col("_sparse") & far & (uniform(k, s, n, F.col("mjd"), F.lit("gone")) < F.col("_gone")))
    spread = F.col("_sigma") * F.when(during & (x < 200), F.col("_wide")).otherwise(1.0)
    flux = level + F.col("_sigma") * normal(k, s, n, F.col("mjd"))
    return rows.where(~hidden).select(key, "attempt", "mjd", flux.alias("flux"), spread.alias("sig"), length.alias("duration"), F.col("_start").alias("start"))


def bursts(keys: DataFrame, key: str, seed: int = 0, least: int = LEAST_VISITS) -> DataFrame:
    """A log-normal burst for each key, drawn again until ``least`` visits of it are seen: the first attempt that has them.

    Attempts are numbered, and each draws from its own number, so that a curve depends on key and seed alone. Attempts are
    counted one, two, four and so on, ``ATTEMPTS`` at most, at a time, for those keys only that still lack one; the counts
    of a round are written.
    """
    s, parts, first, size = F.lit(seed), [], 0, 1
    left = keys.select(key).distinct()
    while True:
        if first:
            left, before = dealt(left, key, 2_000), left
        tries = left.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(first + size - 1))))
        seen = _burst(tries, key, s).groupBy(key, "attempt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        taken = materialise(seen.groupBy(key).agg(F.min("attempt").alias("attempt")), "attempts")
        parts.append(taken)
        rest = materialise(left.join(taken, key, "left_anti"), "attempts-left")
        if first:
            discard(before)
        left, first, size = rest, first + size, min(ATTEMPTS, 2 * size)
        if left.isEmpty():
            discard(left)
            return _burst(dealt(reduce(DataFrame.unionByName, parts), key, 2_000), key, s)


def pulses(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Pulsating curves of random shape (key, mjd, flux, sig, period, grid): two or three peaks of alternating sign.

    Peaks stand on a control grid of ``GRID`` values; a sum of bells, as far as ``KERNEL`` reaches, smooths them; the
    grid between margins of zeros is scaled to the amplitude, and read between its values at each visit's phase.
    """
    k, s = F.col(key), F.lit(seed)
    draw = lambda what, low=0.0, high=1.0: between(low, high, k, s, F.lit(what))
    band = draw("band")
    period = F.when(band < 0.3, draw("p0", 0.1, 3.0)).when(band < 0.8, draw("p1", 3.0, 100.0)).when(band < 0.95, draw("p2", 100.0, 1000.0)).otherwise(draw("p3", 1000.0, 4000.0))
    sigma = F.pow(F.lit(10.0), draw("sigma"))
    peaks = F.when(draw("peaks") < 0.5, 2).otherwise(3)
    span = F.lit(float(GRID)) / peaks
    centre = lambda i: F.floor(span * i + 1 + uniform(k, s, i, F.lit("at")) * (span - 1 - KERNEL / 2)) + MARGIN
    height = lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0) * (0.15 + 0.85 * uniform(k, s, i, F.lit("height")))
    of = F.transform(F.sequence(F.lit(0), peaks - 1), lambda i: F.struct(centre(i).alias("c"), height(i).alias("h")))
    rows = keys.select(key).distinct().withColumns({"period": period, "sig": sigma, "_of": of, "_soft": KERNEL * draw("soft", 4.0, 9.0), "_amp": 3 * sigma + F.abs(2.5 * sigma * normal(k, s, F.lit("amp"))), "_base": 50 + 150 * draw("base")})
    bell = lambda g, p: F.when(F.abs(g - p["c"]) <= KERNEL, p["h"] * F.exp(-(g - p["c"]) * (g - p["c"]) / F.col("_soft"))).otherwise(0.0)
    grid = F.transform(F.sequence(F.lit(0), F.lit(GRID + 2 * MARGIN - 1)), lambda g: F.aggregate("_of", F.lit(0.0), lambda total, p: total + bell(g, p)))
    rows = rows.withColumn("_grid", grid)
    rows = rows.withColumn("_top", F.array_max(F.transform("_grid", F.abs))).withColumn("grid", F.transform("_grid", lambda v: F.col("_base") + F.col("_amp") * v / F.col("_top")))
    rows = visits(rows.drop("_grid", "_top", "_of", "_soft"), key, s)
    place = (F.size("grid") - 1) * F.pmod(F.col("mjd"), F.col("period")) / F.col("period")
    at = lambda i: F.get("grid", i.cast("int"))
    level = at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * (place - F.floor(place))
    return rows.select(key, "mjd", (level + F.col("sig") * normal(k, s, F.col("mjd"))).alias("flux"), "sig", "period", "grid")


def between(low: float, high: float, *parts: Column) -> Column:
    return low + (high - low) * uniform(*parts)


def sparse_nulls(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A quarter of the quiet sources keep 20 to 79 visits; 30 % of those are smoothed over two to six visits.

    Other kinds keep their rows. At a curve's ends the mean is over the visits that there are.
    """
    k, s = F.col(key), F.lit(seed)
    sparse = (F.col("kind") == "quiet") & (uniform(k, s, F.lit("sparse")) < 0.25)
    order = Window.partitionBy(key).orderBy(uniform(k, s, F.col("mjd"), F.lit("keep")), "mjd")
    rows = df.withColumns({"_sparse": sparse, "_place": F.row_number().over(order)})
    rows = rows.where(~F.col("_sparse") | (F.col("_place") <= F.floor(between(20, 80, k, s, F.lit("kept")))))
    width, smooth = F.floor(between(2, 7, k, s, F.lit("width"))), F.col("_sparse") & (uniform(k, s, F.lit("smooth")) < 0.3)
    flux = F.col("flux")
    for w in range(2, 7):
        mean = F.avg("flux").over(Window.partitionBy(key).orderBy("mjd").rowsBetween(-(w // 2), (w - 1) // 2))
        flux = F.when(smooth & (width == w), mean).otherwise(flux)
    return rows.withColumn("flux", flux).drop("_sparse", "_place")


def augmented(df: DataFrame, key: str, seed: int = 0, least: int = 40) -> DataFrame:
    """Light curves as a model is trained on: noisy errors, up to five outliers, 5 to 65 % of visits missing, normalised.

    Adds ``outlier``; flux becomes asinh((flux - median) / iqr), sig asinh(sig / iqr), mjd a share of 4,000 days since the
    first visit. Missing visits don't take a curve below ``least`` rows, nor does a shorter curve lose any. A curve without
    spread has null flux and sig. Draws depend on key, time and seed alone, so a task that is run again draws the same.
    """
    k, s, at = F.col(key), F.lit(seed), F.col("mjd")
    own = Window.partitionBy(key)
    shuffled = lambda what: F.row_number().over(own.orderBy(uniform(k, s, at, F.lit(what)), "mjd"))
    q = lambda p: F.percentile("flux", F.lit(p))
    # Spark's estimate doesn't see a key's many rows, so that a join with a curve's statistics would broadcast the curves
    before = {"_centre": q(0.5).over(own), "_reach": (q(0.95).over(own) - q(0.05).over(own)) / 2, "_rows": F.count(F.lit(1)).over(own)}
    rows = df.where(F.col(key).isNotNull()).withColumns({"_ray": shuffled("ray"), "_miss": shuffled("miss"), **before})
    rows = rows.withColumn("outlier", F.col("_ray") <= F.floor(between(0, 6, k, s, F.lit("rays"))))
    noisy = F.col("sig") * (between(0.5, 0.75, k, s, F.lit("noise")) + 0.3 * normal(k, s, at, F.lit("error")))
    stray = F.col("_centre") + F.col("_reach") * between(-3.5, 3.5, k, s, at, F.lit("stray"))
    rows = rows.withColumns({"flux": F.when(F.col("outlier"), stray).otherwise(F.col("flux")), "sig": noisy * F.when(F.col("outlier"), between(0.2, 4, k, s, F.lit("factor"))).otherwise(1.0)})
    missing = F.least(F.floor(between(0.05, 0.65, k, s, F.lit("share")) * F.col("_rows")), F.greatest(F.col("_rows") - least, F.lit(0)))
    rows = rows.where(F.col("_miss") > missing).drop("_ray", "_miss", "_centre", "_reach", "_rows")
    rows = rows.withColumns({"_m": q(0.5).over(own), "_iqr": q(0.75).over(own) - q(0.25).over(own), "_first": F.min("mjd").over(own)})
    scaled = {"flux": F.asinh(F.try_divide(F.col("flux") - F.col("_m"), F.col("_iqr"))), "sig": F.asinh(F.try_divide(F.col("sig"), F.col("_iqr"))), "mjd": (at - F.col("_first")) / 4000}
    return rows.withColumns(scaled).drop("_m", "_iqr", "_first")


def turned(df: DataFrame, key: str, level: str = "level", seed: int = 0, flip: float = 0.4, sign: float = 0.4) -> DataFrame:
    """Arrays of phase bins as a model is trained on: a random shift of their level, some read backwards, some with the sign changed.

    Adds ``shift``, ``flipped`` and ``negated``, drawn for each key, so that a task that is run again draws the same.
    """
    k, s = F.col(key), F.lit(seed)
    drawn = {"shift": uniform(k, s, F.lit("shift")), "flipped": uniform(k, s, F.lit("flip")) < flip, "negated": uniform(k, s, F.lit("sign")) < sign}
    moved = F.transform(F.col(level), lambda v: F.when(F.col("negated"), -(v + F.col("shift"))).otherwise(v + F.col("shift")))
    return df.withColumns(drawn).withColumn(level, F.when(F.col("flipped"), F.reverse(moved)).otherwise(moved))
