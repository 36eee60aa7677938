"""Queries on periods: folding, periodograms, aliases, peaks, smoothing, features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import catalog
from heliograph.operators import features as ft
from heliograph.operators import periods as pd_
from heliograph.operators import synthetic
from heliograph.plans.adapters import EV, EV_SQL, LC, events, lc_sql, light_curves, rounded
from heliograph.plans.registry import ORACLES, query
from heliograph.sources.tables import table

TRIALS = [7.0, 11.5, 23.0, 47.0, 61.0, 90.0, 182.5, 365.25]
_GRID = "(SELECT unnest([" + ", ".join(f"{p}::DOUBLE" for p in TRIALS) + "]) AS period)"
_WITH = "WITH " + lc_sql()
_PART = "WITH " + lc_sql("l_partkey")
_ORDER = "PARTITION BY source_id ORDER BY mjd, t1, t2, t3, flux"
_PHASE = "((mjd - period * floor(mjd / period)) / period)"


@query(f"WITH {EV_SQL} SELECT event_id, round((t - 3.7::DOUBLE * floor(t / 3.7::DOUBLE)) / 3.7::DOUBLE, 6) AS phase FROM ev")
def phase_fold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events(spark, folder).select("event_id", pd_.phase(F.col("t"), F.lit(3.7)).alias("phase")))


@query(f"""WITH {EV_SQL}, b AS (SELECT user_id, value, CAST(floor((t - 3.7::DOUBLE * floor(t / 3.7::DOUBLE)) / 3.7::DOUBLE * 16) AS INT) AS bin, var_pop(value) OVER (PARTITION BY user_id) AS va FROM ev)
SELECT user_id, bin, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN median(value) ELSE 0 END, 6) AS median_flux, round(CASE WHEN count(*) >= 2 THEN var_pop(value) / max(va) ELSE 0 END, 6) AS var_ratio FROM b GROUP BY 1, 2""")
def phase_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pd_.phase_bins(events(spark, folder).withColumn("period", F.lit(3.7)), EV, "period", 16))


_AOV = f""", g AS (SELECT source_id, period, floor({_PHASE} * 12) AS bin, count(*) AS n, avg(flux) AS m, var_pop(flux) AS v FROM lc, {_GRID} GROUP BY 1, 2, 3),
 h AS (SELECT source_id, period, sum(n) AS n, count(*) AS r, sum(n * m) AS s, sum(n * m * m) AS ss, sum(n * v) AS w FROM g GROUP BY 1, 2),
 a AS (SELECT source_id, period, (n - r) * (ss - s * s / n) / nullif((r - 1) * w, 0) AS sig FROM h)"""


@query(_WITH + _AOV + " SELECT source_id, period, round(sig, 4) AS sig FROM a")
def aov_periodogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pd_.aov(light_curves(spark, folder), LC, TRIALS), 4)


@query(_WITH + f""", o AS (SELECT source_id, avg(flux) AS m, var_pop(flux) AS v FROM lc GROUP BY 1), r AS (SELECT source_id, period, flux - m AS y, v, 2 * pi() * mjd / period AS w FROM lc JOIN o USING (source_id), {_GRID}),
 s AS (SELECT source_id, period, sum(y * cos(w)) AS yc, sum(y * sin(w)) AS ys, sum(cos(w) * cos(w)) AS cc, sum(sin(w) * sin(w)) AS ss, sum(cos(w) * sin(w)) AS cs, max(v) AS v FROM r GROUP BY 1, 2),
 u AS (SELECT *, 0.5 * atan2(2 * cs, cc - ss) AS t FROM s),
 x AS (SELECT *, yc * cos(t) + ys * sin(t) AS yc2, ys * cos(t) - yc * sin(t) AS ys2, cc * cos(t) * cos(t) + 2 * cs * cos(t) * sin(t) + ss * sin(t) * sin(t) AS cc2, ss * cos(t) * cos(t) - 2 * cs * cos(t) * sin(t) + cc * sin(t) * sin(t) AS ss2 FROM u)
SELECT source_id, period, round((yc2 * yc2 / cc2 + ys2 * ys2 / ss2) / (2 * v), 4) AS sig FROM x""")
def lomb_scargle(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pd_.lomb_scargle(light_curves(spark, folder), LC, TRIALS), 4)


@query(_WITH + f""", o AS (SELECT source_id, min(flux) AS lo, max(flux) AS hi, count(*) AS cnt FROM lc GROUP BY 1),
 c AS (SELECT source_id, period, floor({_PHASE} * 10) AS p, least(floor((flux - lo) / (hi - lo) * 5), 4) AS b, count(*) AS n, max(cnt) AS cnt FROM lc JOIN o USING (source_id), {_GRID} GROUP BY 1, 2, 3, 4),
 d AS (SELECT source_id, period, p, sum(n) AS np, sum(n * ln(n)) AS nl, max(cnt) AS cnt FROM c GROUP BY 1, 2, 3)
SELECT source_id, period, round(sum(np * ln(np) - nl) / max(cnt), 6) AS sig FROM d GROUP BY 1, 2""")
def conditional_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pd_.conditional_entropy(light_curves(spark, folder), LC, TRIALS))


def _cadences(lc: DataFrame) -> DataFrame:
    """Usual short and long gaps of each source."""
    from heliograph.operators.epochs import gaps

    rows = gaps(lc, LC).where(F.col("gap") > 0)
    return rows.groupBy("source_id").agg(F.median(F.when(F.col("gap") < 20, F.col("gap"))).alias("short"), F.median(F.when(F.col("gap") > 20, F.col("gap"))).alias("long"))


_CAD = f""", k AS (SELECT source_id, mjd - lag(mjd) OVER ({_ORDER}) AS gap FROM lc), q AS (SELECT source_id, median(gap) FILTER (WHERE gap < 20) AS short, median(gap) FILTER (WHERE gap > 20) AS long FROM k WHERE gap > 0 GROUP BY 1)"""
_NEAR = "coalesce(list_bool_or(list_transform([1.0::DOUBLE / 3, 1.0::DOUBLE / 2, 1, 2, 4.0::DOUBLE / 3, 3.0::DOUBLE / 2, 3, 4], lambda r: abs(period - r * {0}) <= 0.085::DOUBLE * r * {0})), false)"
_EXC = _AOV + _CAD + f", x AS (SELECT a.source_id, period, CASE WHEN {_NEAR.format('short')} OR {_NEAR.format('long')} THEN 0.0 ELSE sig END AS sig FROM a LEFT JOIN q USING (source_id))"


@query(_PART + _EXC + " SELECT source_id, period, round(sig, 4) AS sig FROM x")
def alias_excise(spark: SparkSession, folder: str) -> DataFrame:
    lc = light_curves(spark, folder, "l_partkey")
    return rounded(pd_.excise_aliases(pd_.aov(lc, LC, TRIALS), _cadences(lc), "source_id"), 4)


_PEAK = ", p{k} AS (SELECT source_id, arg_max(period, (sig, -period)) AS p, max(sig) AS s FROM l{k} WHERE sig IS NOT NULL GROUP BY 1), l{n} AS (SELECT l{k}.* FROM l{k} LEFT JOIN p{k} USING (source_id) WHERE p IS NULL OR abs(period - p) > 0.1::DOUBLE * p)"


@query(_WITH + _AOV + ", l1 AS (SELECT * FROM a)" + "".join(_PEAK.format(k=k, n=k + 1) for k in (1, 2, 3)) + " SELECT p1.source_id, p1.p AS peak1, round(p1.s, 4) AS peak1_sig, p2.p AS peak2, round(p2.s, 4) AS peak2_sig, p3.p AS peak3, round(p3.s, 4) AS peak3_sig FROM p1 LEFT JOIN p2 USING (source_id) LEFT JOIN p3 USING (source_id)")
def top_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pd_.top_peaks(pd_.aov(light_curves(spark, folder), LC, TRIALS), "source_id"), 4)


@query(_WITH + _AOV + " SELECT source_id, arg_max(period, (sig, -period)) AS best_long_period, round(max(sig), 4) AS best_long_period_sig FROM a WHERE period > 30 GROUP BY 1")
def best_long_period(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pd_.best_long(pd_.aov(light_curves(spark, folder), LC, TRIALS), "source_id"), 4)


@query(_PART + """, g AS (SELECT source_id, flux, t1, t2, period, ((mjd - period * floor(mjd / period)) / period) AS p FROM lc, (SELECT unnest([23.3713::DOUBLE, 90.7171::DOUBLE]) AS period)),
 s AS (SELECT *, p AS place, 0 AS turn FROM g UNION ALL SELECT *, p + 1, 1 FROM g WHERE p <= 0.05 UNION ALL SELECT *, p - 1, -1 FROM g WHERE p >= 0.95),
 b AS (SELECT *, avg(flux) OVER (PARTITION BY source_id, period ORDER BY place RANGE BETWEEN 0.05 PRECEDING AND 0.05 FOLLOWING) AS box FROM s)
SELECT source_id, period, round(var_pop(flux) / nullif(avg((flux - box) * (flux - box)), 0), 4) AS sig FROM b WHERE turn = 0 GROUP BY 1, 2""")
def plavchan(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pd_.plavchan(light_curves(spark, folder, "l_partkey"), LC, [23.3713, 90.7171]), 4)


def _smooth_sql(order: str, name: str, source: str) -> str:
    return (
        f", {name}0 AS (SELECT *, CAST(floor(count(*) OVER (PARTITION BY source_id) * 0.1::DOUBLE) AS INT) AS w, row_number() OVER (PARTITION BY source_id ORDER BY {order}) AS i FROM {source}), "
        f"{name} AS (SELECT a.* EXCLUDE (w, i), CASE WHEN a.w > 0 THEN (SELECT sum(b.flux) FROM {name}0 b WHERE b.source_id = a.source_id AND b.i BETWEEN a.i - a.w // 2 AND a.i + (a.w - 1) // 2) / a.w END AS {name}_v FROM {name}0 a)"
    )


@query(_PART + _smooth_sql("mjd, t1, t2, t3, flux", "sm", "lc") + " SELECT source_id, t1, t2, t3, round(sm_v, 6) AS smooth FROM sm")
def moving_average(spark: SparkSession, folder: str) -> DataFrame:
    rows = pd_.moving_average(light_curves(spark, folder, "l_partkey"), ["source_id"], ["mjd", *LC.ties], "flux")
    return rounded(rows.select("source_id", "t1", "t2", "t3", "smooth"))


@query(_PART + ", f AS (SELECT *, ((mjd - 23.3713::DOUBLE * floor(mjd / 23.3713::DOUBLE)) / 23.3713::DOUBLE) AS phase FROM lc)" + _smooth_sql("mjd, t1, t2, t3, flux", "sn", "f") + _smooth_sql("phase, t1, t2, t3, flux", "sf", "sn") + " SELECT source_id, round(avg((flux - sn_v) * (flux - sn_v)) / nullif(avg((flux - sf_v) * (flux - sf_v)), 0), 4) AS period_significance FROM sf GROUP BY 1")
def period_significance(spark: SparkSession, folder: str) -> DataFrame:
    rows = light_curves(spark, folder, "l_partkey").withColumn("period", F.lit(23.3713))
    return rounded(pd_.significance(rows, LC, "period"), 4)


@query(_PART + """, s AS (SELECT source_id, max(mjd) - min(mjd) AS a, avg(sig) AS b, max(mjd) - min(mjd) AS c, CASE WHEN source_id % 5 = 0 THEN NULL ELSE 100 + source_id % 90 END AS d FROM lc GROUP BY 1), u AS (SELECT source_id, unnest([a, b, c, d::DOUBLE]) AS period FROM s)
SELECT DISTINCT source_id, round(period, 6) AS period FROM u WHERE period IS NOT NULL AND NOT (period > 170 AND period < 190)""")
def explode_periods(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("source_id")
    rows = light_curves(spark, folder, "l_partkey").groupBy("source_id").agg((F.max("mjd") - F.min("mjd")).alias("a"), F.avg("sig").alias("b"), (F.max("mjd") - F.min("mjd")).alias("c"))
    rows = rows.withColumn("d", F.when(s % 5 != 0, (100 + s % 90).cast("double")))
    return pd_.explode_periods(rounded(rows), "source_id", ["a", "b", "c", "d"])


@query(_WITH + f""", d AS (SELECT *, flux - lag(flux) OVER ({_ORDER}) AS st FROM lc)
SELECT source_id, count(*) AS n, round((count(*) - 1) * var_pop(flux) * count(*) / (count(*) * sum(st * st)), 6) AS inv_von_neumann FROM d GROUP BY 1""")
def von_neumann(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.von_neumann(light_curves(spark, folder), LC))


@query(_WITH + f""", d AS (SELECT *, sqrt(count(*) OVER (PARTITION BY source_id) / (count(*) OVER (PARTITION BY source_id) - 1)::DOUBLE) * (flux - avg(flux) OVER (PARTITION BY source_id)) / sig AS d FROM lc),
 p AS (SELECT *, d * lead(d) OVER ({_ORDER}) AS p FROM d)
SELECT source_id, round(sqrt(1.0 / (count(*) * (count(*) - 1))) * sum(p), 6) AS stetson_i, round(sum(sign(p) * sqrt(abs(p))) / count(p), 6) AS stetson_j, round(avg(abs(d)) / sqrt(avg(d * d)), 6) AS stetson_k FROM p GROUP BY 1""")
def stetson_ijk(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.stetson(light_curves(spark, folder), LC))


@query(_WITH + f""", s AS (SELECT source_id, median(flux) AS m, median(sig) AS sm FROM lc GROUP BY 1), st AS (SELECT *, flux - lag(flux) OVER ({_ORDER}) AS step FROM lc)
SELECT source_id, round(quantile_cont(flux, 0.6) - quantile_cont(flux, 0.4), 6) AS i60r, round(quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25), 6) AS i75r, round(quantile_cont(flux, 0.9) - quantile_cont(flux, 0.1), 6) AS i90r,
 round(median(abs(flux - m)), 6) AS mad, round(avg(chi), 6) AS mean_chi, round(stddev_pop(chi), 6) AS std_chi, round(max(sm), 6) AS median_sigma, round(median(abs(sig - sm)), 6) AS mad_sigma,
 round((quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25)) / max(sm), 6) AS iqr_over_sigma FROM st JOIN s USING (source_id) GROUP BY 1""")
def spread_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.spreads(light_curves(spark, folder), LC))


def _joined(*names: str) -> str:
    """The SQL of queries whose rows are sources, side by side."""
    parts = [f"({ORACLES[n]}) AS q{i}" for i, n in enumerate(names)]
    return parts[0] + "".join(f" JOIN {part} USING (source_id)" for part in parts[1:])


_STATISTICS = "* EXCLUDE (n), n"


@query("SELECT " + _STATISTICS + " FROM " + _joined("spread_features", "skew_kurt", "stetson_ijk") + " JOIN (SELECT * EXCLUDE (n) FROM (" + ORACLES["von_neumann"] + ")) USING (source_id)")
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen statistics together."""
    return rounded(ft.feature_table(light_curves(spark, folder), LC))


def _horner(factors: list[float]) -> str:
    out = f"{factors[0]}::DOUBLE"
    for f in factors[1:]:
        out = f"({out} * x + {f}::DOUBLE)"
    return out


@query(_WITH + f""", z AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY flux, t1, t2, t3, flux) / count(*) OVER (PARTITION BY source_id)::DOUBLE AS e, (flux - avg(flux) OVER (PARTITION BY source_id)) / nullif(stddev_pop(flux) OVER (PARTITION BY source_id), 0) AS z FROM lc),
 t AS (SELECT *, exp(-x * x / 2) * {_horner(ft.NORMAL_TOP)} / {_horner(ft.NORMAL_BOTTOM)} AS t FROM (SELECT *, abs(z) AS x FROM z)), p AS (SELECT *, CASE WHEN z > 0 THEN 1 - t ELSE t END AS p FROM t)
SELECT source_id, round(sum((e - p) * (e - p) / p), 4) AS gaussian_chi2 FROM p GROUP BY 1""")
def gaussian_chi2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.gaussian_chi2(light_curves(spark, folder), LC), 4)


_BY_PART = "SELECT * FROM (" + (ORACLES["feature_table"] + " JOIN (" + ORACLES["gaussian_chi2"] + ") USING (source_id)").replace("l_suppkey AS source_id", "l_partkey AS source_id") + ")"


@query(f"SELECT * FROM ({_BY_PART}) JOIN ({ORACLES['period_significance']}) USING (source_id) LEFT JOIN (SELECT p_partkey AS source_id, round(p_retailprice - p_size, 6) AS price, 0.0::DOUBLE AS size FROM part) USING (source_id)")
def full_features(spark: SparkSession, folder: str) -> DataFrame:
    """All seventeen statistics and colours, one row for each part."""
    rows = light_curves(spark, folder, "l_partkey").withColumn("period", F.lit(23.3713))
    bands = table(spark, folder, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    full = ft.full_features(rows, LC, "period", [catalog.colours(bands, "size", ["price"])])
    rough = ("gaussian_chi2", "period_significance")
    return full.withColumns({name: F.round(name, 4 if name in rough else 6) for name, kind in full.dtypes if kind == "double"})


@query(_PART + f""", p AS (SELECT *, {_PHASE.replace("period", "23.3713::DOUBLE")} * 16 AS p, var_pop(flux) OVER (PARTITION BY source_id) AS va FROM lc), i AS (SELECT unnest(range(16)) AS bin),
 f AS (SELECT source_id, bin, median(flux) AS m, var_pop(flux) / max(va) AS v FROM p JOIN i ON p >= bin - 0.25::DOUBLE AND p < bin + 1.25::DOUBLE GROUP BY 1, 2 HAVING count(*) >= 2),
 w AS (SELECT s.source_id, i.bin, coalesce(m, 0) AS m, coalesce(v, 0) AS v FROM (SELECT DISTINCT source_id FROM lc) s CROSS JOIN i LEFT JOIN f ON f.source_id = s.source_id AND f.bin = i.bin),
 g AS (SELECT *, min(m) OVER o AS ml, max(m) OVER o AS mh, min(v) OVER o AS vl, max(v) OVER o AS vh FROM w WINDOW o AS (PARTITION BY source_id))
SELECT source_id, CAST(bin AS INT) AS bin, round((m - ml) / nullif(mh - ml, 0), 6) AS level, round((v - vl) / nullif(vh - vl, 0), 6) AS spread FROM g""")
def phase_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping phase bins scaled within each source, empty bins included."""
    shapes = pd_.phase_shape(light_curves(spark, folder, "l_partkey").withColumn("period", F.lit(23.3713)), LC, "period", 16, 0.25)
    return rounded(shapes.select("source_id", F.posexplode(F.arrays_zip("level", "spread")).alias("bin", "s")).select("source_id", "bin", "s.level", "s.spread"))


@query(_WITH + """, p AS (SELECT *, floor(((mjd - 23.3713::DOUBLE * floor(mjd / 23.3713::DOUBLE)) / 23.3713::DOUBLE) * 16) AS bin FROM lc), a AS (SELECT source_id, var_pop(flux) AS va FROM lc GROUP BY 1), i AS (SELECT unnest(range(16)) AS bin),
 f AS (SELECT source_id, bin, avg(flux) AS m, var_pop(flux) AS v FROM p GROUP BY 1, 2) SELECT a.source_id, CAST(i.bin AS INT) AS bin, round(coalesce(m, 0), 4) AS level, round(coalesce(v / va, 0), 6) AS spread FROM a CROSS JOIN i LEFT JOIN f ON f.source_id = a.source_id AND f.bin = i.bin""")
def phase_means(spark: SparkSession, folder: str) -> DataFrame:
    """Means and shares of variance of phase bins that don't overlap, as they are; empty bins are 0."""
    shapes = pd_.phase_shape(light_curves(spark, folder).withColumn("period", F.lit(23.3713)), LC, "period", 16, 0.0, 1, "mean", False)
    long = shapes.select("source_id", F.posexplode(F.arrays_zip("level", "spread")).alias("bin", "s")).select("source_id", "bin", F.round("s.level", 4).alias("level"), F.round("s.spread", 6).alias("spread"))
    return long


@query()
def turned_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Phase bins with a random shift, direction and sign for each supplier; tests hold them against their rule."""
    shapes = pd_.phase_shape(light_curves(spark, folder).withColumn("period", F.lit(23.3713)), LC, "period", 16)
    return rounded(synthetic.turned(shapes.select("source_id", "level"), "source_id").select("source_id", "shift", "flipped", "negated", F.get("level", 0).alias("first_level"), F.get("level", 15).alias("last_level")))


@query()
def period_search(spark: SparkSession, folder: str) -> DataFrame:
    """Two-stage search on the full grid of trial periods; tests hold it against the whole periodogram."""
    return rounded(pd_.search_peaks(light_curves(spark, folder), LC, pd_.trial_grid()), 4)


# AOV of the trials without aliases, and the trial nearest to twice a short best period counted double
_WEIGHED = _EXC + """, z AS (SELECT source_id, arg_max(period, (sig, -period)) AS p FROM x GROUP BY 1), d AS (SELECT x.source_id, arg_min(period, (abs(period - 2 * p), period)) AS q FROM x JOIN z USING (source_id) WHERE p <= 25 GROUP BY 1),
 l1 AS (SELECT x.source_id, period, CASE WHEN period = q THEN 2 * sig ELSE sig END AS sig FROM x LEFT JOIN d USING (source_id))"""


@query(_WITH + _WEIGHED + "".join(_PEAK.format(k=k, n=k + 1) for k in (1, 2, 3)) + """, long AS (SELECT source_id, arg_max(period, (sig, -period)) AS p, max(sig) AS s FROM l1 WHERE period > 50 GROUP BY 1)
SELECT p1.source_id, p1.p AS peak1, round(p1.s, 4) AS peak1_sig, p2.p AS peak2, round(p2.s, 4) AS peak2_sig, p3.p AS peak3, round(p3.s, 4) AS peak3_sig, long.p AS best_long_period, round(long.s, 4) AS best_long_period_sig FROM p1 LEFT JOIN p2 USING (source_id) LEFT JOIN p3 USING (source_id) LEFT JOIN long USING (source_id)""")
def masked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The search within tasks on few trials, each source without its own aliases, doubles of short periods raised."""
    return rounded(pd_.search_peaks(light_curves(spark, folder), LC, np.array(TRIALS), steps=0, long_from=1e9, aliases=0.085, split=20.0, double_up_to=25.0), 4)


@query(_WITH + _AOV + ", b AS (SELECT source_id, arg_max(period, (sig, -period)) AS p, round(max(sig), 4) AS s FROM a WHERE sig IS NOT NULL GROUP BY 1) SELECT source_id, p AS period, CASE WHEN p <= 12 THEN 2 * p ELSE p END AS preferred, s AS sig FROM b")
def double_period(spark: SparkSession, folder: str) -> DataFrame:
    """The best period, or twice that where it is short."""
    best = pd_.top_peaks(pd_.aov(light_curves(spark, folder), LC, TRIALS), "source_id", 1)
    return rounded(best.select("source_id", F.col("peak1").alias("period"), pd_.prefer_double(F.col("peak1"), 12).alias("preferred"), F.col("peak1_sig").alias("sig")), 4)


_BAND2 = ", b AS (SELECT *, 90000.0::DOUBLE - flux AS f2, sig * 0.7::DOUBLE AS s2 FROM lc), q AS (SELECT *, coalesce(avg(f2 / s2) OVER (PARTITION BY source_id), 0) > coalesce(avg(flux / sig) OVER (PARTITION BY source_id), 0) AS two FROM b), c AS (SELECT source_id, CASE WHEN two THEN f2 ELSE flux END AS flux, CASE WHEN two THEN s2 ELSE sig END AS sig FROM q)"


@query(_PART + _BAND2 + """, s AS (SELECT source_id, median(flux) AS m, median(sig) AS n FROM c GROUP BY 1)
SELECT source_id, round(median(abs(flux - m)) / max(n), 6) AS mad_over_noise, round((avg(flux) - max(m)) / nullif(stddev_pop(flux), 0), 6) AS median_skew, round((quantile_cont(flux, 0.6) - quantile_cont(flux, 0.4)) / max(n), 6) AS i60r,
 round((quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25)) / max(n), 6) AS iqr, round((quantile_cont(flux, 0.85) - quantile_cont(flux, 0.15)) / max(n), 6) AS i85r FROM c JOIN s USING (source_id) GROUP BY 1""")
def robust_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the band with the better signal."""
    rows = light_curves(spark, folder, "l_partkey").withColumns({"f2": 90000.0 - F.col("flux"), "s2": F.col("sig") * 0.7})
    return rounded(ft.robust(ft.band_choice(rows, LC, ("f2", "s2")), LC))


@query("WITH f AS (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 0.23::DOUBLE]) AS frequency), " + lc_sql() + " SELECT source_id, frequency, round(sqrt(sum(flux * cos(-2 * pi() * frequency * mjd)) ** 2 + sum(flux * sin(-2 * pi() * frequency * mjd)) ** 2) / sqrt(count(*)), 4) AS amplitude FROM lc, f GROUP BY 1, 2")
def uneven_fourier(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.uneven_fourier(light_curves(spark, folder), LC, [0.01, 0.1, 0.23]), 4)


@query(_WITH + ", o AS (SELECT source_id, 5 + avg(chi) AS p FROM lc GROUP BY 1) SELECT source_id, round(p * 0.95::DOUBLE + k * (0.1::DOUBLE * p / 20), 6) AS period FROM o, range(0, 21) r(k)")
def refined_grid(spark: SparkSession, folder: str) -> DataFrame:
    """A fine grid of periods around each source's first estimate."""
    first = light_curves(spark, folder).groupBy("source_id").agg((5 + F.avg("chi")).alias("p"))
    return rounded(pd_.refined(first, "source_id", "p"))


@query(_PART + ", p AS (SELECT source_id, max(mjd) - min(mjd) + 0.25::DOUBLE AS period FROM lc GROUP BY 1) SELECT CAST(least(floor(log10(period) / (4.0::DOUBLE / 180)), 179) AS INT) AS bin, count(*) AS n, round(log10(count(*) + 1), 6) AS log_n FROM p WHERE log10(period) BETWEEN 0 AND 4 GROUP BY 1")
def period_histogram(spark: SparkSession, folder: str) -> DataFrame:
    from heliograph.operators.lightcurve import histogram

    spans = light_curves(spark, folder, "l_partkey").groupBy("source_id").agg(F.log10(F.max("mjd") - F.min("mjd") + 0.25).alias("v"))
    return rounded(histogram(spans, "v", 180, 0.0, 4.0))
