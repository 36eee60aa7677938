"""Queries on light curves: filters, masks, statistics, epochs and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import arrays, geo
from heliograph.operators import epochs as ep
from heliograph.operators import lightcurve as op
from heliograph.plans.adapters import EV, EV_SQL, LC, MASK_SQL, events, lc_sql, light_curves, positions, rounded, sky_sql
from heliograph.plans.registry import ORACLES, query
from heliograph.sources.scratch import materialise, small_batches
from heliograph.sources.tables import table

#: Curves of an Arrow batch of the network's.
CURVES_AT_ONCE = 200

_WITH = "WITH " + lc_sql()
_PART = "WITH " + lc_sql("l_partkey")
_MASKED = _WITH + f", m AS (SELECT * FROM lc WHERE {MASK_SQL})"
_ORDER = "PARTITION BY source_id ORDER BY mjd, t1, t2, t3, flux"


@query("""WITH e AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1 + event_id % 29 END AS s1, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 2 + event_id % 31 END AS s2,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE (event_id % 5) * 512 END AS b1, (event_id % 7 // 6) * 3 AS b2 FROM events)
SELECT event_id, user_id, round(value, 6) AS value FROM e WHERE (s1 IS NOT NULL OR s2 IS NOT NULL) AND (CASE WHEN s1 IS NOT NULL THEN value / s1 ELSE 0 END > 4 OR CASE WHEN s2 IS NOT NULL THEN value / s2 ELSE 0 END > 4)
 AND (b1 & 511) = 0 AND (b2 & 511) = 0""")
def quality_filter(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, folder, "events").withColumns({
        "s1": F.when(e % 17 != 0, 1 + e % 29).cast("double"), "s2": F.when(e % 13 != 0, 2 + e % 31).cast("double"),
        "b1": F.when(e % 97 != 0, (e % 5) * 512), "b2": F.floor((e % 7) / 6) * 3,
    })
    return rounded(op.quality_filter(rows, [("value", "s1", "b1"), ("value", "s2", "b2")]).select("event_id", "user_id", "value"))


@query(_MASKED + " SELECT source_id, t1, t2, t3, mjd, round(flux, 6) AS flux FROM m")
def obs_mask(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(light_curves(spark, folder).where(op.observation_mask(LC)).select("source_id", "t1", "t2", "t3", "mjd", "flux"))


@query(f"""WITH {EV_SQL}, s AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS d FROM ev)
SELECT event_id, user_id, round(value, 6) AS value FROM s WHERE abs(value - m) < 4 * d""")
def sigma_clip(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.clip(events(spark, folder), EV).select("event_id", "user_id", "value"))


@query(f"WITH {EV_SQL} SELECT event_id, user_id FROM ev QUALIFY count(*) OVER (PARTITION BY user_id) >= 70")
def min_points(spark: SparkSession, folder: str) -> DataFrame:
    return op.min_points(events(spark, folder), EV, 70).select("event_id", "user_id")


@query(f"""WITH {EV_SQL} SELECT user_id, count(*) AS n, round(first(t ORDER BY t, event_id), 6) AS first_t, round(last(value ORDER BY t, event_id), 6) AS last_value,
 round(list_sum(list_transform(list(value ORDER BY t, event_id)[1:5], lambda x: x)), 4) AS first_five FROM ev GROUP BY user_id""")
def nest_lightcurve(spark: SparkSession, folder: str) -> DataFrame:
    nested = op.nest(events(spark, folder), EV, ["value"])
    at = lambda i, f: F.element_at("obs", i)[f]
    five = F.aggregate(F.slice("obs", 1, 5), F.lit(0.0), lambda s, o: s + o["value"])
    return nested.select("user_id", F.size("obs").cast("long").alias("n"), F.round(at(1, "t"), 6).alias("first_t"), F.round(at(-1, "value"), 6).alias("last_value"), F.round(five, 4).alias("first_five"))


@query(f"""WITH {EV_SQL} SELECT user_id, round(list_sum(list(CASE WHEN value > 20 THEN value ELSE 0 END)), 4) AS kept_sum, count(*) FILTER (WHERE value > 20) AS kept FROM ev GROUP BY user_id""")
def masked_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """A stored mask applied to a parallel array."""
    nested = op.parallel(op.nest(events(spark, folder), EV, ["value"]), "user_id", ["value"])
    kept = arrays.masked(F.col("value"), F.transform("value", lambda v: v > 20))
    return nested.select("user_id", F.round(arrays.total(kept), 4).alias("kept_sum"), F.size(kept).cast("long").alias("kept"))


@query(_WITH + """, l AS (SELECT source_id, list(flux) AS a FROM lc GROUP BY 1)
SELECT source_id, round(list_median(a), 6) AS median, round(list_aggregate(a, 'quantile_cont', 0.15), 6) AS q15, round(list_aggregate(a, 'quantile_cont', 0.9), 6) AS q90, round(list_aggregate(a, 'mad'), 6) AS mad FROM l""".replace("list_median(a)", "list_aggregate(a, 'median')"))  # fmt: skip
def list_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of array columns by sorted interpolation, without exploding."""
    a = F.col("a")
    lists = light_curves(spark, folder).groupBy("source_id").agg(F.collect_list("flux").alias("a"))
    return rounded(lists.select("source_id", arrays.median(a).alias("median"), arrays.quantile(a, 0.15).alias("q15"), arrays.quantile(a, 0.9).alias("q90"), arrays.absolute_deviation(a).alias("mad")))


@query(_WITH + " SELECT source_id, count(flux) AS n, round(skewness(flux), 6) AS skew, round(kurtosis(flux), 6) AS kurt FROM lc GROUP BY 1")
def skew_kurt(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.corrected_moments(light_curves(spark, folder), "source_id", "flux"))


_NORM = f"""WITH {EV_SQL}, s AS (SELECT user_id, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q, avg(value) AS a, stddev_pop(value) AS d FROM ev GROUP BY 1)
SELECT event_id, round({{}}, 6) AS {{}} FROM ev JOIN s USING (user_id)"""


@query(_NORM.format("asinh((value - m) / nullif(q, 0))", "asinh_norm"))
def normalize_asinh(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.normalise(events(spark, folder), "user_id", "value").select("event_id", "asinh_norm"))


@query(_NORM.format("(value - a) / nullif(d, 0)", "zscore"))
def zscore(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.normalise(events(spark, folder), "user_id", "value").select("event_id", "zscore"))


@query(_WITH + " SELECT t1, t2, t3, round(CASE WHEN flux - 20000 > 0 THEN -2.5 * log10((flux - 20000) / 309.54) END, 6) AS mag, round(CASE WHEN flux - 20000 > 0 THEN sig / (flux - 20000) * (2.5 / ln(10)) END, 6) AS mag_err FROM lc")
def flux_to_mag(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("flux") - 20000
    return rounded(light_curves(spark, folder).select("t1", "t2", "t3", geo.magnitude(f, geo.ZERO_JY_1).alias("mag"), geo.magnitude_error(f, F.col("sig")).alias("mag_err")))


@query(_PART + ", s AS (SELECT source_id, median(20.752 - 2.5 * log10(flux)) AS v FROM lc GROUP BY 1) SELECT CAST(least(floor(v / 0.018), 999) AS INT) AS bin, count(*) AS n, round(log10(count(*) + 1), 6) AS log_n FROM s WHERE v BETWEEN 0 AND 18 GROUP BY 1")
def mag_histogram(spark: SparkSession, folder: str) -> DataFrame:
    mags = light_curves(spark, folder, "l_partkey").groupBy("source_id").agg(F.median(geo.ZERO_MAG_DN - 2.5 * F.log10("flux")).alias("v"))
    return rounded(op.histogram(mags, "v", 1000, 0.0, 18.0))


@query(_WITH + """, g AS (SELECT *, -2.5 * log10(flux / 309.54) AS mag FROM lc)
SELECT source_id, count(*) AS n_points, round(median(mag), 6) AS median_mag, round(quantile_cont(mag, 0.95) - quantile_cont(mag, 0.05), 6) AS amplitude,
 round((quantile_cont(flux, 0.9) - quantile_cont(flux, 0.1)) / median(sig), 6) AS variability_snr FROM g GROUP BY 1""")
def amplitude(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.amplitudes(light_curves(spark, folder), LC))


@query(_WITH + f" SELECT t1, t2, t3, source_id, coalesce(mjd - lag(mjd) OVER ({_ORDER}), 0) AS gap FROM lc")
def diff_lag(spark: SparkSession, folder: str) -> DataFrame:
    return ep.gaps(light_curves(spark, folder), LC).select("t1", "t2", "t3", "source_id", "gap")


@query(_PART + f""", g AS (SELECT *, mjd - lag(mjd) OVER ({_ORDER}) AS gap FROM lc)
SELECT source_id, round(avg(gap) FILTER (WHERE gap < 10), 6) AS short_gap, round(avg(gap) FILTER (WHERE gap >= 10), 6) AS long_gap, max(mjd) - min(mjd) AS span FROM g GROUP BY 1""")
def cadence_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ep.cadence(light_curves(spark, folder, "l_partkey"), LC))


def _epoch_sql(gap: float, longer: int, source: str = "lc") -> str:
    first = f", g AS (SELECT *, CASE WHEN coalesce(mjd - lag(mjd) OVER ({_ORDER}), 0) > {gap} THEN 1 ELSE 0 END AS s FROM {source}), e AS (SELECT *, CAST(sum(s) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS INT) AS epoch FROM g)"
    if not longer:
        return first
    return (
        first.replace(", e AS", ", e0 AS").replace("AS epoch FROM g", "AS e0 FROM g")
        + f", n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY source_id, e0) > {longer} THEN s ELSE 0 END AS s2 FROM e0), e AS (SELECT *, CAST(sum(s2) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS INT) AS epoch FROM n)"
    )


_EPOCHS = ", t AS (SELECT source_id, epoch, median(flux) AS flux, median(sig) AS sigma, count(*) AS n FROM e GROUP BY 1, 2)"
_SCORES = """, d AS (SELECT *, sign(flux - lag(flux) OVER (PARTITION BY source_id ORDER BY epoch)) AS sg FROM t), d2 AS (SELECT *, lead(sg) OVER (PARTITION BY source_id ORDER BY epoch) AS nx FROM d),
 v AS (SELECT source_id, count(*) AS n_epochs, count(*) FILTER (WHERE sg > 0 AND nx < 0) AS turns, var_pop(flux) AS va, var_pop(flux) FILTER (WHERE epoch % 2 = 0) AS ve, var_pop(flux) FILTER (WHERE epoch % 2 <> 0) AS vo FROM d2 GROUP BY 1),
 sc AS (SELECT source_id, n_epochs, CASE WHEN n_epochs - 1 < 2 THEN 0.0 ELSE turns / floor((n_epochs - 1) / 2) END AS zig, CASE WHEN n_epochs < 2 OR va = 0 THEN 1.0 ELSE least(coalesce(ve, vo), coalesce(vo, ve)) / va END AS var FROM v)"""


@query(_WITH + _epoch_sql(10, 0) + _EPOCHS + " SELECT source_id, epoch, round(flux, 6) AS flux, round(sigma, 6) AS sigma, n FROM t")
def epochs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ep.epoch_table(ep.epochs(light_curves(spark, folder), LC, 10), LC))


@query(_WITH + _epoch_sql(10, 7) + _EPOCHS + " SELECT source_id, epoch, round(flux, 6) AS flux, round(sigma, 6) AS sigma, n FROM t")
def epochs_min_len(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ep.epoch_table(ep.epochs(light_curves(spark, folder), LC, 10, 7), LC))


@query(_WITH + _epoch_sql(10, 7) + _EPOCHS + _SCORES + " SELECT source_id, n_epochs, round(zig, 6) AS zig, round(var, 6) AS var FROM sc")
def zig_var_scores(spark: SparkSession, folder: str) -> DataFrame:
    marked = ep.epochs(light_curves(spark, folder), LC, 10, 7)
    return rounded(ep.scores(ep.epoch_table(marked, LC), "source_id"))


@query(_PART + _epoch_sql(50, 0) + _EPOCHS + _SCORES + " SELECT source_id, CASE WHEN (zig > 0.8 AND var < 0.3) OR var < 0.1 THEN true END AS latent_flag FROM sc")
def latent_flag(spark: SparkSession, folder: str) -> DataFrame:
    marked = ep.epochs(light_curves(spark, folder, "l_partkey"), LC, 50)
    scored = ep.scores(ep.epoch_table(marked, LC), "source_id")
    return scored.select("source_id", ep.is_latent(F.col("zig"), F.col("var")).alias("latent_flag"))


@query(_MASKED + _epoch_sql(10, 7, "m") + _EPOCHS + _SCORES + """, b AS (SELECT source_id, max_by({'f': flux, 's': sigma}, {'f': flux, 'e': -epoch}) AS top FROM t GROUP BY 1),
 w AS (SELECT source_id, count(*) AS n_points, median(flux) AS mf, median(sig) AS ms FROM m GROUP BY 1)
SELECT w.source_id, n_points, n_epochs, round(zig, 6) AS zig, round(var, 6) AS var, round(top.f, 6) AS max_epoch_flux,
 NOT (n_points < 20 OR (zig > 0.8 AND var < 0.3) OR var < 0.1 OR abs(top.f - mf) < 8 * ms OR top.f / top.s < 5) AS transient FROM w JOIN b USING (source_id) JOIN sc USING (source_id)""")
def transient_rule(spark: SparkSession, folder: str) -> DataFrame:
    masked = light_curves(spark, folder).where(op.observation_mask(LC))
    return rounded(ep.transient_rule(masked, LC, rise=8))


@query(_WITH + """, s AS (SELECT source_id, count(*) AS n_points, quantile_cont(flux, 0.8) - quantile_cont(flux, 0.15) AS r, quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25) AS iqr, median(sig) AS ms, avg(flux) AS mf FROM lc GROUP BY 1)
SELECT source_id, n_points, round(r, 6) AS range65, round(iqr, 6) AS iqr, NOT (n_points < 120 OR r < 10.4 * ms OR (-2.5 * log10(mf / 309.54) < 8 AND iqr < 2 / (-2.5 * log10(mf / 309.54)))) AS variable FROM s""")
def periodic_rule(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ep.periodic_rule(light_curves(spark, folder), LC, spread=10.4))


@query(_WITH + f""", m AS (SELECT * FROM lc WHERE {MASK_SQL}), c AS (SELECT *, avg(flux) OVER (PARTITION BY source_id) AS mu, stddev_pop(flux) OVER (PARTITION BY source_id) AS sd FROM m),
 k AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS cnt FROM c WHERE abs(flux - mu) < 4 * sd), p AS (SELECT * FROM k WHERE cnt >= 20)""" + _epoch_sql(10, 7, "p") + _EPOCHS + _SCORES + """,
 b AS (SELECT source_id, max_by({'f': flux, 's': sigma}, {'f': flux, 'e': -epoch}) AS top FROM t GROUP BY 1), w AS (SELECT source_id, count(*) AS n_points, median(flux) AS mf, median(sig) AS ms FROM p GROUP BY 1),
 a AS (SELECT source_id, median(-2.5 * log10(flux / 309.54)) AS median_mag, quantile_cont(-2.5 * log10(flux / 309.54), 0.95) - quantile_cont(-2.5 * log10(flux / 309.54), 0.05) AS amplitude,
 (quantile_cont(flux, 0.9) - quantile_cont(flux, 0.1)) / median(sig) AS variability_snr FROM p GROUP BY 1)
SELECT source_id, w.n_points, round(zig, 6) AS zig, round(var, 6) AS var, round(median_mag, 6) AS median_mag, round(amplitude, 6) AS amplitude, round(variability_snr, 6) AS variability_snr,
 NOT (w.n_points < 20 OR (zig > 0.8 AND var < 0.3) OR var < 0.1 OR abs(top.f - mf) < 8 * ms OR top.f / top.s < 5) AS transient FROM w JOIN b USING (source_id) JOIN sc USING (source_id) JOIN a USING (source_id)""")
def variable_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: masked, clipped light curves, epochs and scores, the transient rule, and the catalog's statistics."""
    ready = op.prepare(light_curves(spark, folder), LC)
    rules = ep.transient_rule(ready, LC, rise=8).select("source_id", "n_points", "zig", "var", "transient")
    stats = op.amplitudes(ready, LC).drop("n_points")
    return rounded(rules.join(stats, "source_id"))


_RULES = f"""WITH v AS ({ORACLES["variable_catalog"]}), {lc_sql()}, m AS (SELECT * FROM lc WHERE {MASK_SQL}), c AS (SELECT *, avg(flux) OVER (PARTITION BY source_id) AS mu, stddev_pop(flux) OVER (PARTITION BY source_id) AS sd FROM m),
 k AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS cnt FROM c WHERE abs(flux - mu) < 4 * sd), p AS (SELECT * FROM k WHERE cnt >= 20),
 s AS (SELECT source_id, count(*) AS n, quantile_cont(flux, 0.8) - quantile_cont(flux, 0.15) AS r, quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25) AS iqr, median(sig) AS ms, -2.5 * log10(avg(flux) / 309.54) AS mag FROM p GROUP BY 1),
 f AS (SELECT s_suppkey AS source_id, s_suppkey % 3 AS kind, (s_suppkey % 10) / 10.0::DOUBLE AS confidence FROM supplier)"""


@query(_RULES + f""" SELECT f.source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, CASE kind WHEN 1 THEN 'transient' ELSE 'periodic' END AS type, confidence FROM f JOIN ({sky_sql("supplier", "s_suppkey")}) x ON x.s_suppkey = f.source_id
 LEFT JOIN v ON v.source_id = f.source_id LEFT JOIN s ON s.source_id = f.source_id WHERE kind IN (1, 2) AND confidence > 0.15 AND CASE WHEN kind = 1 THEN coalesce(transient, false) ELSE coalesce(NOT (n < 20 OR r < 10.4 * ms OR (mag < 8 AND iqr < 2 / mag)), false) END""")
def rule_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """From scores to the catalog: each class's rule on masked curves, centroids, types; scores here by arithmetic."""
    k = F.col("s_suppkey")
    scored = table(spark, folder, "supplier").select(k.alias("source_id"), (k % 3).cast("int").alias("class"), ((k % 10) / 10.0).alias("confidence"))
    places = positions(spark, folder, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "source_id")
    return rounded(ep.rule_catalog(light_curves(spark, folder), LC, scored, places, 0.15, {"rise": 8}, {"least": 20, "spread": 10.4}))


@query()
def scored_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The same with scores of a network over the curves, centred over all sources since its weights aren't trained; tests hold it against its parts."""
    from heliograph.operators import network
    from heliograph.plans.learning import curve_arrays

    scores = network.network_scores(curve_arrays(spark, folder), "source_id", ["flux", "sig", "mjd"], network.wave_network(), 3)
    with small_batches(spark, CURVES_AT_ONCE):  # written, since they are read twice: a small row for each source
        scores = materialise(scores, "scores")
    usual = scores.agg(*[F.avg(F.get("scores", k)).alias(f"m{k}") for k in range(3)], *[F.stddev_pop(F.get("scores", k)).alias(f"s{k}") for k in range(3)]).first()
    p = arrays.softmax(F.array(*[(F.get("scores", k) - usual[f"m{k}"]) / max(usual[f"s{k}"], 1e-12) for k in range(3)]))
    scored = scores.where("scores is not null").withColumn("p", p).select("source_id", arrays.argmax(F.col("p")).alias("class"), F.array_max("p").alias("confidence"))
    places = positions(spark, folder, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "source_id")
    return rounded(ep.rule_catalog(light_curves(spark, folder), LC, scored, places, 0.4, {"rise": 8}, {"least": 20, "spread": 10.4}))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
 w AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM w GROUP BY user_id, k""")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return ep.sessions(table(spark, folder, "events"), "user_id", "ts", "6 hours")


@query("WITH s AS (SELECT o_custkey, count(*) AS n, quantile_cont(o_totalprice, 0.9) AS q FROM orders GROUP BY 1) SELECT o_custkey, n, round(q, 6) AS q90 FROM s WHERE n > 6 AND (n > 12 OR q < 400000)")
def group_having(spark: SparkSession, folder: str) -> DataFrame:
    """Groups kept by their size, or by a quantile of theirs."""
    stats = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", F.lit(0.9)).alias("q90"))
    return rounded(stats.where((F.col("n") > 6) & ((F.col("n") > 12) | (F.col("q90") < 400000))))


@query(f"""WITH {EV_SQL}, l AS (SELECT user_id, list(CASE WHEN value > 20 THEN value ELSE 0 END ORDER BY t, event_id) AS a FROM ev GROUP BY 1),
 x AS (SELECT user_id, a, greatest(5, coalesce(list_max(list_transform(range(len(a)), lambda i: CASE WHEN a[i + 1] <> 0 THEN i + 1 ELSE 0 END)), 0)) AS keep FROM l)
SELECT user_id, CAST(least(keep, len(a)) AS BIGINT) AS trimmed, round(coalesce(a[40], 0), 6) AS fortieth, round(list_sum(a[1:40]), 4) AS padded_sum, CAST(40 AS BIGINT) AS padded, round(a[least(keep, len(a))], 6) AS last_value FROM x""")
def array_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays padded to one length, trimmed of trailing zeros, and with repeated elements."""
    nested = op.nest(events(spark, folder), EV, ["value"]).select("user_id", F.transform("obs", lambda o: F.when(o["value"] > 20, o["value"]).otherwise(0.0)).alias("a"))
    pad, cut = arrays.padded(F.col("a"), 40, F.lit(0.0)), arrays.trimmed(F.col("a"), 5)
    return nested.select(
        "user_id", F.size(cut).cast("long").alias("trimmed"), F.round(F.element_at(pad, 40), 6).alias("fortieth"), F.round(arrays.total(pad), 4).alias("padded_sum"), F.size(pad).cast("long").alias("padded"),
        F.round(F.element_at(arrays.repeated(cut, 3), -1), 6).alias("last_value"),
    )
