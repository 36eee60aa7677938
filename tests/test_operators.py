"""Operators against numpy and brute force on small inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliograph.functions import arrays, geo, healpix, ids
from heliograph.operators import catalog, epochs, evaluation, features, graph, joins, lightcurve, periods, synthetic
from heliograph.operators.lightcurve import Curve
from heliograph.plans import registry
from heliograph.sources import tables
from heliograph.streaming import monitor

C = Curve(ties=("tie",))


def curve(spark, rows):
    return spark.createDataFrame([(s, float(t), float(f), 1.0, i) for i, (s, t, f) in enumerate(rows)], "source_id long, mjd double, flux double, sig double, tie long")


def test_known_pixels(spark):
    rows = spark.createDataFrame([(266.417, -29.008, 7207), (83.82, -5.39, 5359)], "ra double, dec double, want long")
    assert all(r["p"] == r["want"] for r in rows.withColumn("p", healpix.pixel(F.col("ra"), F.col("dec"), 5)).collect())
    assert healpix.circle_cover(270, 66.54, 0.212, 5) == [2559, 2901, 3839, 4010]


def test_pixels_nest(spark):
    rows = spark.range(3000).select((F.col("id") * 137.5 % 360).alias("ra"), F.degrees(F.asin(2 * F.col("id") / 3000 - 1)).alias("dec"))
    fine, coarse = healpix.pixel(F.col("ra"), F.col("dec"), 13), healpix.pixel(F.col("ra"), F.col("dec"), 5)
    assert rows.where(healpix.parent(fine, 13, 5) != coarse).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 359.9999), st.floats(-90, 90))
def test_pixel_of_a_position_is_in_range(ra, dec):
    assert 0 <= healpix._python_pixel(ra, dec, 5) < 12288
    assert healpix._python_pixel(ra, dec, 13) >> 16 == healpix._python_pixel(ra, dec, 5)


def test_identifier_round_trip(spark):
    rows = spark.createDataFrame([(0.0, 90.0), (359.9999, -90.0), (12.3456, -0.5), (180.0, 45.1234)], "ra double, dec double")
    made = rows.withColumn("s", ids.encode(F.lit(12287), F.col("ra"), F.col("dec")))
    a, d = ids.position_of(F.col("s"))
    for r in made.select("ra", "dec", a.alias("a"), d.alias("d"), ids.partition_of(F.col("s")).alias("p")).collect():
        assert (r["a"], r["d"], r["p"]) == pytest.approx((r["ra"], r["dec"], 12287), abs=1e-4)


def test_designation_carries(spark):
    got = spark.range(1).select(ids.designation(F.lit(359.99999), F.lit(-12.5)).alias("x"), ids.designation(F.lit(15.0), F.lit(0.0)).alias("y")).first()
    assert (got["x"], got["y"]) == ("J000000.00-123000.0", "J010000.00+000000.0")


def test_array_statistics_match_numpy(spark):
    rng = np.random.default_rng(1)
    lists = [rng.normal(size=n).tolist() for n in (1, 2, 5, 16)]
    rows = spark.createDataFrame([(x,) for x in lists], "a array<double>").select(arrays.median(F.col("a")).alias("m"), arrays.quantile(F.col("a"), 0.15).alias("q"), arrays.absolute_deviation(F.col("a")).alias("d"), arrays.argmax(F.col("a")).alias("x")).collect()
    for r, x in zip(rows, lists):
        assert (r["m"], r["q"], r["d"]) == pytest.approx((np.median(x), np.quantile(x, 0.15), np.median(np.abs(x - np.median(x)))))
        assert r["x"] == int(np.argmax(x))


def test_constant_curve_loses_all_rows_when_clipped(spark):
    assert lightcurve.clip(curve(spark, [(1, t, 5) for t in range(9)]), C).count() == 0


def test_quality_filter_drops_null_flags(spark):
    rows = spark.createDataFrame([(1, 10.0, 1.0, 0), (2, 10.0, 1.0, None), (3, 10.0, 1.0, 1), (4, 10.0, None, 0), (5, 10.0, 1.0, 512)], "id int, f double, s double, b long")
    assert [r["id"] for r in lightcurve.quality_filter(rows, [("f", "s", "b")]).orderBy("id").collect()] == [1, 5]


@pytest.mark.parametrize(("after", "wanted"), [(7, 1), (8, 2)])
def test_epoch_needs_more_than_seven_rows(spark, after, wanted):
    rows = [(1, t * 0.1, 1) for t in range(5)] + [(1, 50 + t * 0.1, 2) for t in range(after)]
    assert epochs.epochs(curve(spark, rows), C, 10, 7).select("epoch").distinct().count() == wanted


def test_scores_of_one_epoch_and_of_alternation(spark):
    rows = [(1, t, 1) for t in range(3)] + [(2, 100 * k + t, 10 if k % 2 else 1) for k in range(6) for t in range(3)]
    table = epochs.epoch_table(epochs.epochs(curve(spark, rows), C), C)
    got = {r["source_id"]: (r["zig"], r["var"]) for r in epochs.scores(table, "source_id").collect()}
    assert got == {1: (0.0, 1.0), 2: (1.0, 0.0)}


@pytest.mark.parametrize("n", [9, 20, 35, 52])
def test_moving_average_is_a_same_convolution(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    rows = periods.moving_average(curve(spark, [(1, t, v) for t, v in enumerate(y)]), ["source_id"], ["mjd"], "flux").orderBy("mjd").collect()
    w = int(n * 0.1)
    want = np.convolve(y, np.ones(w) / w, "same") if w else [None] * n
    assert [r["smooth"] for r in rows] == (pytest.approx(want) if w else want)


def test_periodograms_find_a_sine(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 300, 200))
    rows = curve(spark, [(1, x, 10 + np.sin(2 * np.pi * x / 7.3)) for x in t])
    trials = [3.1, 5.9, 7.3, 11.0]
    best = lambda g: max(g.collect(), key=lambda r: r["sig"])["period"]
    assert best(periods.aov(rows, C, trials)) == best(periods.lomb_scargle(rows, C, trials)) == best(periods.plavchan(rows, C, trials)) == 7.3
    assert min(periods.conditional_entropy(rows, C, trials).collect(), key=lambda r: r["sig"])["period"] == 7.3
    found = periods.top_peaks(periods.search(rows, C, np.arange(5, 30, 0.01)), "source_id").first()
    assert found["peak1"] == pytest.approx(7.3, rel=0.01)
    assert abs(found["peak2"] - found["peak1"]) > 0.1 * found["peak1"]


def test_numpy_and_sql_periodograms_agree(spark):
    rng = np.random.default_rng(3)
    rows = curve(spark, [(1, x, y) for x, y in zip(rng.uniform(0, 900, 80), rng.normal(size=80))])
    trials = [4.0, 9.5, 33.0, 170.0]
    numpy_ = {r["period"]: r["sig"] for r in periods.search(rows, C, np.array(trials)).collect()}
    for r in periods.aov(rows, C, trials).where("period < 15").collect():
        assert numpy_[r["period"]] == pytest.approx(r["sig"])
    for r in periods.lomb_scargle(rows, C, trials).where("period >= 15").collect():
        assert numpy_[r["period"]] == pytest.approx(r["sig"] * (1.7 + 0.75 * math.log10(r["period"] / 15)))


def test_aliases_are_excised_inside_any_band(spark):
    grid = spark.createDataFrame([(1, p, 1.0) for p in (10.0, 20.0, 32.0, 54.0, 61.0)], "k long, period double, sig double")
    got = periods.excise_aliases(grid, spark.createDataFrame([(1, 10.0, None)], "k long, short double, long double"), "k")
    assert {r["period"] for r in got.where("sig > 0").collect()} == {54.0, 61.0}


def test_radius_join_crosses_the_pole_and_the_wrap(spark):
    rng = np.random.default_rng(5)
    ra = np.concatenate([rng.uniform(-0.001, 0.001, 60) % 360, rng.uniform(0, 360, 60)])
    dec = np.concatenate([rng.uniform(-0.001, 0.001, 60), 90 - rng.uniform(0, 0.001, 60)])
    df = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "id int, ra double, dec double")
    got = {(r["a"], r["b"]) for r in joins.within_radius(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), 1.5, ("a", "ra", "dec"), ("b", "ra", "dec")).collect()}
    v = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], 1)
    chord = 2 * math.sin(math.radians(1.5 / 3600) / 2)
    want = {(i, j) for i in range(120) for j in range(120) if ((v[i] - v[j]) ** 2).sum() <= chord**2}
    assert got == want


def brute_dbscan(x, eps, least):
    near = [[j for j in range(len(x)) if abs(x[i] - x[j]) <= eps] for i in range(len(x))]
    core = [len(n) >= least for n in near]
    label = list(range(len(x)))
    for _ in x:
        for i in range(len(x)):
            for j in near[i]:
                if core[i] and core[j]:
                    label[i] = label[j] = min(label[i], label[j])
    out = {i: label[i] for i in range(len(x)) if core[i]}
    return out | {i: min(label[j] for j in near[i] if core[j]) for i in range(len(x)) if not core[i] and any(core[j] for j in near[i])}


def test_dbscan_matches_brute_force(spark):
    r = random.Random(2)
    x = [r.choice([0, 20, 21, 60]) + r.uniform(0, 6) for _ in range(70)]  # arc seconds along a circle
    df = spark.createDataFrame([(i, v / 3600, 0.0) for i, v in enumerate(x)], "id long, ra double, dec double")
    got = {r_["id"]: r_["cluster"] for r_ in graph.dbscan(df, 0.85, 5).collect()}
    assert got == brute_dbscan(x, 0.85, 5)
    named = graph.name_clusters(graph.dbscan(df, 0.85, 5, 3), df)
    assert named.select("source").distinct().count() == len({c for c in got.values() if list(got.values()).count(c) >= 3})


def test_first_present_mixes_rows(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 5, None), (1, 3, 6, "y")], "k int, o int, a int, b string")
    assert joins.first_present(df, ["k"], [F.col("o")], ["a", "b"]).collect()[0][1:] == (5, "x")


def test_one_to_one_join_rejects_repeated_keys(spark):
    left, right = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, v int")
    with pytest.raises(Exception, match="repeated"):
        joins.left_one_to_one(left, right, "k").collect()


def test_purity_keeps_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None), (1, 9.0, "ew", 0.99, 2.0, 12.0), (0, 4.5, "sn", 0.99, 2.0, 12.0), (0, 4.5, "ew", 0.99, 2.0, 12.0)], "b int, s double, t string, c double, p double, m double")
    assert [r["k"] for r in df.select(catalog.pure(*(F.col(c) for c in "bstcpm")).alias("k")).collect()] == [True, False, True, False]


def test_two_means_match_numpy(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, 40), rng.normal(20, 1, 40)])
    y = rng.normal(0, 1, 80)
    got = evaluation.two_means(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k int, x double, y double"), "k", "x", "y").first()
    d = math.hypot(x[:40].mean() - x[40:].mean(), y[:40].mean() - y[40:].mean())
    q = lambda v: np.quantile(v, 0.9) - np.quantile(v, 0.1)
    assert got["blend_ratio"] == pytest.approx(d / math.hypot(q(x), q(y)))


def test_gaussian_chi2_matches_erf(spark):
    y = np.sort(np.random.default_rng(4).normal(size=30))
    z = (y - y.mean()) / y.std()
    want = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    got = features.gaussian_chi2(curve(spark, [(1, t, v) for t, v in enumerate(y)]), C).first()["gaussian_chi2"]
    assert got == pytest.approx((((np.arange(30) + 1) / 30 - want) ** 2 / want).sum())


def test_group_split_keeps_groups_whole(spark, folder):
    rows = registry.QUERIES["group_split"](spark, folder).groupBy("user_id").agg(F.countDistinct("split").alias("n"))
    assert rows.where("n > 1").count() == 0


def test_score_hook_is_a_softmax(spark, folder):
    got = registry.QUERIES["score_hook"](spark, folder).orderBy("vec_id").toPandas()
    e = np.stack(tables.table(spark, folder, "embeddings").orderBy("vec_id").toPandas()["embedding"])
    z = np.exp(e @ np.cos(np.arange(192)).reshape(64, 3))
    assert np.allclose(got["confidence"], (z / z.sum(1, keepdims=True)).max(1), atol=1e-5)


def test_synthetic_classes_separate(spark):
    keys = spark.range(40).withColumnRenamed("id", "source_id")
    rows = synthetic.light_curves(keys, "source_id")
    assert rows.count() == rows.distinct().count()
    spread = {r["kind"]: r["s"] for r in rows.groupBy("kind").agg(F.stddev("flux").alias("s")).collect()}
    assert spread["quiet"] < 1.2 < min(v for k, v in spread.items() if k != "quiet")


def test_empty_tables(spark):
    none = curve(spark, [])
    assert lightcurve.prepare(none.withColumns({"chi": F.lit(1.0), "qual": F.lit(1)}), C).count() == 0
    assert epochs.transient_rule(none, C).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_partitioned_round_trip_and_lookup(spark, tmp_path):
    source = (7207 << 48) | 5
    rows = spark.createDataFrame([(source, 1.0), ((3 << 48) | 9, 2.0)], "source_id long, flux double")
    tables.write_partitioned(rows, str(tmp_path / "lc"))
    back = tables.union_of_roots(spark, [str(tmp_path / "lc")])
    found = tables.lookup(back, source)
    assert [r["flux"] for r in found.collect()] == [1.0]
    assert "PartitionFilters: [isnotnull(partition" in found._jdf.queryExecution().toString()
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "source_id long, flux double").count() == 2
    with pytest.raises(ValueError):
        tables.enrich(spark, "a", "a", lambda d: d)


def test_progress_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("5_done_100_90_2.5\n6_failed_50_0_1.5\nbroken\n")
    out = monitor.progress(monitor.parse_progress(spark.read.text(str(tmp_path / "log"))), 300).first()
    assert (out["done"], out["share"], out["rate"], out["seconds_left"]) == (150, 0.5, 37.5, 4.0)
    query = monitor.progress_stream(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["status"]: r["rows"] for r in spark.table("progress").collect()}["done"] == 100


def test_session_stream_equals_batch(spark, folder, tmp_path):
    events = tables.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = monitor.session_stream(spark, str(tmp_path / "events"), events.schema, "user_id", "ts", "6 hours", "1 minute")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    final = {tuple(r) for r in spark.table("sessions").collect()}
    batch = {tuple(r) for r in epochs.sessions(events, "user_id", "ts", "6 hours").collect()}
    assert final and final <= batch


def test_pixel_backend_equals_the_join_backend(spark, folder):
    as_sets = lambda df: {frozenset(r["id"] for r in g) for g in __import__("itertools").groupby(sorted(df.collect(), key=lambda r: r["cluster"]), key=lambda r: r["cluster"]) for g in [list(g[1])]}
    one, two = registry.QUERIES["dbscan"](spark, folder), registry.QUERIES["dbscan_by_pixel"](spark, folder)
    assert as_sets(one) == as_sets(two) and one.count() > 0


@pytest.mark.parametrize("name", ["dbscan", "dbscan_by_pixel"])
def test_clustering_takes_the_events_of_all_users(spark, name):
    events = tables.table(spark, "/root/testdata/sf0.01", "events").toPandas()
    got = {r["id"] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    wanted = set()
    for user, own in events.groupby("user_id"):  # a user's events lie on a strip of their own, so steps in one dimension do
        along = (own["value"] / 2000 * 3600).to_numpy() * np.cos(np.radians(user % 40 - 20 + user // 40 * 0.02))
        near = np.abs(along[:, None] - along[None, :]) <= 3.0
        wanted |= set(own["event_id"][near[:, near.sum(1) >= 3].any(1)])
    assert got == wanted and events["user_id"][events["event_id"].isin(got)].max() >= 40


@pytest.mark.parametrize("most", [10**6, 40, 0])
def test_large_cells_are_compared_by_parts(spark, monkeypatch, most):
    """Dense cells whose extents don't decide: rings and diagonals that miss each other or touch in one point, and repeated points."""
    monkeypatch.setattr(graph, "PAIR_POINTS", most)
    rng = np.random.default_rng(11)
    t = rng.uniform(0, 1, 60)
    shapes = [(0.2 * t, 0.2 * t), (0.2 * t + 0.62, 0.2 * t - 0.62), (0.2 * t + 3, 0.2 * (1 - t)), (0.2 * t + 3.7, 0.2 * (1 - t) + 0.7), (np.full(30, 6.0), np.full(30, 0.0)), (np.full(30, 6.99), np.full(30, 0.0)), (np.full(30, 9.0), np.full(30, 0.0)), (np.full(30, 10.01), np.full(30, 0.0))]
    x = np.concatenate([np.stack(s_, 1) for s_ in shapes])
    df = spark.createDataFrame([(i, float(50 + a / 3600), float(b / 3600)) for i, (a, b) in enumerate(x)], "id int, ra double, dec double")
    got = {r["id"]: r["cluster"] for r in graph.dbscan(df, 1.0, 5).collect()}
    assert got == brute_dbscan([complex(a, b) for a, b in x], 1.0, 5)


@pytest.mark.parametrize("rows", [10**6, 50])
def test_pixels_join_long_clusters_and_cut_crowded_pixels(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "PIXEL_ROWS", rows)
    chain = [(i, 40.0 + i * 2.0 / 3600, 1.0) for i in range(6000)]  # 12,000 arc seconds over several pixels
    alone = [(9000 + i, 40.0 + i * 2.0 / 3600, 2.0) for i in range(5)] + [(9100, 200.0, 70.0)]
    points = spark.createDataFrame(chain + alone, "id long, ra double, dec double")
    for margin in (0.0, 25.0):
        got = {r["id"]: r["cluster"] for r in graph.dbscan_by_pixel(points, 3.0, 3, margin_arcsec=margin).collect()}
        assert got == {i: 1 for i in range(6000)} | {9000 + i: 9001 for i in range(5)}  # named by the first core point


def test_halo_holds_all_near_points(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))))] + [(1000, 0.001, 89.999), (1001, 180.0, -89.999)]
    points = spark.createDataFrame(rows, "id int, ra double, dec double")
    halo = graph.with_halo(points, 1800.0, 4)
    assert halo.where("owner").count() == len(rows)
    found = {(r["id"], r["pixel"]) for r in halo.collect()}
    near = joins.within_radius(points.withColumnRenamed("id", "a"), points.withColumnRenamed("id", "b"), 900.0, ("a", "ra", "dec"), ("b", "ra", "dec")).collect()
    home = {i: healpix._python_pixel(a, d, 4) for i, a, d in rows}
    assert all((r["a"], home[r["b"]]) in found for r in near)


def test_mixture_tells_two_groups_from_one(spark):
    rng = np.random.default_rng(7)
    rows = [(1, float(v)) for v in np.concatenate([rng.normal(0, 1, 80), rng.normal(12, 1, 80)])] + [(2, float(v)) for v in rng.normal(0, 1, 160)]
    got = {r["k"]: r["ratio"] for r in features.mixture_ratio(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()}
    v = np.array([x for k, x in rows if k == 1])
    normal = lambda m, s: np.exp(-((v - m) ** 2) / (2 * s)) / np.sqrt(2 * np.pi * s)
    a, b = v[:80], v[80:]
    best = np.log(0.5 * normal(a.mean(), a.var()) + 0.5 * normal(b.mean(), b.var())).mean() - np.log(normal(v.mean(), v.var())).mean()
    assert got[1] == pytest.approx(best, abs=0.01) and abs(got[2]) < 0.1


def test_threshold_of_one_feature(spark):
    rows = spark.createDataFrame([(float(i), float(i > 30)) for i in range(100)], "x double, y double")
    assert 30 <= evaluation.threshold(rows, "x", "y") <= 31


def test_prefer_double_and_one_class(spark):
    got = spark.createDataFrame([(3.0,), (5.0,), (None,)], "p double").select(periods.prefer_double(F.col("p")).alias("d")).collect()
    assert [r["d"] for r in got] == [6.0, 5.0, None]
    m = evaluation.confusion(spark.createDataFrame([(1, 1), (None, 1)], "t int, p int"), "t", "p")
    assert evaluation.summary_scores(m).first()["macro_f1"] == 1.0


def test_pixels_neighbours_centres_and_rings(spark):
    for order in (0, 2, 4):
        count = 12 << 2 * order
        n = F.col("id")
        rows = {r["id"]: r for r in spark.range(count).select("id", healpix.neighbours(n, order).alias("n"), *[c.alias(k) for c, k in zip(healpix.centre(n, order), ("ra", "dec"))], healpix.to_ring(n, order).alias("ring")).collect()}
        assert all(healpix._python_pixel(r["ra"], r["dec"], order) == i for i, r in rows.items())
        by_ring = sorted(rows.values(), key=lambda r: r["ring"])
        assert [r["ring"] for r in by_ring] == list(range(count)) and all(a["dec"] > b["dec"] - 1e-9 for a, b in zip(by_ring, by_ring[1:]))
        assert all(i in rows[k]["n"] for i, r in rows.items() for k in r["n"] if k >= 0)
        rng = np.random.default_rng(order)
        for _ in range(1000 if order else 0):
            a, d, turn = rng.uniform(0, 360), float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), rng.uniform(0, 2 * np.pi)
            here = healpix._python_pixel(a, d, order)
            there = healpix._python_pixel(a + 1e-3 * np.cos(turn) / max(1e-3, np.cos(np.radians(d))), max(-90.0, min(90.0, d + 1e-3 * np.sin(turn))), order)
            assert here == there or there in rows[here]["n"]
    belt = {r["pixel"] for r in healpix.belt_cover(spark, 5.0, 3).collect()}
    assert healpix._python_pixel(266.4, -29.0, 3) in belt and healpix._python_pixel(192.86, 27.13, 3) not in belt


@pytest.mark.parametrize("hot", [10**6, 100])
def test_peaks_of_spread_sources_equal_those_of_the_periodogram(spark, monkeypatch, hot):
    monkeypatch.setattr(periods, "HOT_ROWS", hot)
    monkeypatch.setattr(periods, "SPREAD_PERIODS", 150)
    rng = np.random.default_rng(3)
    rows = [(s, float(t), float(10 + np.sin(2 * np.pi * t / p) + 0.1 * rng.normal()), i) for s, p in ((1, 7.3), (2, 61.7)) for i, t in enumerate(rng.uniform(0, 900, 250))]
    rows += [(3, 1.0, 2.0, 0), (4, None, 2.0, 0)]
    df = spark.createDataFrame(rows, "source_id int, mjd double, flux double, tie int")
    grid = np.concatenate([np.arange(2, 15, 0.05), np.arange(15, 100, 0.5)])
    got = {r["source_id"]: r for r in periods.search_peaks(df, C, grid).collect()}
    assert set(got) == {1, 2, 3} and abs(got[1]["peak1"] - 7.3) < 0.03 and abs(got[2]["peak1"] - 61.7) < 0.6 and got[2]["best_long_period"] == got[2]["peak1"]
    coarse = {r["source_id"]: r for r in periods.top_peaks(periods.search(df.where("mjd is not null"), C, grid), "source_id").collect()}
    for s in (1, 2):
        assert got[s]["peak1_sig"] >= coarse[s]["peak1_sig"] - 1e-9 and abs(got[s]["peak1"] - coarse[s]["peak1"]) <= 0.5
    assert 250_000 < len(periods.trial_grid()) < 251_500


@pytest.mark.parametrize("hot", [10**6, 100])
def test_search_without_aliases_and_with_doubles(spark, monkeypatch, hot):
    """Against the same rules on the whole periodogram; spread sources and others agree."""
    monkeypatch.setattr(periods, "HOT_WORK", 240 * hot)
    monkeypatch.setattr(periods, "SPREAD_PERIODS", 90)
    rng = np.random.default_rng(6)
    times = np.concatenate([season * 180 + np.arange(25) * 1.5 + rng.uniform(0, 0.3, 25) for season in range(10)])
    shapes = {1: lambda t: np.sin(2 * np.pi * t / 3.1), 2: lambda t: np.sin(2 * np.pi * t / 37.0), 3: lambda t: np.sin(2 * np.pi * t / 1.52)}
    rows = [(s, float(t), float(10 + f(t) + 0.1 * rng.normal()), i) for s, f in shapes.items() for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "source_id int, mjd double, flux double, tie int")
    grid = np.concatenate([np.arange(1.2, 15, 0.1), np.arange(15, 200, 1.8)])
    got = {r["source_id"]: r for r in periods.search_peaks(df, C, grid, aliases=0.085, double_up_to=4.0).collect()}
    unrefined = {r["source_id"]: r for r in periods.search_peaks(df, C, grid, steps=0, aliases=0.085, double_up_to=4.0).collect()}
    plain = {r["source_id"]: r for r in periods.search_peaks(df, C, grid).collect()}
    own = {s: g.sort_values("period") for s, g in periods.search(df, C, grid).toPandas().groupby("source_id")}
    for s, rest in own.items():
        gaps = np.diff(np.unique(times))
        bad = [r * np.median(g) for g in (gaps[gaps < 50], gaps[gaps > 50]) for r in periods.ALIAS_RATIOS]
        period, sig = rest["period"].to_numpy(), rest["sig"].to_numpy().copy()
        sig[[any(abs(p - b) <= 0.085 * b for b in bad) for p in period]] = 0
        best = period[sig.argmax()]
        if best <= 4:
            sig[np.abs(period - 2 * best).argmin()] *= 2
        top = period[sig.argmax()]
        assert abs(unrefined[s]["peak1"] - top) < 1e-9 and abs(unrefined[s]["peak1_sig"] - sig.max()) < 1e-6 * sig.max() and all(abs(got[s]["peak1"] - b) > 0.085 * b for b in bad)
    assert any(abs(plain[s]["peak1"] - got[s]["peak1"]) > 0.1 for s in own)


def test_packing_of_one_large_key(spark):
    rows = [("a", i, 7 + i % 5) for i in range(2000)] + [("b", i, 9) for i in range(5)] + [(None, 3, 4), ("a", None, 6)]
    got = catalog.packed(spark.createDataFrame(rows, "k string, i int, n int"), ["k"], ["i"], F.col("n"), 100).collect()
    assert len(got) == len(rows)
    total = 6
    want = {None: 0}
    for _, i, n in rows[:2000]:
        want[i] = total // 100
        total += n
    assert {r["i"]: r["file"] for r in got if r["k"] == "a"} == want


def test_phase_shape_matches_numpy(spark):
    rng = np.random.default_rng(5)
    t, y = rng.uniform(0, 40, 60), rng.normal(0, 1, 60)
    rows = [(1, float(a), float(b)) for a, b in zip(t, y)] + [(2, 1.0, 3.0), (2, 2.0, None), (3, None, 1.0)]
    c = lightcurve.Curve(key="k", time="t", flux="y", ties=())
    got = {r["k"]: r for r in periods.phase_shape(spark.createDataFrame(rows, "k int, t double, y double").withColumn("p", F.lit(7.0)), c, "p", 8, 0.25).collect()}
    phase, want = (t % 7) / 7, np.zeros((8, 2))
    for i in range(8):
        inside = y[(phase >= (i - 0.25) / 8) & (phase < (i + 1.25) / 8)]
        if len(inside) >= 2:
            want[i] = np.median(inside), inside.var() / y.var()
    want = (want - want.min(0)) / (want.max(0) - want.min(0))
    assert np.allclose(got[1]["level"], want[:, 0]) and np.allclose(got[1]["spread"], want[:, 1])
    assert got[2]["level"] == [None] * 8 and set(got) == {1, 2}


def test_array_shapes(spark):
    rows = [(1, [1.0, 0.0, 2.0, 0.0, None]), (2, []), (3, None), (4, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "k int, a array<double>")
    a = F.col("a")
    got = {r["k"]: r for r in d.select("k", arrays.padded(a, 3, F.lit(9.0)).alias("p"), arrays.trimmed(a, 1).alias("t"), arrays.repeated(a, 2).alias("r")).collect()}
    assert got[1]["p"] == [1, 0, 2] and got[1]["t"] == [1, 0, 2] and got[1]["r"] == [1, 1, 0, 0, 2, 2, 0, 0, None, None]
    assert got[2]["p"] == [9, 9, 9] and got[2]["t"] == [] and got[2]["r"] == []
    assert got[3]["p"] is None and got[3]["t"] is None and got[3]["r"] is None
    assert got[4]["p"] == [0, 0, 9] and got[4]["t"] == [0]


def test_synthetic_noise_follows_its_rules(spark):
    raw = synthetic.light_curves(spark.range(200).withColumnRenamed("id", "source_id"), "source_id")
    sparse = synthetic.sparse_nulls(raw, "source_id")
    counts = lambda d: {r["source_id"]: (r["kind"], r["n"], r["last"]) for r in d.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("mjd").alias("last")).collect()}
    full, kept = counts(raw), counts(sparse)
    cut = [k for k in full if kept[k][1] < full[k][1]]
    assert all(full[k][0] == "quiet" and 20 <= kept[k][1] < 80 for k in cut) and 5 < len(cut) < 40 and set(kept) == set(full)
    rows = synthetic.augmented(sparse, "source_id").toPandas()
    assert len(rows) == synthetic.augmented(sparse.repartition(7), "source_id").count()
    for key, one in rows.groupby("source_id"):
        n = kept[key][1]
        assert min(n, 40) <= len(one) <= n and (n < 60 or len(one) <= 0.96 * n + 1)
        assert one["outlier"].sum() <= 5 and abs(one["flux"].median()) < 1e-9 and one["mjd"].min() == 0 and one["mjd"].max() < 1
        spread = np.sinh(one["flux"])
        assert math.isclose(np.quantile(spread, 0.75) - np.quantile(spread, 0.25), 1, abs_tol=1e-6)
    assert 100 < rows["outlier"].sum() < 600
    assert synthetic.augmented(sparse.limit(0), "source_id").count() == 0


def test_full_features_move_rows_no_oftener_than_needed(spark, folder):
    """Each statistic had a shuffle of its own, and each quantile a table of a source's values."""
    plan = registry.QUERIES["full_features"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.split("\n")) <= 4
    assert plan.count("percentile(") <= 5
