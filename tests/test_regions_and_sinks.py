"""Covers of regions, positional matches, in-place enrichment, streams that count once, drawn shapes, bucketed joins."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import healpix
from heliograph.operators import positional, synthetic
from heliograph.plans import registry
from heliograph.sources import tables
from heliograph.sources.scratch import has_path
from heliograph.streaming import monitor


@pytest.mark.parametrize("circle", [(10.0, 89.0, 3.0), (359.9, -41.0, 7.5), (45.0, 41.8, 0.01), (0.0, 0.0, 180.0), None])
def test_covers_miss_no_pixel(spark, circle):
    """Against the pixels of very many positions in the region: a circle, or the belt."""
    rng = np.random.default_rng(4)
    outside = healpix.from_circle(*circle) if circle else healpix.from_belt(6.0)
    ra, dec = rng.uniform(0, 360, 150_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 150_000)))
    if circle and circle[2] < 90:  # positions around a small circle's centre
        a, d, radius = circle
        t, r = rng.uniform(0, 2 * np.pi, 150_000), radius * np.sqrt(rng.uniform(0, 1, 150_000))
        dec = d + r * np.sin(t)
        ra = a + r * np.cos(t) / np.maximum(np.cos(np.radians(np.clip(dec, -89.9, 89.9))), 1e-3)
        ra, dec = np.mod(np.where(dec > 90, ra + 180, ra), 360), np.where(dec > 90, 180 - dec, dec)
    inside = outside(ra, dec) <= 0
    got = healpix.tree_cover(spark, outside, [3, 6]).toPandas()
    assert not got.duplicated().any()
    for order in (3, 6):
        cover = set(got[got["order"] == order]["pixel"])
        met = {healpix._python_pixel(a, d, order) for a, d in zip(ra[inside][:20_000], dec[inside][:20_000])}
        assert met <= cover
        # what is covered besides comes within a thin rim of the region
        far = outside(*healpix.centres(np.array(sorted(cover)), order)) > healpix.reach(order) + healpix.reach(9)
        assert not far.any()


def test_centres_of_arrays_equal_columns(spark):
    for order in (0, 1, 4):
        got = spark.range(12 << 2 * order).select("id", *[c.alias(n) for c, n in zip(healpix.centre(F.col("id"), order), ("ra", "dec"))]).orderBy("id").toPandas()
        ra, dec = healpix.centres(got["id"].to_numpy(), order)
        assert np.allclose(ra, got["ra"]) and np.allclose(dec, got["dec"])
    corner = max(abs(np.degrees(np.arccos(np.clip(np.sin(np.radians(d)) * np.sin(np.radians(e)) + np.cos(np.radians(d)) * np.cos(np.radians(e)) * np.cos(np.radians(a - b)), -1, 1)))) for a, d, b, e in _corners(2))
    assert corner <= healpix.reach(2) < 1.3 * corner


def _corners(order):
    """Centres of pixels with centres of the far corner pixels eight orders below."""
    deep = order + 8
    for pixel in range(12 << 2 * order):
        a, d = healpix.centres(np.array([pixel]), order)
        for ends in (0, (1 << 16) - 1, 0x5555, 0xAAAA):
            b, e = healpix.centres(np.array([pixel << 16 | ends]), deep)
            yield a[0], d[0], b[0], e[0]


def test_positions_match_over_files_and_lengths_are_checked(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("v"))
    rows.select("id").repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "a"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").select("v").write.parquet(str(tmp_path / "b"))
    rows.limit(999).select(F.col("v").alias("id")).write.parquet(str(tmp_path / "c"))
    a, b, c = (spark.read.parquet(str(tmp_path / n)) for n in "abc")
    got = positional.match_by_position(a, b).toPandas()
    assert len(got) == 1000 and (got["v"] == got["id"] * 7 % 1000).all() and (got["row"] == got["id"]).all()
    for left, right in ((a, c), (c, a)):
        with pytest.raises(Exception, match="different lengths"):
            positional.match_by_position(left, right).count()
    one = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert positional.full_one_to_one(one, one, "k").orderBy("k").collect()[1].asDict() == {"k": 2, "v": "y", "v_r": "y"}
    for bad in ([(1, "x")], [(1, "x"), (2, "y"), (2, "z")], [(1, "x"), (None, "y")], [(1, "x"), (3, "y")]):
        with pytest.raises(Exception, match="both sides once"):
            positional.full_one_to_one(one, spark.createDataFrame(bad, "k int, v string"), "k").count()


def test_enrichment_that_is_stopped_goes_on(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 5).alias("p")).write.partitionBy("p").parquet(path)
    calls = []

    def add(df):
        calls.append(sorted(r["p"] for r in df.select("p").distinct().collect()))
        if len(calls) == 2:
            return df.withColumn("twice", F.raise_error(F.lit("stopped")).cast("long"))
        return df.withColumn("twice", F.col("id") * 2)

    with pytest.raises(Exception, match="stopped"):
        tables.enrich_partitions(spark, path, "p", ["twice"], add, at_once=2)
    half = spark.read.option("mergeSchema", True).parquet(path)
    assert half.where("twice is not null").select("p").distinct().count() == 2 and half.count() == 100
    # a whole staged folder that wasn't put in place yet is, once
    spark.range(100).where("id % 5 = 2").select("id", (F.col("id") * 2).alias("twice"), F.lit(2).alias("p")).write.mode("overwrite").partitionBy("p").parquet(f"{path}.staged")
    assert tables.enrich_partitions(spark, path, "p", ["twice"], add, at_once=2) == 3
    assert tables.enrich_partitions(spark, path, "p", ["twice"], add) == 0
    got = spark.read.parquet(path).toPandas()
    assert len(got) == 100 and (got["twice"] == got["id"] * 2).all() and not has_path(spark, f"{path}.staged")
    assert calls == [[0, 1], [2, 3], [3, 4]]


def test_a_null_partition_is_enriched_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("p")).write.partitionBy("p").parquet(path)
    add = lambda df: df.withColumn("twice", F.col("id") * 2)
    assert tables.enrich_partitions(spark, path, "p", ["twice"], add, at_once=1) == 3 and tables.enrich_partitions(spark, path, "p", ["twice"], add) == 0
    got = spark.read.parquet(path).toPandas()
    assert len(got) == 20 and (got["twice"] == got["id"] * 2).all() and got["p"].isna().sum() == 7


def test_replayed_batches_count_once(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    write = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(log)
    read = lambda: monitor.log_sink(monitor.completion_stream(spark.readStream.schema("value string").text(log)), out, state, "complete").awaitTermination()
    write(["1_1_10_5_x", "2_1_20_6_x", "2_1_99_9_x", "3_0_7_0_x", "broken", "_1_1_1_1"])
    read()
    write(["1_1_10_5_x", "4_1_40_7_x"])  # part 1 again
    read()
    read()
    got = {r["status"]: (r["parts"], r["rows"]) for r in monitor.latest(spark, out, "status").collect()}
    assert got["1"][0] == 3 and got["1"][1] in (70, 149) and got["0"] == (1, 7)
    # a batch that is handed over again replaces itself
    batches = spark.read.parquet(out).select("batch").distinct().count()
    lines = spark.createDataFrame([("1", 3)], "status string, parts long")
    for _ in range(2):
        lines.write.mode("overwrite").parquet(f"{out}-again/batch=7")
    assert batches == 2 and spark.read.parquet(f"{out}-again").count() == 1


def test_drawn_shapes_follow_their_rules(spark):
    keys = spark.range(60).select(F.col("id").alias("k"))
    bursts = synthetic.bursts(keys, "k", 3)
    sizes = bursts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("attempt").alias("tries"), F.min("attempt").alias("attempt")).toPandas()
    assert len(sizes) == 60 and (sizes["n"] >= 40).all() and (sizes["tries"] == 1).all() and sizes["attempt"].max() > 0
    one = keys.where("k < 20").withColumn("attempt", F.lit(0))
    first = synthetic._burst(one, "k", F.lit(3)).groupBy("k").count().toPandas().set_index("k")["count"]
    for k, attempt in zip(sizes["k"], sizes["attempt"]):
        if k < 20:  # the first attempt is taken where it has the points, and only there
            assert (attempt == 0) == (first.get(k, 0) >= 40)
    again = synthetic.bursts(keys.repartition(5), "k", 3)
    assert bursts.exceptAll(again).isEmpty() and again.exceptAll(bursts).isEmpty()
    pulses, lobes = synthetic.pulses(keys, "k", 3).toPandas(), []
    for _, own in pulses.groupby("k"):
        grid = np.array(own["grid"].iloc[0])
        steps = np.diff(grid)
        lobes.append((np.diff(np.sign(steps[np.abs(steps) > 3e-3 * np.ptp(grid)])) != 0).sum())
        assert len(own) >= 40
        place = (len(grid) - 1) * np.mod(own["mjd"], own["period"]) / own["period"]
        away = (own["flux"] - np.interp(place, np.arange(len(grid)), grid)) / own["sig"]
        assert np.abs(away).max() < 6 and np.ptp(grid) >= 3 * own["sig"].iloc[0]
    assert set(map(int, lobes)) <= {1, 2, 3} and np.mean(np.array(lobes) >= 2) > 0.9  # a low peak may drown in a high one beside it


def test_bucketed_tables_join_without_an_exchange(spark, folder):
    df = registry.QUERIES["bucketed_join"](spark, folder)
    df.collect()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
