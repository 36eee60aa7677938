"""Counts, first and nearest partners within a radius against brute force, and that nothing exploded is broadcast."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from heliograph.operators import joins, reach
from heliograph.plans import registry


@pytest.fixture(scope="module")
def skies():
    rng = np.random.default_rng(5)

    def some(n: int, first: int) -> pd.DataFrame:
        near = np.stack([10 + rng.normal(0, 0.2, n), -5 + rng.normal(0, 0.2, n)], 1)
        pole = np.stack([rng.uniform(0, 360, n // 4), 90 - rng.exponential(0.3, n // 4)], 1)
        edge = np.stack([rng.uniform(-0.3, 0.3, n // 4) % 360, rng.uniform(-0.3, 0.3, n // 4)], 1)
        at = np.concatenate((near, pole, edge, near[:20]))
        return pd.DataFrame({"id": np.arange(first, first + len(at)), "ra": at[:, 0], "dec": at[:, 1], "price": rng.integers(0, 50, len(at)).astype(float)})

    one, two = some(300, 0), some(400, 10_000)
    apart = reach.haversine(one.ra.to_numpy()[:, None], one.dec.to_numpy()[:, None], two.ra.to_numpy()[None], two.dec.to_numpy()[None])
    return one, two, apart


@pytest.mark.parametrize("rows", [50_000, 37])
def test_partners_against_brute_force(spark, skies, monkeypatch, rows):
    monkeypatch.setattr(reach, "UNIT_ROWS", rows)
    one, two, apart = skies
    left, right = spark.createDataFrame(one).withColumnRenamed("id", "a"), spark.createDataFrame(two).withColumnRenamed("id", "b")
    on = (("a", "ra", "dec"), ("b", "ra", "dec"))
    near = apart <= 900
    counted = joins.radius_count(left.select("a", "ra", "dec"), right, 900, *on).toPandas().set_index("a")["n_in_radius"]
    assert counted.sort_index().tolist() == near.sum(1).tolist()
    best = joins.best_within(left, right, 900, *on, "price", ["price"]).toPandas().set_index("a")["price"].to_dict()
    assert best == {k: two.price[n].min() for k, n in enumerate(near) if n.any()}
    found = reach.nearest(left, right, 900, *on).toPandas().set_index("a")
    assert sorted(found.index) == [k for k, n in enumerate(near) if n.any()]
    assert found["b"].to_dict() == {k: 10_000 + int(apart[k].argmin()) for k in found.index}


def test_work_follows_points(skies, monkeypatch):
    """Points of which all reach each other are settled without a comparison."""
    v = np.array([[1.0, 0, 0]]) + np.random.default_rng(1).normal(0, 1e-6, (4000, 3))
    monkeypatch.setattr(reach, "_leaf_pairs", lambda one, two, a, b: iter(()) if not len(a) else pytest.fail("compared"))
    assert (reach.count_near(v, v, 0.01) == 4000).all()


@pytest.mark.parametrize("name", ["eps_neighbours", "radius_join", "radius_count", "synthetic_features"])
def test_nothing_exploded_is_broadcast(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan.split("Initial Plan")[0]


def test_equal_differences_are_equal_distances():
    """Points in a row at equal steps: the order of ids decides between neighbours on both sides, whatever vectors' rounding says."""
    ra = 9.0 + np.arange(41) / 2048
    dec = np.full(41, -19.0)
    left, right = (reach.haversine(ra[1:-1], dec[1:-1], ra[k], dec[k]) for k in (slice(0, -2), slice(2, None)))
    assert (left == right).all()


def test_border_rings_in_numpy(spark):
    """Arrays and expressions give the same pixels and neighbours."""
    from pyspark.sql import functions as F

    from heliograph.functions import healpix

    rng = np.random.default_rng(2)
    ra, dec = rng.uniform(0, 360, 400), np.degrees(np.arcsin(rng.uniform(-1, 1, 400)))
    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(400), "ra": ra, "dec": dec})).withColumn("p", healpix.pixel(F.col("ra"), F.col("dec"), 6))
    got = rows.withColumn("n", healpix.neighbours(F.col("p"), 6)).orderBy("k").collect()
    mine = healpix.pixels(ra, dec, 6)
    assert [r["p"] for r in got] == mine.tolist() and [r["n"] for r in got] == healpix.neighbour_pixels(mine, 6).tolist()


def test_augmented_curves_are_not_broadcast(spark, folder):
    """Joins with a curve's statistics broadcast whole curves, and drew each curve anew for each of them."""
    plan = registry.QUERIES["synthetic_augmented"](spark, folder)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Broadcast" not in plan and plan.count("Scan parquet") == 1


@pytest.mark.parametrize("arcsec", [1500.0, 40_000.0, 400_000.0])
def test_a_side_is_repeated_into_few_cells(spark, arcsec):
    """All 27 neighbours took a row each; the pairs are those of brute force."""
    rng = np.random.default_rng(9)
    ra, dec = rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))
    ra[:60], dec[:60] = 180 + rng.normal(0, 0.5, 60), rng.normal(0, 0.5, 60)
    rows = spark.createDataFrame(pd.DataFrame({"a": np.arange(300), "ra": ra, "dec": dec}))
    v = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], 1)
    want = ((v[:, None] - v[None]) ** 2).sum(2) <= reach.chord_of(arcsec) ** 2
    got = joins.within_radius(rows, rows.withColumnRenamed("a", "b"), arcsec, ("a", "ra", "dec"), ("b", "ra", "dec")).select("a", "b").toPandas()
    assert len(got) == want.sum() and want[got["a"], got["b"]].all() and not got.duplicated().any()
    assert joins._cells(rows, "ra", "dec", reach.chord_of(arcsec), True).count() <= 8 * 300
