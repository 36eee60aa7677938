"""From scores to the catalog, random turns of phase bins, and rounds that end by themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import epochs, evaluation, features, lightcurve, synthetic
from heliograph.plans.adapters import LC, light_curves
from heliograph.plans.registry import QUERIES

AT = "/root/testdata/sf0.01"


def test_rule_catalog_equals_its_parts(spark):
    rows = light_curves(spark, AT)
    keys = rows.select("source_id").distinct()
    k = F.col("source_id")
    scored = keys.select("source_id", (k % 4).cast("int").alias("class"), ((k % 7) / 7).alias("confidence"))
    places = keys.crossJoin(spark.createDataFrame([(0.0,), (0.002,)], "d double")).select("source_id", F.pmod(k * 3.6, F.lit(360.0)).alias("ra"), (k % 50 + F.col("d")).alias("dec"))
    got = {r["source_id"]: r for r in epochs.rule_catalog(rows, LC, scored, places, 0.1, {"rise": 8}, {"least": 20, "spread": 10.4}).collect()}
    ready = lightcurve.prepare(rows, LC)
    one = {r["source_id"] for r in epochs.transient_rule(ready, LC, rise=8).where("transient").collect()}
    two = {r["source_id"] for r in epochs.periodic_rule(ready, LC, least=20, spread=10.4).where("variable").collect()}
    classes = {r["source_id"]: r["class"] for r in scored.where("confidence > 0.1").collect()}
    assert set(got) == {s for s, c in classes.items() if (c == 1 and s in one) or (c == 2 and s in two)} and len(got) > 5
    for s, r in got.items():
        assert r["type"] == {1: "transient", 2: "periodic"}[classes[s]] and r["dec"] == pytest.approx(s % 50 + 0.001, abs=1e-6) and r["ra"] == pytest.approx(s * 3.6 % 360, abs=1e-6)


def test_scored_catalog_keeps_confirmed_sources(spark):
    got = QUERIES["scored_catalog"](spark, AT).toPandas()
    assert 0 < len(got) < 100 and got["type"].isin(["transient", "periodic"]).all() and (got["confidence"] > 0.4).all() and got["source_id"].is_unique


def test_turned_bins_follow_their_draws(spark):
    rows = spark.range(400).select("id", F.array(*[F.lit(float(v)) for v in (1, 2, 5)]).alias("level"))
    got = synthetic.turned(rows, "id", seed=4).toPandas()
    for r in got.itertuples():
        want = np.array([1.0, 2.0, 5.0]) + r.shift
        want = -want if r.negated else want
        assert np.allclose(r.level, want[::-1] if r.flipped else want)
    assert 0.3 < got["flipped"].mean() < 0.5 and 0.3 < got["negated"].mean() < 0.5 and got["shift"].between(0, 1).all()
    assert synthetic.turned(rows.repartition(7), "id", seed=4).exceptAll(synthetic.turned(rows, "id", seed=4)).isEmpty()


def test_rounds_end_when_nothing_moves(spark, monkeypatch):
    written = []
    for module in (evaluation, features):
        monkeypatch.setattr(module, "materialise", lambda df, name, real=module.materialise: written.append(name) or real(df, name))
    rows = spark.createDataFrame([(1, float(v), 0.0) for v in (0, 1, 2, 50, 51, 52)] + [(2, 3.0, 3.0)], "k int, x double, y double")
    got = {r["k"]: r for r in evaluation.two_means(rows, "k", "x", "y").collect()}
    assert got[1]["inertia"] == pytest.approx(4.0) and got[2]["inertia"] == 0.0 and written.count("two-means") <= 5
    features.mixture_ratio(rows, "k", "x", rounds=50).collect()
    assert written.count("mixture") < 50
