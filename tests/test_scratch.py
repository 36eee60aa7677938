"""What queries leave in the shared folder: the tables that their results still read, and nothing else."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import graph, periods
from heliograph.operators.lightcurve import Curve
from heliograph.plans.registry import QUERIES
from heliograph.sources.scratch import clear_scratch, shared_dir


def left(spark) -> list[str]:
    own = f"{shared_dir(spark).removeprefix('file:')}/heliograph-{spark.sparkContext.applicationId}"
    return sorted(re.sub("-[0-9a-f]{32}$", "", name) for name in os.listdir(own)) if os.path.isdir(own) else []


@pytest.mark.parametrize(("name", "held"), [
    ("dbscan", ["clusters", "core-points"]), ("dbscan_by_pixel", ["labels", "local-clusters"]), ("clustering_grid", ["densities", "matched"]), ("kmeans2_blend", ["two-means"]), ("mixture_ratio", ["mixture"]), ("boosted_classes", []), ("trained_classes", ["checkpoints"]),
    ("synthetic_shapes", ["attempts"]), ("morphology", ["shapes"]), ("period_search", []), ("size_packing", []),
])
def test_queries_leave_only_what_their_results_read(spark, folder, name, held):
    clear_scratch(spark)
    df = QUERIES[name](spark, folder)
    assert sorted(set(left(spark)) - {"forest-edges"}) == held
    df.collect()  # what is left is enough
    clear_scratch(spark)
    assert left(spark) == []


def test_large_cells_and_spread_sources_leave_nothing_more(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIR_POINTS", 0)
    monkeypatch.setattr(periods, "HOT_ROWS", 10)
    clear_scratch(spark)
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, float(50 + a / 3600), float(b / 3600)) for i, (a, b) in enumerate(rng.uniform(0, 3, (200, 2)))], "id int, ra double, dec double")
    graph.dbscan(points, 1.0, 5).collect()
    assert left(spark) == ["clusters", "core-points"]
    clear_scratch(spark)
    rows = spark.range(60).select(F.lit(1).alias("source_id"), (F.col("id") * 1.7).alias("mjd"), F.sin(F.col("id") * 1.0).alias("flux"))
    periods.search_peaks(rows, Curve(), np.arange(2.0, 30.0, 0.5), aliases=0.085).collect()
    assert left(spark) == ["periods"]
    clear_scratch(spark)
