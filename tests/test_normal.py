"""The normal integral against the standard library."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from heliograph.operators import features


def test_normal_integral(spark):
    values = [k / 8 for k in range(-80, 81)] + [None, float("nan")]
    got = spark.createDataFrame([(v,) for v in values], "z double").select("z", features.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        if r["z"] is None or r["z"] != r["z"]:
            assert r["p"] is None
        else:
            assert math.isclose(r["p"], 0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel_tol=1e-6, abs_tol=1e-15)
