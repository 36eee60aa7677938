"""Bounds of many sources at once, and the peaks settled from them, against each source's whole periodogram."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import periodogram, periods
from heliograph.operators.lightcurve import Curve
from heliograph.plans.adapters import LC, light_curves
from heliograph.plans.registry import QUERIES

GRID = np.concatenate([np.arange(0.1, 4, 0.005), np.arange(4, 15, 0.01), np.arange(15, 100, 0.05), np.arange(100, 900, 1.0)])


def sources(whole: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(5)
    every = np.arange(3.0, 700) if whole else rng.uniform(0, 700, 90)
    out = []
    for k in range(12):
        t = rng.choice(every, 70)
        out.append((t, [rng.normal(0, 1, 70), np.sin(2 * np.pi * t / 7.3) + rng.normal(0, 0.1, 70), 50 + np.sin(2 * np.pi * t / 81.0), 1e5 + rng.normal(0, 1e-3, 70)][k % 4]))
    return [*out, (np.array([5.0]), np.array([2.0])), (every[:9], np.full(9, 0.1)), (np.full(20, every[3]), np.arange(20.0)), (every[:2], np.array([1.0, 3.0]))]


@pytest.mark.parametrize("whole", [True, False])
def test_bins_follow_their_rule(whole):
    rng = np.random.default_rng(1)
    t = np.arange(1.0, 900) if whole else rng.uniform(50_000, 60_000, 300)
    p = np.concatenate([GRID[::7], [0.25, 0.5, 1, 2, 2.5, 12]])
    want = np.floor((t[None, :] % p[:, None]) / p[:, None] * 12).astype(int).clip(0, 11)
    assert (periodogram.cells(t, p, 12) == want).all()


@pytest.mark.parametrize("whole", [True, False])
def test_bounds_are_above_and_peaks_are_the_same(monkeypatch, whole):
    monkeypatch.setattr(periodogram, "shared_is_faster", lambda *a: True)
    many = sources(whole)
    bounds = periods._bounds([t for t, _ in many], [y for _, y in many], GRID, 12, 15.0)
    tight = []
    for (t, y), bound in zip(many, bounds):
        sig = periods._statistics(t, y - y.mean(), GRID, 12, 15.0)
        most = np.maximum.reduceat(sig, np.arange(0, len(GRID), periodogram.BLOCK))
        assert (bound >= most).all()
        tight.append(np.median(bound - most) < 1e-3)
        fine = periods._fine(GRID, periods._chosen(GRID, sig, 3, 0.1, 50.0), 20)
        again = periods._statistics(t, y - y.mean(), fine, 12, 15.0)
        want = periods._peak_row(np.concatenate((GRID, fine)), np.concatenate((sig, again)), 3, 0.1, 50.0)
        got = periods._settled(t, y, GRID, bound, 3, 0.1, 20, 50.0, 12, 15.0)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert sum(tight) >= 12


def test_together_or_alone(spark, monkeypatch):
    """Many sources in a task, null keys and times included, give the rows of a source at a time."""
    rows = [(k + 2**60, float(t), float(y)) for k, (t_, y_) in enumerate(sources(True) * 4) for t, y in zip(t_, y_)]
    rows += [(None, 1.0, 2.0), (None, 2.0, 5.0), (7, None, 1.0)]
    df = spark.createDataFrame(rows, "source_id long, mjd double, flux double").coalesce(1)
    key = lambda r: (r["source_id"] is None, r["source_id"])
    got = []
    for least in (1000, 10**9):
        monkeypatch.setattr(periods, "TOGETHER", least)
        got.append(sorted(periods.search_peaks(df, Curve(), GRID).collect(), key=key))
    assert len(got[0]) == 65 and got[0][-1]["source_id"] is None
    for a, b in zip(*got):
        assert a["source_id"] == b["source_id"] and list(a)[1:] == pytest.approx(list(b)[1:], rel=1e-9, abs=1e-12)


def test_search_runs_all_trial_periods(spark, folder):
    """The steps were a hundred times as wide."""
    got = {r["source_id"]: r for r in QUERIES["period_search"](spark, folder).where("source_id < 2").collect()}
    grid = periods.trial_grid()
    own = light_curves(spark, folder).where(F.col("source_id") == 1).select(LC.time, LC.flux).toPandas().dropna()
    t, y = own[LC.time].to_numpy(), own[LC.flux].to_numpy()
    sig = periods._statistics(t, y - y.mean(), grid, 12, 15.0)
    assert len(got) == 2 and got[1]["peak1_sig"] >= round(sig.max(), 4) and abs(got[1]["peak1"] - grid[sig.argmax()]) < 0.01 * grid[sig.argmax()]
