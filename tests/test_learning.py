"""Networks and training against plain numpy loops; encoders on shapes they haven't seen."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliograph.operators import network, training
from heliograph.plans import learning
from heliograph.sources.tables import table


def loop_conv(x, w, b):
    out, left = np.zeros((w.shape[0], x.shape[1])), (w.shape[2] - 1) // 2
    for o in range(w.shape[0]):
        for n in range(x.shape[1]):
            out[o, n] = b[o] + sum(w[o, c, k] * x[c, n + k - left] for c in range(w.shape[1]) for k in range(w.shape[2]) if 0 <= n + k - left < x.shape[1])
    return out


def loop_wavelet(x, name):
    low = network.WAVELETS[name]
    high = [low[len(low) - 1 - k] * (-1) ** k for k in range(len(low))]
    x = [*x, x[-1]] if len(x) % 2 else list(x)
    at = lambda f, i: sum(f[k] * x[(2 * i + k) % len(x)] for k in range(len(low)))
    return [at(low, i) for i in range(len(x) // 2)], [at(high, i) for i in range(len(x) // 2)]


def loop_fourier(x, frequencies):
    n = len(x)
    return [abs(sum(v * np.exp(-2j * math.pi * f * (n - 1) * i / n) for i, v in enumerate(x))) / math.sqrt(n) for f in frequencies]


def loop_forward(curve, layers):
    x = curve
    for kind, *given in layers:
        if kind == "conv":
            x = loop_conv(x, *given)
        elif kind == "wavelet":
            both = [loop_wavelet(row, given[0]) for row in x]
            x = np.array([*curve, *(np.repeat(part, 2)[: curve.shape[1]] for k in (0, 1) for part in (b[k] for b in both))])
        elif kind == "fourier":
            x = np.array([loop_fourier(row, given[0]) for row in x])
        elif kind == "dense":
            x = np.array([sum(w * v for w, v in zip(row, x)) + b for row, b in zip(*given)])
        elif kind == "norm":
            x = (x - np.mean(x)) / math.sqrt(np.var(x) + 1e-5) * given[0] + given[1]
        else:
            x = {"relu": lambda v: np.maximum(v, 0), "asinh": np.arcsinh, "flatten": np.ravel}[kind](x)
    return x


def test_scores_equal_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(2)
    lengths = [1, 2, 7, 7, 30, 31, 0, 7]
    curves = [rng.normal(0, 3, (3, n)) for n in lengths]
    rows = [(i, *[c[k].tolist() for k in range(3)]) for i, c in enumerate(curves)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, c array<double>")
    layers = network.wave_network()
    for at_once in (500_000, 1):
        monkeypatch.setattr(network, "VALUES_AT_ONCE", at_once)
        got = {r["id"]: r["scores"] for r in network.network_scores(df.repartition(2), "id", ["a", "b", "c"], layers, 3).collect()}
        assert got[6] is None
        for i, c in enumerate(curves):
            if c.shape[1]:
                assert np.allclose(got[i], loop_forward(c, layers), atol=1e-9)
    odd = spark.createDataFrame([(1, [1.0, None], [1.0, 2.0], [0.0, 0.0])], df.schema)
    assert network.network_scores(odd, "id", ["a", "b", "c"], layers, 3).first()["scores"] == pytest.approx(list(loop_forward(np.array([[1.0, 0.0], [1.0, 2.0], [0.0, 0.0]]), layers)))
    with pytest.raises(Exception, match="different lengths"):
        network.network_scores(spark.createDataFrame([(1, [1.0], [1.0, 2.0], [0.0])], df.schema), "id", ["a", "b", "c"], layers, 3).collect()


@pytest.mark.parametrize("n", [1, 2, 9, 64])
def test_transforms_go_back(n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 5, (4, n))
    whole = np.arange(n) / max(n - 1, 1)
    back = network.fourier_inverse(network.fourier(x, whole), whole, n)
    assert np.abs(back - x).max() < 1e-9
    times = np.sort(rng.uniform(0, 1, (4, n)), 1)
    uneven = network.fourier(x, whole, times)
    want = [[sum(x[j, i] * np.exp(-2j * math.pi * f * (n - 1) / n * times[j, i] * (n - 1)) for i in range(n)) / math.sqrt(n) for f in whole] for j in range(4)]
    assert np.allclose(uneven, want, atol=1e-9)
    for name in network.WAVELETS:
        if n % 2 == 0:
            assert np.abs(network.wavelet_inverse(*network.wavelet(x, name), name) - x).max() < 1e-9


def test_training_equals_numpy_and_goes_on_from_a_checkpoint(spark, folder, tmp_path):
    rows = table(spark, folder, "embeddings")
    pdf = rows.toPandas()
    x, y = np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["label"].to_numpy()
    state, kept = training.train(rows.repartition(3), "embedding", "label", list(range(10)), 5, 6, folder=str(tmp_path), least_f1=0.0)
    w = np.array(training.fresh_state(training.size_of(64, 5, 10)).weights)
    m, v, rate, best, waited = np.zeros_like(w), np.zeros_like(w), 0.05, math.inf, 0
    for t in range(1, 7):  # one row after the other
        gradient, total = np.zeros_like(w), 0.0
        a, b, c, d = training.layers_of(w, 64, 5, 10)
        for row, label in zip(x, y):
            inner = row @ a + b
            z = np.maximum(inner, 0) @ c + d
            p = np.exp(z) / np.exp(z).sum()
            total -= math.log(p[label])
            p[label] -= 1
            back = (c @ p) * (inner > 0)
            gradient += np.concatenate((np.outer(row, back).ravel(), back, np.outer(np.maximum(inner, 0), p).ravel(), p))
        gradient /= len(y)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * 0.01 * w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        better = total / len(y) < best * (1 - 1e-4)
        best, waited = (total / len(y), 0) if better else (best, waited + 1)
        rate, waited = (rate / 2, 0) if waited > 2 else (rate, waited)
    assert np.allclose(state.weights, w, atol=1e-8) and state.rate == rate and abs(state.history[-1] - total / len(y)) < 1e-9
    assert 1 <= len(kept) <= 6
    three, _ = training.train(rows, "embedding", "label", list(range(10)), 5, 3)
    path = training.keep_checkpoint(spark, three, str(tmp_path))
    again, _ = training.train(rows, "embedding", "label", list(range(10)), 5, 3, training.load_checkpoint(spark, path))
    assert np.allclose(again.weights, state.weights, atol=1e-9) and again.step == 6


def test_the_rate_falls_on_a_plateau():
    state = training.fresh_state(3)
    for loss in (1.0, 0.9, 0.9, 0.9, 0.9):
        state = training.on_plateau(state, loss)
    assert state.rate == 0.025 and state.best_loss == 0.9
    assert training.macro_f1(np.array([[2, 0], [0, 2]])) == 1 and training.macro_f1(np.zeros((2, 2))) == 0


def test_odd_rows_are_left_out_of_training(spark):
    schema = "embedding array<double>, label int"
    rows = [([1.0, 2.0], 0), ([0.5, 1.0], 1), (None, 1), ([1.0, None], 1), ([1.0, 1.0], None), ([1.0, 1.0], 7)]
    some = training.train(spark.createDataFrame(rows, schema), "embedding", "label", [0, 1], 2, 2)[0]
    few = training.train(spark.createDataFrame(rows[:2], schema), "embedding", "label", [0, 1], 2, 2)[0]
    assert np.allclose(some.weights, few.weights)
    assert training.train(spark.createDataFrame([], schema), "embedding", "label", [0, 1], 2, 2)[0].weights == []


def test_encoder_tells_unseen_shapes_better_than_the_mean(spark):
    at = "/root/testdata/sf0.01"
    shapes = learning._shapes(spark, at).cache()
    fit, rest = shapes.where("source_id % 2 = 0"), shapes.where("source_id % 2 = 1")
    mean, directions = training.low_rank(fit, "level", 4)
    x = np.stack(fit.toPandas()["level"].to_numpy())
    assert np.allclose(mean, x.mean(0)) and np.allclose(directions @ directions.T, np.eye(4), atol=1e-8)
    top = np.linalg.svd(x - x.mean(0))[2][:4]
    assert np.allclose(np.abs(np.sum(top * directions, 1)), 1, atol=1e-6)
    held = training.encode(rest, "level", mean, directions).toPandas()
    y = np.stack(held["level"].to_numpy()) - mean
    code = np.stack(held["code"].to_numpy())
    assert np.allclose(code, y @ directions.T) and np.allclose(held["code_error"], ((y - code @ directions) ** 2).mean(1), atol=1e-9)
    assert held["code_error"].mean() < (y**2).mean()
    assert learning.network_scores(spark, at).agg(F.count("confidence")).first()[0] == learning.curve_arrays(spark, at).count()


def test_a_batch_of_curves_is_stacked_in_shares():
    """Whole copies of a batch, and of all its stacks, made the workers' memory grow with it."""
    rng = np.random.default_rng(3)
    values, cuts = rng.normal(size=1_000_000), np.arange(0, 1_000_001, 500, dtype=np.int32)
    columns = [pa.ListArray.from_arrays(cuts, values) for _ in range(3)]
    tracemalloc.start()
    seen = 0
    for places, curves in network._stacked(columns):
        assert curves.size <= network.VALUES_AT_ONCE and np.array_equal(curves[0, 0], values[cuts[places[0]] : cuts[places[0] + 1]])
        seen += len(places)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2000 and most < 30_000_000  # the columns hold 24 MB, copied twice before


def test_scored_catalog_runs_its_network_once_in_small_batches(spark, monkeypatch):
    from heliograph.plans import curves

    written = []
    monkeypatch.setattr(curves, "materialise", lambda df, name, real=curves.materialise: written.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or real(df, name))
    got = curves.scored_catalog(spark, "/root/testdata/sf0.001")
    assert written == [("scores", "200")] and "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
