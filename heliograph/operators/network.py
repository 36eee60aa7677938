"""Forward passes over curves of any length: convolutions, wavelets, Fourier transforms, dense layers, weights handed in.

A network is a list of layers, each a tuple of a name and its arrays; it is broadcast once and applied in one Arrow stage,
without a shuffle. Curves of a batch are laid side by side by length, so that a result never depends on which curves
happen to share a batch, and nothing is padded.

Layers take (curves, channels, length) up to ``flatten``, and (curves, numbers) from there on:
``("conv", weight[out, in, width], bias)`` keeps the length, ``("relu",)``, ``("asinh",)``, ``("wavelet", name)`` puts the
input's channels before the approximations and details of the present ones (each value twice, cut to the length),
``("fourier", frequencies)`` lengths of the coefficients, ``("flatten",)``, ``("dense", weight[out, in], bias)``,
``("norm", scale, shift)`` of each curve's numbers.

Defined cases: a null array, or arrays of a curve that differ in length, raise an error; a null within an array is 0; an empty
curve has null results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Low-pass filters of orthogonal wavelets.
WAVELETS = {"haar": np.array([1, 1]) / math.sqrt(2), "db2": np.array([1 + math.sqrt(3), 3 + math.sqrt(3), 3 - math.sqrt(3), 1 - math.sqrt(3)]) / (4 * math.sqrt(2))}


def convolved(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Correlation of (curves, in, n) with (out, in, width), zeros beyond the ends; of an even width the longer side is on the right."""
    width = weight.shape[2]
    ends = ((width - 1) // 2, width - 1 - (width - 1) // 2)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), ends)), width, axis=2)
    return np.einsum("bcnk,ock->bon", windows, weight, optimize=True) + bias[:, None]


def wavelet(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Approximations and details of one level along the last axis, the curve taken as a circle; an odd length repeats its last value."""
    low = WAVELETS[name]
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    if x.shape[-1] % 2:
        x = np.concatenate((x, x[..., -1:]), -1)
    at = (np.arange(0, x.shape[-1], 2)[:, None] + np.arange(len(low))) % x.shape[-1]
    return x[..., at] @ low, x[..., at] @ high


def wavelet_inverse(approximations: np.ndarray, details: np.ndarray, name: str) -> np.ndarray:
    low = WAVELETS[name]
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    n = 2 * approximations.shape[-1]
    out = np.zeros((*approximations.shape[:-1], n))
    for k in range(len(low)):
        out[..., (np.arange(0, n, 2) + k) % n] += approximations * low[k] + details * high[k]
    return out


def fourier_matrix(frequencies: np.ndarray, n: int, times: np.ndarray | None = None) -> np.ndarray:
    """Rows exp(-2 pi i f t) / sqrt(n), with frequencies and ``times`` in shares of n - 1; without times the places 0 to n - 1."""
    at = np.arange(n) if times is None else np.asarray(times) * (n - 1)
    return np.exp(-2j * np.pi * (np.asarray(frequencies) * (n - 1) / n)[:, None] * at[..., None, :]) / math.sqrt(n)


def fourier(x: np.ndarray, frequencies: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of (..., n) at the given frequencies; ``times`` (..., n) for an uneven sampling."""
    return np.einsum("...fn,...n->...f", fourier_matrix(frequencies, x.shape[-1], times), x)


def fourier_inverse(coefficients: np.ndarray, frequencies: np.ndarray, n: int) -> np.ndarray:
    """The curve of ``n`` values with these coefficients; exact if the frequencies are the n whole ones, k / (n - 1)."""
    return np.einsum("fn,...f->...n", fourier_matrix(frequencies, n).conj(), coefficients)


def forward(curves: np.ndarray, layers: Sequence[tuple]) -> np.ndarray:
    """Results of a network for curves (curves, channels, length)."""
    x = curves
    for kind, *given in layers:
        if kind == "conv":
            x = convolved(x, *given)
        elif kind == "dense":
            x = x @ given[0].T + given[1]
        elif kind == "relu":
            x = np.maximum(x, 0)
        elif kind == "asinh":
            x = np.arcsinh(x)
        elif kind == "wavelet":
            both = np.concatenate(wavelet(x, given[0]), 1)
            x = np.concatenate((curves, both.repeat(2, -1)[..., : curves.shape[-1]]), 1)
        elif kind == "fourier":
            x = np.abs(fourier(x, given[0]))
        elif kind == "flatten":
            x = x.reshape(len(x), -1)
        elif kind == "norm":
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * given[0] + given[1]
        else:
            raise ValueError(f"no layer {kind}")
    return x


#: Values of curves that a forward pass takes at a time, at most; a longer curve goes alone.
VALUES_AT_ONCE = 500_000


def _stacked(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of curves, values (curves, channels, length)) of a batch, by length, one forward pass's share at a time."""
    offsets = [c.offsets.to_numpy() for c in columns]
    lengths = np.diff(offsets[0])
    if any(c.null_count for c in columns) or any(not np.array_equal(np.diff(o), lengths) for o in offsets[1:]):
        raise ValueError("a null array, or arrays of different lengths")
    values = [c.values.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        step = max(1, VALUES_AT_ONCE // max(1, int(n) * len(columns)))
        for lo in range(0, len(rows) if n else 0, step):
            own = rows[lo : lo + step]
            yield own, np.nan_to_num(np.stack([v[o[own][:, None] + np.arange(n)] for v, o in zip(values, offsets)], 1))


def network_scores(df: DataFrame, key: str, channels: Sequence[str], layers: Sequence[tuple], results: int, name: str = "scores") -> DataFrame:
    """(key, scores): ``results`` numbers of the network for each row's arrays ``channels``."""
    shared = df.sparkSession.sparkContext.broadcast(list(layers))

    def run(batches):
        for batch in batches:
            out = np.full((batch.num_rows, results), np.nan)
            for rows, curves in _stacked([batch.column(c) for c in channels]):
                out[rows] = forward(curves, shared.value)
            lists = pa.array([None if np.isnan(r).all() else r.tolist() for r in out], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, name])

    return df.select(key, *channels).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, `{name}` array<double>")


def wave_network(samples: int = 16, results: int = 3, width: int = 4) -> list[tuple]:
    """A small network of all kinds of layers with weights from a formula, where no trained ones are at hand."""

    def weights(*shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        return np.cos(np.arange(n) * 1.7 + len(shape)).reshape(shape) / math.sqrt(n / shape[0])

    return [
        ("conv", weights(width, 3, 5), weights(width)), ("relu",), ("conv", weights(2, width, 3), weights(2)), ("wavelet", "db2"), ("conv", weights(width, 7, 3), weights(width)), ("relu",),
        ("fourier", np.linspace(0, 1, samples)), ("asinh",), ("conv", weights(1, width, 3), weights(1)), ("relu",), ("flatten",), ("dense", weights(samples // 2, samples), weights(samples // 2)), ("relu",), ("norm", np.ones(samples // 2), np.zeros(samples // 2)), ("dense", weights(results, samples // 2), weights(results)),
    ]
