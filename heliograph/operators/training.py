"""Training by rounds of gradients that Spark adds up: AdamW, a rate that falls on a plateau, checkpoints above a score.

Every task computes the loss and gradient of its rows with the present weights, a table of the model's size; the sums of
all tasks make one step on the driver. Weights, moments and rate are the whole state: each kept checkpoint is a row of
JSON in a folder that all share, and a run that starts from it goes on as the first would have.

Defined cases: rows with a null label, a label that is no class, or null features are left out; no rows leave the weights
as they are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class State:
    """Everything that a further step needs, as plain numbers."""

    weights: list[float]
    first: list[float]
    second: list[float]
    step: int = 0
    rate: float = 0.05
    best_loss: float = float("inf")
    waited: int = 0
    history: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> State:
        return cls(**json.loads(text))


def fresh_state(size: int, rate: float = 0.05, seed: int = 1) -> State:
    return State(np.random.default_rng(seed).normal(0, 0.1, size).tolist(), [0.0] * size, [0.0] * size, rate=rate)


def layers_of(weights: Sequence[float], inputs: int, hidden: int, classes: int) -> tuple[np.ndarray, ...]:
    """Weights and offsets of the hidden and the last layer."""
    w = np.asarray(weights, float)
    parts = np.split(w, np.cumsum([inputs * hidden, hidden, hidden * classes]))
    return parts[0].reshape(inputs, hidden), parts[1], parts[2].reshape(hidden, classes), parts[3]


def size_of(inputs: int, hidden: int, classes: int) -> int:
    return inputs * hidden + hidden + hidden * classes + classes


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: Sequence[float], hidden: int, classes: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed cross entropy of a network with one hidden layer, its gradient, and the predicted classes."""
    a, b, c, d = layers_of(weights, x.shape[1], hidden, classes)
    inner = x @ a + b
    held = np.maximum(inner, 0)
    z = held @ c + d
    z = z - z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    away = p.copy()
    away[np.arange(len(y)), y] -= 1
    back = (away @ c.T) * (inner > 0)
    return float(loss), np.concatenate([(x.T @ back).ravel(), back.sum(0), (held.T @ away).ravel(), away.sum(0)]), p.argmax(1)


def macro_f1(counts: np.ndarray) -> float:
    """Mean F1 over classes of a table (truth, prediction); 0 for a class that neither has nor gets rows."""
    hits, has, gets = np.diag(counts), counts.sum(1), counts.sum(0)
    return float((2 * hits / np.maximum(has + gets, 1)).mean())


def adamw(state: State, gradient: np.ndarray, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> State:
    """One step; the decay is of the weights themselves, not of the gradient."""
    w, m, v = (np.array(x) for x in (state.weights, state.first, state.second))
    step = state.step + 1
    m = betas[0] * m + (1 - betas[0]) * gradient
    v = betas[1] * v + (1 - betas[1]) * gradient * gradient
    w = w * (1 - state.rate * decay) - state.rate * (m / (1 - betas[0] ** step)) / (np.sqrt(v / (1 - betas[1] ** step)) + eps)
    return State(w.tolist(), m.tolist(), v.tolist(), step, state.rate, state.best_loss, state.waited, state.history)


def on_plateau(state: State, loss: float, factor: float = 0.5, patience: int = 2, least: float = 1e-4) -> State:
    """The rate times ``factor`` once more than ``patience`` losses in a row haven't been below the best by ``least`` of it."""
    better = loss < state.best_loss * (1 - least)
    best, waited = (loss, 0) if better else (state.best_loss, state.waited + 1)
    rate, waited = (state.rate * factor, 0) if waited > patience else (state.rate, waited)
    return State(state.weights, state.first, state.second, state.step, rate, best, waited, [*state.history, loss])


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _summed(rows: DataFrame, state: State, hidden: int, classes: int) -> tuple[float, np.ndarray, int, np.ndarray]:
    """Loss, gradient, rows and the table of truth and prediction over all rows."""
    weights, size = state.weights, len(state.weights)

    def run(batches):
        total = np.zeros(size + 2 + classes * classes)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                y = batch.column("y").to_numpy()
                loss, gradient, guess = loss_and_gradient(x, y, weights, hidden, classes)
                total[:size] += gradient
                total[size : size + 2] += loss, len(y)
                total[size + 2 :] += np.bincount(y * classes + guess, minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    got = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(size + 2 + classes * classes)
    total[got["place"]] = got["value"]
    return total[size], total[:size], int(total[size + 1]), total[size + 2 :].reshape(classes, classes)


def keep_checkpoint(spark: SparkSession, state: State, folder: str) -> str:
    path = f"{folder}/step-{state.step:06d}"
    spark.createDataFrame([(state.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_checkpoint(spark: SparkSession, path: str) -> State:
    return State.from_json(spark.read.text(path, wholetext=True).first()[0].rstrip("\n"))


def train(df: DataFrame, features: str, label: str, classes: Sequence, hidden: int, rounds: int, state: State | None = None, rate: float = 0.05, decay: float = 0.01, folder: str | None = None, least_f1: float = 0.6) -> tuple[State, list[str]]:
    """``rounds`` steps of a network with one hidden layer on the array column ``features``; the last state and the checkpoints kept.

    A checkpoint is kept in ``folder`` after each step whose macro F1, over all rows and with the weights before the step,
    was ``least_f1`` or more and above all before it. ``state`` starts from a checkpoint.
    """
    number = F.coalesce(*[F.when(F.col(label) == c, k) for k, c in enumerate(classes)]).cast("int")
    rows = df.select(F.col(features).cast("array<double>").alias("x"), number.alias("y")).where("x is not null and y is not null and not exists(x, v -> v is null)")
    some = rows.select(F.size("x").alias("n")).first()
    if some is None:
        return state or State([], [], [], rate=rate), []
    state = state or fresh_state(size_of(some["n"], hidden, len(classes)), rate)
    kept, best = [], least_f1
    for _ in range(rounds):
        loss, gradient, n, table = _summed(rows, state, hidden, len(classes))
        state = on_plateau(adamw(state, gradient / n, decay), loss / n)
        if folder and macro_f1(table) >= best:
            best = np.nextafter(macro_f1(table), 2)
            kept.append(keep_checkpoint(df.sparkSession, state, folder))
    return state, kept


def predict(df: DataFrame, key: str, features: str, state: State, classes: Sequence[str], hidden: int) -> DataFrame:
    """(key, predicted, confidence) of each row with features; the weights are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(np.array(state.weights))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b, c, d = layers_of(shared.value, len(batch.column("x")[0]), hidden, len(classes))
                z = np.maximum(_matrix(batch.column("x")) @ a + b, 0) @ c + d
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([classes[k] for k in p.argmax(1)], pa.string()), pa.array(p.max(1))], [key, "predicted", "confidence"])

    rows = df.select(key, F.col(features).cast("array<double>").alias("x")).where("x is not null and not exists(x, v -> v is null)")
    return rows.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, predicted string, confidence double")


def low_rank(df: DataFrame, features: str, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading directions of an array column, from sums of products that tasks add up: an encoder of ``rank`` numbers."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                one = np.concatenate((np.ones((len(x), 1)), x), 1)
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    rows = df.select(F.col(features).cast("array<double>").alias("x")).where("x is not null and not exists(x, v -> v is null)")
    got = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")
    sums = got["value"].to_numpy().reshape(round(len(got) ** 0.5), -1)
    mean = sums[0, 1:] / sums[0, 0]
    _, directions = np.linalg.eigh(sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean))
    directions = directions[:, ::-1][:, :rank].T
    return mean, directions * np.sign(directions[np.arange(rank), np.abs(directions).argmax(1)])[:, None]


def encode(df: DataFrame, features: str, mean: np.ndarray, directions: np.ndarray, name: str = "code") -> DataFrame:
    """Add ``name``, the numbers of an array along the directions, and ``{name}_error``, the mean squared error of what they give back: column expressions."""
    centred = F.transform(F.col(features), lambda v, i: v - F.get(F.lit(mean.tolist()), i))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    code = F.array(*[dot(F.col("_centred"), F.lit(d.tolist())) for d in directions])
    out = df.withColumn("_centred", centred).withColumn(name, code)
    squares = dot(F.col("_centred"), F.col("_centred")) - dot(F.col(name), F.col(name))  # directions are orthonormal
    return out.withColumn(f"{name}_error", F.greatest(F.lit(0.0), squares) / F.size("_centred")).drop("_centred")
