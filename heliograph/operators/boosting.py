"""Gradient boosting of trees for several classes, with softmax margins.

Features become bins at quantile cuts once. A tree grows level by level: every task adds the gradients and curvatures of
its rows up by class, node, feature and bin, a table of fixed size whatever the number of rows; Spark sums those tables,
and the driver picks each node's best split. A round fits one tree for each class to the same margins; its table of rows
with new margins is written to the shared folder, and the one before it deleted. Fitted trees are one SQL expression over
the feature columns, so that applying them needs no Python, no shuffle and no broadcast.

Defined cases: a null or NaN feature counts as less than all values. Rows with a null label, or one that is no class, are left
out of the fit. A class without rows keeps its prior. No rows give a model whose margins are all 0.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import arrays
from heliograph.sources.scratch import discard, materialise


@dataclass
class Boosted:
    """Classes, features, prior margins, cuts by feature, and for each round a tree for each class.

    A tree is a leaf's value, or (feature, cut, tree up to the cut, tree beyond it).
    """

    classes: list[str]
    features: list[str]
    priors: list[float]
    cuts: list[list[float]]
    trees: list[list] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        return cls(**json.loads(text))

    def margins(self) -> list[Column]:
        """A margin for each class as one expression over the feature columns."""

        def written(tree) -> str:
            if not isinstance(tree, (list, tuple)):
                return f"{float(tree)!r}D"
            feature, cut, low, high = tree
            name = "`" + self.features[feature].replace("`", "``") + "`"
            return f"CASE WHEN coalesce(nanvl({name}, double('-inf')), double('-inf')) <= {float(cut)!r}D THEN {written(low)} ELSE {written(high)} END"

        return [F.expr(" + ".join([f"{float(prior)!r}D", *(written(round_[k]) for round_ in self.trees)])) for k, prior in enumerate(self.priors)]


def _binned(df: DataFrame, features: Sequence[str], cuts: list[list[float]], label: Column, classes: int, priors: list[float]) -> DataFrame:
    """(bins, label, margins): bins as small integers in one binary value, a feature's bin the number of cuts below it."""
    bounds = [np.array(c) for c in cuts]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            bins = np.zeros((n, len(features)), np.uint8)
            for k, name in enumerate(features):
                values = np.array(batch.column(name).cast(pa.float64()).to_pandas(), float)
                bins[:, k] = np.searchsorted(bounds[k], np.where(np.isnan(values), -np.inf, values), "left")
            margins = np.tile(np.array(priors, np.float64), (n, 1))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("_label"), pa.array([r.tobytes() for r in margins], pa.binary())], ["bins", "label", "margins"])

    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], label.alias("_label")).where(F.col("_label").between(0, classes - 1))
    return rows.mapInArrow(run, "bins binary, label int, margins binary")


def _arrays(batch, features: int, classes: int):
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, features)
    margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), np.float64).reshape(n, classes)
    return bins, batch.column("label").to_numpy(), margins


def _leaves(bins: np.ndarray, tree: dict) -> np.ndarray:
    """Number of the node of each row in a growing tree: {node: (feature, bin)}, children of k are 2k + 1 and 2k + 2."""
    at = np.zeros(len(bins), np.int64)
    for _ in range(max(tree, default=0).bit_length() + 1):
        moved = at.copy()
        for node, (feature, cut) in tree.items():
            here = np.flatnonzero(at == node)
            moved[here] = 2 * node + 1 + (bins[here, feature] > cut)
        if np.array_equal(moved, at):
            break
        at = moved
    return at


def _probabilities(margins: np.ndarray) -> np.ndarray:
    grown = np.exp(margins - margins.max(1, keepdims=True))
    return grown / grown.sum(1, keepdims=True)


def _sums(rows: DataFrame, trees: list[dict], level: int, features: int, classes: int, bins: int) -> np.ndarray:
    """Sums of gradient and curvature by class, node of a level, feature and bin."""
    first, width = 2**level - 1, 2**level
    shape = (classes, width, features, bins, 2)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            x, label, margins = _arrays(batch, features, classes)
            p = _probabilities(margins)
            for k in range(classes):
                at = _leaves(x, trees[k]) - first
                here = np.flatnonzero((at >= 0) & (at < width))
                pair = np.stack((p[here, k] - (label[here] == k), p[here, k] * (1 - p[here, k])), 1)
                for f in range(features):
                    place = at[here] * bins + x[here, f]
                    for s in range(2):
                        total[k, :, f, :, s] += np.bincount(place, pair[:, s], width * bins).reshape(width, bins)
        used = np.flatnonzero(total.reshape(-1, 2).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(-1, 2)[used, 0]), pa.array(total.reshape(-1, 2)[used, 1])], ["place", "g", "h"])

    out = np.zeros(shape)
    flat = out.reshape(-1, 2)
    got = rows.mapInArrow(run, "place long, g double, h double").groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    flat[got["place"]] = got[["g", "h"]]
    return out


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], rounds: int = 10, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least_gain: float = 1e-9, bins: int = 32) -> Boosted:
    """Boosted trees for ``label``, one of ``classes``; each leaf is -rate * sum of gradients / (sum of curvatures + ridge).

    A node is split where the gain is largest (ties: the first feature, then the least cut), if it is above ``least_gain``.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins from 2 to 256")
    number = F.coalesce(*[F.when(F.col(label) == c, k) for k, c in enumerate(classes)]).cast("int")
    known = train.where(number.isNotNull())
    at = [i / bins for i in range(1, bins)]
    value = lambda f: F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double"))
    first = known.agg(*[F.percentile_approx(value(f), at, 100_000).alias(f"q{k}") for k, f in enumerate(features)], *[F.count_if(number == k).alias(f"n{k}") for k in range(len(classes))]).first()
    cuts = [sorted(set(first[f"q{k}"] or [])) for k in range(len(features))]
    counts = np.array([first[f"n{k}"] for k in range(len(classes))], float)
    priors = np.log((counts + 1) / (counts.sum() + len(classes))).tolist() if counts.sum() else [0.0] * len(classes)
    model = Boosted(list(classes), list(features), priors, cuts)
    if not counts.sum():
        return model
    rows = materialise(_binned(known, features, cuts, number, len(classes), priors), "boosting")
    n_features, n_classes = len(features), len(classes)
    for _ in range(rounds):
        trees: list[dict] = [{} for _ in classes]
        values: list[dict] = [{} for _ in classes]
        for level in range(depth + 1):
            if level and not any(t for t in trees):
                break
            sums = _sums(rows, trees, level, n_features, n_classes, bins)
            for k in range(n_classes):
                for j in range(2**level):
                    node = 2**level - 1 + j
                    g, h = sums[k, j, 0].sum(0) if n_features else (0.0, 0.0)
                    if level and (node - 1) // 2 not in trees[k]:
                        continue
                    values[k][node] = -rate * g / (h + ridge)
                    if level == depth:
                        continue
                    low = sums[k, j].cumsum(1)[:, :-1]
                    high = sums[k, j].sum(1, keepdims=True) - low
                    gain = low[..., 0] ** 2 / (low[..., 1] + ridge) + high[..., 0] ** 2 / (high[..., 1] + ridge) - g * g / (h + ridge)
                    for f in range(n_features):
                        gain[f, len(cuts[f]):] = -np.inf
                    gain[(low[..., 1] <= 0) | (high[..., 1] <= 0)] = -np.inf
                    best = int(np.argmax(np.round(gain, 9)))
                    if gain.flat[best] > least_gain:
                        trees[k][node] = divmod(best, bins - 1)
        model.trees.append([_nested(trees[k], values[k], cuts) for k in range(n_classes)])
        before, rows = rows, materialise(_moved(rows, trees, values, n_features, n_classes), "boosting")
        discard(before)
    discard(rows)
    return model


def _nested(tree: dict, values: dict, cuts: list[list[float]], node: int = 0):
    if node not in tree:
        return float(values[node])
    feature, cut = tree[node]
    return [feature, cuts[feature][cut], _nested(tree, values, cuts, 2 * node + 1), _nested(tree, values, cuts, 2 * node + 2)]


def _moved(rows: DataFrame, trees: list[dict], values: list[dict], features: int, classes: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            x, _, margins = _arrays(batch, features, classes)
            step = np.stack([np.array([values[k][node] for node in _leaves(x, trees[k]).tolist()]) if len(x) else np.zeros(0) for k in range(classes)], 1)
            yield batch.set_column(2, "margins", pa.array([r.tobytes() for r in margins + step], pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def apply_boosted(df: DataFrame, model: Boosted) -> DataFrame:
    """Add tree_prediction (the first of the likeliest classes), tree_score (its probability) and a ``{class}_pred`` for each class."""
    p = arrays.softmax(F.array(*model.margins()))
    out = df.withColumn("_p", p)
    named = {f"{c}_pred": F.get("_p", k) for k, c in enumerate(model.classes)}
    best = F.get(F.array(*[F.lit(c) for c in model.classes]), arrays.argmax(F.col("_p")))
    return out.withColumns({"tree_prediction": best, "tree_score": F.array_max("_p"), **named}).drop("_p")


def best_per_source(scored: DataFrame, key: str, score: str = "tree_score") -> DataFrame:
    """The row of highest score of each key; of equal ones the least row by all columns."""
    return scored.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.struct("*").alias("_row"))).alias("_b")).select("_b._row.*")
