"""Evaluation, splits, clustering of small groups, model scoring hooks, and set operations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.sources.scratch import discard, materialise


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class of a confusion matrix in long form; 0 where undefined."""
    right = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    as_truth = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(right).alias("hits"))
    as_guess = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guesses"))
    both = as_truth.join(as_guess, "label", "full").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = both.withColumns({"precision": ratio(F.col("hits"), F.col("guesses")), "recall": ratio(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("hits", "guesses")


def summary_scores(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1 and weighted F1."""
    per = class_scores(matrix)
    return per.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def stratified_split(df: DataFrame, stratum: str, order: Sequence[Column], shares: Sequence[tuple[str, float]]) -> DataFrame:
    """Add ``split``: within each stratum, rows in ``order`` are cut at the running shares. The last takes the rest."""
    by = Window.partitionBy(stratum)
    rows = df.withColumns({"_i": F.row_number().over(by.orderBy(*order)), "_n": F.count(F.lit(1)).over(by)})
    name, bound, running = F.lit(shares[-1][0]), [], 0.0
    for label, share in shares[:-1]:
        running += share
        bound.append((label, running))
    for label, upto in reversed(bound):
        name = F.when(F.col("_i") <= F.floor(F.col("_n") * upto + 1e-9), label).otherwise(name)
    return rows.withColumn("split", name).drop("_i", "_n")


def group_split(df: DataFrame, group: str, shares: Sequence[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Add ``split`` by a hash of the group, so that a group's rows stay together; no shuffle."""
    u = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    name, running = F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for label, share in reversed(shares[:-1]):
        name = F.when(u < running, label).otherwise(name)
        running -= share
    return df.withColumn("split", name)


def per_class_sample(df: DataFrame, label: str, n: int, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def two_means(df: DataFrame, key: str, x: str, y: str, rounds: int = 12) -> DataFrame:
    """Per key: centre distance of two means over the spread sqrt of summed squared (q90 - q10), and the within error.

    Centres start at the extremes along the wider axis. A round assigns rows to their nearer centre and averages again:
    aggregations only, so a key of any size is spread over tasks. Rounds are written, and end when no key's error
    changes any more, or after ``rounds``.
    """
    rows = df.select(key, F.col(x).alias("x"), F.col(y).alias("y")).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    q = lambda c, p: F.percentile(c, F.lit(p))
    base = rows.groupBy(key).agg((q("x", 0.9) - q("x", 0.1)).alias("sx"), (q("y", 0.9) - q("y", 0.1)).alias("sy"), F.min(F.struct("x", "y")).alias("xl"), F.max(F.struct("x", "y")).alias("xh"), F.min(F.struct("y", "x")).alias("yl"), F.max(F.struct("y", "x")).alias("yh"))
    wide = F.col("sx") >= F.col("sy")
    pick = lambda a, b, f: F.when(wide, F.col(f"{a}.{f}")).otherwise(F.col(f"{b}.{f}"))
    base = base.select(key, "sx", "sy", *[pick(a, b, f).alias(n) for a, b, f, n in (("xl", "yl", "x", "ax"), ("xl", "yl", "y", "ay"), ("xh", "yh", "x", "bx"), ("xh", "yh", "y", "by"))])
    base = materialise(base.withColumn("inertia", F.lit(None).cast("double")), "two-means")
    for _ in range(rounds):
        near = rows.join(base.withColumnRenamed("inertia", "_was"), key)
        da = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
        db = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
        in_a = da <= db
        moved = near.groupBy(key).agg(
            F.max("sx").alias("sx"), F.max("sy").alias("sy"), *[F.coalesce(F.avg(F.when(cond, F.col(v))), F.max(f"{c}{v}")).alias(f"{c}{v}") for c, cond in (("a", in_a), ("b", ~in_a)) for v in "xy"], F.sum(F.least(da, db)).alias("inertia"), F.max("_was").alias("_was"),
        )
        moved = materialise(moved, "two-means")
        discard(base)
        base = moved.drop("_was")
        base._scratch = moved._scratch
        if moved.where(~(F.abs(F.col("inertia") - F.coalesce("_was", F.lit(float("inf")))) <= 1e-12 * F.col("inertia"))).isEmpty():
            break
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return base.select(key, F.try_divide(d, F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))).alias("blend_ratio"), "inertia")


def score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, params: object = None) -> DataFrame:
    """Model hook: ``fn(batch, params)`` over Arrow batches, with ``params`` (such as weights) broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch, shared.value)

    return df.mapInPandas(run, schema)


def linear_softmax(batch: pd.DataFrame, params: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    """A small scoring function for :func:`score`: class and confidence of a linear model over an array column."""
    weights, bias = params
    z = np.stack(batch["embedding"].to_numpy()) @ weights + bias if len(batch) else np.zeros((0, len(bias)))
    z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    p = z / z.sum(1, keepdims=True) if len(z) else z
    return pd.DataFrame({"vec_id": batch["vec_id"], "class": p.argmax(1).astype("int32") if len(p) else np.zeros(0, "int32"), "confidence": p.max(1) if len(p) else np.zeros(0)})


def fit_trees(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 8, seed: int = 7):
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(train).select(F.col(label).cast("double").alias("_label"), "_features")
    return RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def apply_trees(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """Add tree_prediction, tree_score (the best class's share) and tree_probabilities."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(df)
    out = model.transform(rows.withColumnRenamed("_features", model.getFeaturesCol()))
    p = vector_to_array(F.col("probability"))
    return out.withColumns({"tree_prediction": F.col("prediction").cast("int"), "tree_score": F.array_max(p), "tree_probabilities": p}).drop("prediction", "rawPrediction", "probability", model.getFeaturesCol())


def threshold(df: DataFrame, feature: str, label: str) -> float:
    """The cut of one feature that a decision tree of depth one finds best for a two-class label."""
    rows = VectorAssembler(inputCols=[feature], outputCol="_features").transform(df).select(F.col(label).cast("double").alias("_label"), "_features")
    model = DecisionTreeClassifier(labelCol="_label", featuresCol="_features", maxDepth=1, maxBins=256).fit(rows)
    found = re.search(r"feature 0 <= (\S+)\)", model.toDebugString)
    return float(found[1]) if found else float("nan")
