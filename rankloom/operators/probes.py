"""Probes on tables of vectors, with MLlib, and their evaluation."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import many, similarity
from rankloom.operators.metrics import class_metrics, confusion, regression, spearman


def scaled(train: DataFrame, others: list[DataFrame], vector: str) -> list[DataFrame]:
    """All frames with features: the vector less the training mean over the population deviation."""
    n = train.count()
    vec = lambda df: df.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))
    model = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(vec(train))
    factor = math.sqrt(n / max(1, n - 1))
    return [model.transform(vec(df)).withColumn("features", array_to_vector(F.transform(vector_to_array("_std"), lambda x: x * factor))).drop("_raw", "_std") for df in (train, *others)]


def make_probe(kind: str, problem: str, n: int, spread: float = 1.0, classes: int = 2):
    """An estimator: linear (L2 logistic with C = 1, or ridge with alpha 1) or gbt, for classification or regression."""
    if kind == "linear" and problem == "regression":
        return LinearRegression(solver="normal", elasticNetParam=0.0, regParam=spread / max(1, n), labelCol="y")
    if kind == "linear":
        return LogisticRegression(family="auto", regParam=1.0 / max(1, n), standardization=False, maxIter=100, labelCol="y")
    if kind == "gbt" and problem == "regression":
        return GBTRegressor(labelCol="y", seed=42, maxIter=20)
    if kind == "gbt":
        one = GBTClassifier(labelCol="y", seed=42, maxIter=20)
        return one if classes <= 2 else OneVsRest(classifier=one, labelCol="y")
    raise ValueError(f"no probe {kind} for {problem}")


def fit_predict(train: DataFrame, test: DataFrame, vector: str, kind: str, problem: str, key: str = "id", k: int = 3, weighted: bool = False) -> DataFrame:
    """test with prediction; both frames have y (a number; for classes from 0). kind: linear, gbt, or knn, which needs a key (a whole number) and looks at k training rows (at all where there are fewer), each with the inverse of its distance as weight if weighted."""
    if kind == "knn":
        return _by_neighbours(train, test, vector, problem, key, k, weighted)
    a, b = scaled(train, [test], vector)
    s = a.agg(F.count("*"), F.stddev_pop("y"), F.countDistinct("y")).first()
    return make_probe(kind, problem, s[0], s[1] or 1.0, s[2]).fit(a).transform(b)


def _by_neighbours(train: DataFrame, test: DataFrame, vector: str, problem: str, key: str, k: int, weighted: bool) -> DataFrame:
    side = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    near = similarity.nearest(side(test), side(train), k, "euclidean")
    if problem == "regression":
        w = 1 / F.greatest(F.lit(1e-12), -F.col("score")) if weighted else F.lit(1.0)
        y = train.select(F.col(key).cast("bigint").alias("target_id"), F.col("y").cast("double").alias("_y"))
        found = near.join(y, "target_id").groupBy("query_id").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("prediction"))
    else:
        found = similarity.knn_vote(near, train.select(F.col(key).cast("bigint").alias("id"), F.col("y").alias("label")), weighted).withColumnRenamed("predicted", "prediction")
    return test.join(found, F.col(key).cast("bigint") == F.col("query_id"), "left").drop("query_id")


def evaluate(predicted: DataFrame, problem: str, groups: list[str] = ()) -> DataFrame:
    """The metric block of predictions (of each group)."""
    groups = list(groups)
    return regression(predicted, "y", "prediction", groups) if problem == "regression" else class_metrics(confusion(predicted, "y", "prediction", groups), groups)


def fold_predictions(df: DataFrame, vector: str, problem: str, fold: str) -> DataFrame:
    """df with prediction: each fold's rows by a linear probe of all other rows. All folds are fitted together; rows without vector, y or fold are left out."""
    rows = df.filter(F.col(vector).isNotNull() & F.col("y").isNotNull() & F.col(fold).isNotNull())
    # As many numbers as folds and classes.
    folds = [r[0] for r in rows.select(F.col(fold).cast("int").alias("f")).distinct().orderBy("f").collect()]
    if problem == "regression":
        blocks = many.packed(rows, vector, F.col("y"), fold).persist()
        models = many.ridge(blocks, folds)
        out = many.scores(rows, vector, models, fold, "_out").withColumn("prediction", F.col("_out")[0])
    else:
        classes = int(rows.agg(F.max("y")).first()[0] or 0) + 1
        blocks = many.packed(rows, vector, F.col("y"), fold).persist()
        models = many.logistic(blocks, 1 if classes <= 2 else classes, folds, joint=classes > 2)
        out = many.scores(rows, vector, models, fold, "_out")
        best = F.array_position("_out", F.array_max("_out")).cast("double") - 1
        out = out.withColumn("prediction", best if classes > 2 else (F.col("_out")[0] > 0).cast("double"))
    blocks.unpersist()
    return out.drop("_out")


def cross_validated(df: DataFrame, vector: str, kind: str, problem: str, fold: str) -> DataFrame:
    """A row of metrics per fold: each fold is predicted from the others. Linear probes of all folds are fitted together, others one after the other."""
    if kind == "linear":
        return evaluate(fold_predictions(df, vector, problem, fold), problem, [fold]).withColumnRenamed(fold, "fold")
    out = None
    for k in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        block = evaluate(fit_predict(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k), vector, kind, problem), problem).withColumn("fold", F.lit(k))
        out = block if out is None else out.unionByName(block)
    return out


def nested(df: DataFrame, vector: str, problem: str, outer: str, inner: str, alphas: list[float]) -> DataFrame:
    """outer fold, alpha and mse of ridge probes with the penalty chosen inside: for each outer fold, the penalty of the least error over the inner folds of its other rows; then the error of that penalty on the outer fold. Products are summed once for each pair of folds."""
    if problem != "regression":
        raise ValueError("nested folds are for regression")
    rows = df.filter(F.col(vector).isNotNull() & F.col("y").isNotNull())
    found = None
    for k in [r[0] for r in rows.select(outer).distinct().orderBy(outer).collect()]:
        rest, own = rows.filter(F.col(outer) != k), rows.filter(F.col(outer) == k)
        blocks = many.packed(rest, vector, F.col("y"), inner).persist()
        folds = [r[0] for r in rest.select(F.col(inner).cast("int").alias("f")).distinct().orderBy("f").collect()]
        tried = None
        for a in alphas:
            out = many.scores(rest, vector, many.ridge(blocks, folds, a), inner, "_out").agg(F.avg(F.pow(F.col("y") - F.col("_out")[0], 2)).alias("e")).withColumn("alpha", F.lit(float(a)))
            tried = out if tried is None else tried.unionByName(out)
        best = tried.orderBy("e", "alpha").first().alpha
        block = many.scores(own, vector, many.ridge(blocks, [None], best), None, "_out").agg(F.avg(F.pow(F.col("y") - F.col("_out")[0], 2)).alias("mse")).select(F.lit(k).alias("fold"), F.lit(best).alias("alpha"), "mse")
        found = block if found is None else found.unionByName(block)
        blocks.unpersist()
    return found


def holdout(train: DataFrame, test: DataFrame, vector: str, kind: str, problem: str, key: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """The metric block of a probe on held-out rows, with the interval of the mean of its hits (classes) or absolute errors (regression), the draws that went into it, and the seconds of the fit."""
    from rankloom.operators.bootstrap import mean_interval

    a, b = scaled(train, [test], vector)
    # At hand before the clock runs: reading and scaling are no part of the fit.
    a = a.persist()
    s = a.agg(F.count("*"), F.stddev_pop("y"), F.countDistinct("y")).first()
    began = time.monotonic()
    model = make_probe(kind, problem, s[0], s[1] or 1.0, s[2]).fit(a)
    seconds = time.monotonic() - began
    a.unpersist()
    predicted = model.transform(b)
    each = F.abs(F.col("y") - F.col("prediction")) if problem == "regression" else (F.col("y") == F.col("prediction")).cast("double")
    inner = mean_interval(predicted.select(key, each.alias("_v")), key, "_v", draws, seed)
    # One row each.
    return evaluate(predicted, problem).crossJoin(inner.withColumnsRenamed({"mean": "interval_of", "low": "interval_low", "high": "interval_high"})).withColumn("fit_seconds", F.lit(seconds))


def residue_probe(positions: DataFrame, entity: str, k: int, seed: int) -> DataFrame:
    """The mean over k folds of a linear probe on positions (entity, vec, label): positions without truth go, all of an entity's lie in one fold. With spearman of the predicted and true labels, as these may be ordered, and n_folds."""
    from rankloom.operators.prepare import folds, without_ignored

    rows = folds(without_ignored(positions), k, seed, entity, group=entity).withColumn("y", F.col("label").cast("double"))
    predicted = fold_predictions(rows, "vec", "classification", "fold")
    out = evaluate(predicted, "classification", ["fold"]).join(spearman(predicted, "y", "prediction", ["fold"]).select("fold", "spearman"), "fold").drop("fold")
    return out.agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in out.columns if c != "n"], F.count("*").alias("n_folds"))


def multilabel(train: DataFrame, test: DataFrame, vector: str, labels: str, vocabulary: list[str]) -> DataFrame:
    """test with predicted: the labels whose own logistic regression says yes. All labels are fitted in the same passes."""
    known = F.transform(F.array(*[F.lit(x) for x in vocabulary]), lambda x: F.array_contains(labels, x).cast("int"))
    blocks = many.packed(train.filter(F.col(vector).isNotNull() & F.col(labels).isNotNull()), vector, known, None).persist()
    models = many.logistic(blocks, len(vocabulary), [None])
    blocks.unpersist()
    names = F.array(*[F.lit(x) for x in vocabulary])
    out = many.scores(test, vector, models, None, "_out")
    yes = F.filter(F.arrays_zip(names.alias("n"), F.col("_out").alias("z")), lambda x: x["z"] > 0)
    return out.withColumn("predicted", F.transform(yes, lambda x: x["n"])).drop("_out")


def reduced(df: DataFrame, vector: str, parts: int, sample: float, seed: int = 42) -> DataFrame:
    """The vector's first principal components, fitted on a sample."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=parts, inputCol="_v", outputCol="_p").fit(rows.sample(fraction=min(1.0, sample), seed=seed) if sample < 1 else rows)
    return model.transform(rows).withColumn(vector, vector_to_array("_p")).drop("_v", "_p")


def ridge_per_group(train: DataFrame, test: DataFrame, group: str, vector: str, alpha: float = 1.0) -> DataFrame:
    """test with prediction from one ridge regression per group, solved from sums of products: only a matrix as wide as the vector is held per group."""
    d = train.select(F.size(vector)).first()
    if d is None:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    width = d[0] + 1

    def sums(frames):
        for x in frames:
            for g, part in x.groupby("g"):
                m = np.column_stack([np.ones(len(part)), np.stack(part["v"].to_list())])
                yield pd.DataFrame({"g": [g], "xx": [(m.T @ m).ravel().tolist()], "xy": [(m.T @ part["y"].to_numpy()).tolist()]})

    rows = train.select(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"), F.col("y").cast("double").alias("y"))
    kind = dict(train.dtypes)[group]
    part = rows.mapInPandas(sums, f"g {kind}, xx array<double>, xy array<double>")

    def total_of(c: str) -> DataFrame:
        sums_ = part.select("g", F.posexplode(c).alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
        return sums_.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(c))

    total = total_of("xx").join(total_of("xy"), "g")

    def solve(frames):
        for x in frames:
            out = []
            for xx, xy in zip(x["xx"], x["xy"], strict=True):
                m = np.array(xx).reshape(width, width) + alpha * np.diag([0.0] + [1.0] * (width - 1))
                out.append(np.linalg.lstsq(m, np.array(xy), rcond=None)[0].tolist())
            yield pd.DataFrame({"g": x["g"], "w": out})

    weights = total.mapInPandas(solve, f"g {kind}, w array<double>").withColumnRenamed("g", group)
    value = F.aggregate(F.zip_with(F.slice("w", 2, width), F.col(vector), lambda a, b: a * b.cast("double")), F.col("w")[0], lambda s, x: s + x)
    return test.join(weights, group, "left").withColumn("prediction", value).drop("w")


ProbeFactory = Callable[[str, str, int], object]
