"""Models fitted together equal those fitted one by one."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from rankloom.operators import many, probes

N, D = 180, 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((N, D)) * [1, 3, 0.2, 1] + [0, 50, -1, 2]
    x[:, 3] = 2.0  # no spread
    y = np.stack([x[:, 0] + rng.standard_normal(N) > 0, x[:, 1] + 3 * rng.standard_normal(N) > 51, rng.random(N) < 0.1], 1).astype(int)
    c = np.clip(np.round(x[:, 0] + 0.5 * rng.standard_normal(N)), -1, 1).astype(int) + 1
    r = x @ [2.0, -1.0, 0.5, 0] + rng.standard_normal(N)
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), int(c[i]), float(r[i]), i % 3) for i in range(N)], "id int, v array<double>, y array<int>, c int, r double, fold int").repartition(4).persist()
    return x, y, c, r, df


def closed(x, r, alpha=1.0):
    m, s = x.mean(0), x.std(0)
    z = np.where(s > 1e-9, (x - m) / np.where(s > 1e-9, s, 1), 0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (r - r.mean()))
    w = np.where(s > 1e-9, w / np.where(s > 1e-9, s, 1), 0)
    return w, r.mean() - w @ m


def test_ridge_of_folds_by_subtraction(data):
    x, _, _, r, df = data
    models = many.ridge(many.packed(df, "v", F.col("r"), "fold"), [0, 1, 2, None])
    for k, f in enumerate(models.folds):
        at = np.ones(N, bool) if f is None else np.arange(N) % 3 != f
        w, b = closed(x[at], r[at])
        assert models.weights[k, 0] == pytest.approx(w, abs=1e-8) and models.intercept[k, 0] == pytest.approx(b, abs=1e-6)


def test_labels_and_folds_equal_single_fits(data, spark):
    x, y, _, _, df = data
    models = many.logistic(many.packed(df, "v", F.col("y"), "fold"), 3, [0, 1, None], tolerance=1e-8)
    assert models.passes < 100
    for k, f in enumerate(models.folds):
        part = df if f is None else df.filter(F.col("fold") != f)
        a = probes.scaled(part, [], "v")[0]
        n = a.count()
        for j in range(3):
            one = LogisticRegression(regParam=1 / n, standardization=False, maxIter=200, tol=1e-12, labelCol="t").fit(a.withColumn("t", F.col("y")[j].cast("double")))
            at = np.ones(N, bool) if f is None else np.arange(N) % 3 != f
            s = x[at].std(0)
            w = np.where(s > 1e-9, one.coefficients.toArray() / np.where(s > 1e-9, s, 1), 0)
            assert models.weights[k, j] == pytest.approx(w, abs=2e-4)
            assert models.intercept[k, j] == pytest.approx(one.intercept - w @ x[at].mean(0), abs=2e-2)


def test_classes_equal_a_single_fit(data):
    x, _, c, _, df = data
    models = many.logistic(many.packed(df, "v", F.col("c"), None), 3, [None], joint=True, tolerance=1e-8)
    a = probes.scaled(df, [], "v")[0]
    one = LogisticRegression(family="multinomial", regParam=1 / N, standardization=False, maxIter=300, tol=1e-12, labelCol="c").fit(a)
    z = x @ models.weights[0].T + models.intercept[0]
    s = np.where(x.std(0) > 1e-9, x.std(0), 1)
    other = np.where(x.std(0) > 1e-9, (x - x.mean(0)) / s, 0) @ one.coefficientMatrix.toArray().T + one.interceptVector.toArray()
    p = lambda t: np.exp(t) / np.exp(t).sum(1, keepdims=True)
    assert p(z) == pytest.approx(p(other), abs=1e-4)


def test_fold_predictions_of_all_kinds(data):
    x, y, c, r, df = data
    got = {q.id: q.prediction for q in probes.fold_predictions(df.withColumn("y", F.col("r")), "v", "regression", "fold").collect()}
    for f in range(3):
        at = np.arange(N) % 3 != f
        w, b = closed(x[at], r[at])
        assert [got[i] for i in range(f, N, 3)] == pytest.approx(x[~at] @ w + b, abs=1e-6)
    for target, truth in ((F.col("c").cast("double"), c), (F.col("y")[0].cast("double"), y[:, 0])):
        rows = probes.cross_validated(df.withColumn("y", target), "v", "linear", "classification", "fold").collect()
        assert {q.fold for q in rows} == {0, 1, 2} and sum(q.n for q in rows) == N and all(q.accuracy > np.bincount(truth).max() / N for q in rows)
    few = df.withColumn("y", F.when(F.col("id") > 3, F.col("r"))).withColumn("v", F.when(F.col("id") != 7, F.col("v")))
    assert probes.fold_predictions(few, "v", "regression", "fold").count() == N - 5


def test_penalty_chosen_inside(data):
    x, _, _, r, df = data
    rows = df.withColumns({"y": F.col("r"), "inner": F.pmod(F.floor(F.col("id") / 3), F.lit(4)).cast("int")})
    got = {q.fold: q for q in probes.nested(rows, "v", "regression", "fold", "inner", [0.1, 1000.0]).collect()}
    assert len(got) == 3 and all(q.alpha == 0.1 for q in got.values())
    w, b = closed(x[np.arange(N) % 3 != 1], r[np.arange(N) % 3 != 1], 0.1)
    own = np.arange(N) % 3 == 1
    assert got[1].mse == pytest.approx(((x[own] @ w + b - r[own]) ** 2).mean())


def test_no_rows(data):
    df = data[-1].filter("id < 0")
    assert many.logistic(many.packed(df, "v", F.col("y"), "fold"), 3, [None]).weights.shape == (1, 3, 0)
    assert many.ridge(many.packed(df, "v", F.col("r"), "fold"), [None]).weights.shape == (1, 1, 0)


def test_neighbour_probe(data):
    x, y, c, r, df = data
    rows = df.withColumn("y", F.col("c").cast("double"))
    train, test = rows.filter("id >= 20"), rows.filter("id < 20")
    got = {q.id: q.prediction for q in probes.fit_predict(train, test, "v", "knn", "classification", k=5).collect()}
    far = {q.id: q.prediction for q in probes.fit_predict(train.withColumn("y", F.col("r")), test, "v", "knn", "regression", k=5, weighted=True).collect()}
    for i in range(20):
        d = np.sqrt(((x[20:] - x[i]) ** 2).sum(1))
        near = np.lexsort((np.arange(len(d)), d))[:5]
        assert got[i] == np.bincount(c[20:][near]).argmax()
        assert far[i] == pytest.approx((r[20:][near] / d[near]).sum() / (1 / d[near]).sum())
    assert probes.fit_predict(train.limit(2), test, "v", "knn", "classification", k=5).filter("prediction is null").count() == 0
