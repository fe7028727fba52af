"""Shared-work search: every candidate's score is the one of a fit of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import cv, learners, metrics, search, split

CANDIDATES = [("Naive Bayes", {"var_smoothing": 1e-9}), ("Naive Bayes", {"var_smoothing": 0.5}),
              ("KNN", {"n_neighbors": 3, "weights": "uniform"}), ("KNN", {"n_neighbors": 7, "weights": "distance"}),
              ("KNN", {"n_neighbors": 5, "weights": "uniform", "metric": "manhattan"}),
              ("Gradient Boosting", {"n_estimators": 2, "learning_rate": 0.2, "max_depth": 3, "subsample": 0.7}),
              ("Gradient Boosting", {"n_estimators": 6, "learning_rate": 0.2, "max_depth": 3, "subsample": 0.7})]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2)).round(1)  # ties
    rows = [(f"k{i}", float(a), float(b), float(a + b * b + rng.normal() > 0.8), float(2 * a - b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "_key string, a double, b double, label double, y double")
    return split.assign_folds(df, ["_key"], "label", k=3).persist()


def thinned(train):
    return train.where(F.pmod(F.xxhash64("_key"), F.lit(4)) > 0)


@pytest.mark.parametrize("resample", [None, thinned])
def test_classifiers_against_own_fits(table, resample):
    folds = search.build_folds(table, ["a", "b"], key=["_key"], resample=resample)
    assert folds.resampled == (resample is not None)
    got = cv.fold_scores(folds, ["a", "b"], "classification", "f1_macro", CANDIDATES, key=["_key"], n_classes=2)
    assert [(c, f) for c, f, _ in got] == [(c, f) for c in range(len(CANDIDATES)) for f in range(3)]
    for c, f, score in got:
        name, params = CANDIDATES[c]
        keys = {r[0] for r in folds.train[f].select("_key").collect()}
        want = table.where(F.col("fold") != f)
        assert keys == {r[0] for r in (resample(want) if resample else want).select("_key").collect()}
        if f == 0 or name == "Naive Bayes":
            model = learners.fit(name, folds.train[f], ["a", "b"], "classification", params={**params, "key": ["_key"]}, n_classes=2)
            assert abs(cv.evaluate(model.transform(table.where(F.col("fold") == f)), "f1_macro") - score) < 1e-9, (name, params, f)


def test_regressors_against_own_fits(table):
    data = table.drop("label").withColumnRenamed("y", "label")
    candidates = [("KNN", {"n_neighbors": 3}), ("KNN", {"n_neighbors": 4, "weights": "distance"}),
                  ("Gradient Boosting", {"n_estimators": 2}), ("Gradient Boosting", {"n_estimators": 4}), ("Linear Regression", {})]
    folds = search.build_folds(data, ["a", "b"], key=["_key"])
    got = cv.fold_scores(folds, ["a", "b"], "regression", "r2", candidates, key=["_key"])
    for c, f, score in got:
        name, params = candidates[c]
        if f:
            continue
        model = learners.fit(name, folds.train[f], ["a", "b"], "regression", params={**params, "key": ["_key"]})
        assert abs(metrics.regression_metrics(model.transform(data.where(F.col("fold") == f))).first()["r2"] - score) < 1e-9, (name, params)


def test_solvers_differ_by_the_intercept(table):
    """liblinear shrinks the intercept as well: its gradient is zero there, lbfgs's is zero without that term."""
    pdf = table.toPandas()
    c = 0.05
    for solver, shrinks in (("liblinear", 1.0), ("lbfgs", 0.0)):
        m = learners.fit("Logistic Regression", table, ["a", "b"], "classification", params={"C": c, "solver": solver}, n_classes=2)
        lr = m.model.stages[-1]
        w = list(lr.coefficients) if shrinks else [*lr.coefficients, lr.intercept]
        x = np.column_stack([pdf[["a", "b"]].to_numpy(), np.ones(len(pdf))])
        p = 1 / (1 + np.exp(-x @ np.array(w)))
        slope = c * x.T @ (p - pdf["label"].to_numpy()) + np.array([1.0, 1.0, shrinks]) * np.array(w)
        assert np.abs(slope).max() < 1e-3
        assert np.allclose(m.transform(table).orderBy("_key").toPandas()["score"], p[np.argsort(pdf["_key"].to_numpy(), kind="stable")], atol=1e-9)


def test_partitions_by_bytes(spark):
    assert search.by_bytes(spark.range(1000).repartition(50), 1000).rdd.getNumPartitions() == 1
    assert search.by_bytes(spark.range(1000).repartition(50), 10 ** 9).rdd.getNumPartitions() == 50


def test_naive_bayes_reads_each_fold_once(table, monkeypatch):
    """All candidates are scored in one pass over a fold's rows."""
    seen, plain = [], search._measured
    monkeypatch.setattr(search, "_measured", lambda pred, *a: (seen.append(pred), plain(pred, *a))[1])
    got = cv.fold_scores(table, ["a", "b"], "classification", "f1_macro", CANDIDATES[:2], n_classes=2)
    assert len(got) == 6
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3
