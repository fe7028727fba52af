"""Models grown together are the ones MLlib fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import boosting, learners, metrics, search

FEATURES = ["a", "b", "c"]


def table(spark, n, partitions):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3))
    x[:, 1] = np.where(rng.random(n) < 0.3, 0.0, x[:, 1].round(1))      # zeros and ties
    x[:, 2] = rng.integers(0, 2, n)
    y = (x[:, 0] + x[:, 1] ** 2 + x[:, 2] + rng.normal(size=n) > 1).astype(float)
    rows = [(*map(float, r), float(v), float(r[0] * 2 - r[1])) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, z double").coalesce(partitions).persist()
    assert df.count() == n and df.rdd.getNumPartitions() == partitions
    return df


@pytest.mark.parametrize("n,partitions,problem", [(300, 1, "classification"), (300, 2, "regression"), (12_000, 2, "classification")])
def test_same_trees_as_mllib(spark, n, partitions, problem):
    df = table(spark, n, partitions)
    df = df if problem == "classification" else df.drop("label").withColumnRenamed("z", "label").persist()
    params = [{"max_depth": 2, "learning_rate": 0.3, "subsample": 0.7}, {"max_depth": 4, "learning_rate": 0.1, "subsample": 1.0}]
    pts = boosting.points(df, FEATURES, "label")
    ends = {0: boosting.cuts(pts, n, len(FEATURES))}
    trees = boosting.fit({0: pts}, {0: n}, ends, problem, [boosting.Spec.of(p, 3) for p in params])
    x = df.select(*FEATURES).toPandas().to_numpy()
    bins = np.array([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(ends[0])], np.uint8)
    for i, p in enumerate(params):
        m = learners.fit("Gradient Boosting", df, FEATURES, problem, params={**p, "n_estimators": 3}, n_rows=n, n_classes=2)
        own = sum(t[3][boosting._nodes(t, bins)] * (p["learning_rate"] if k else 1.0) for k, t in enumerate(trees[0, i]))
        out = m.model.transform(df).select("rawPrediction" if problem == "classification" else "prediction").collect()
        theirs = np.array([r[0][1] if problem == "classification" else r[0] for r in out])
        assert np.abs(own - theirs).max() < 1e-9, (i, np.abs(own - theirs).max())


def test_one_job_a_level_for_all_models(spark):
    df = table(spark, 200, 1)
    pts = {f: boosting.points(df, FEATURES, "label") for f in range(3)}
    ends = {f: boosting.cuts(pts[f], 200, len(FEATURES)) for f in pts}
    specs = [boosting.Spec(4, 3, s, 1.0) for s in (0.1, 0.2, 0.3, 0.4)]
    sc = spark.sparkContext
    sc.setJobGroup("boosting-levels", "")
    try:
        models = boosting.fit(pts, {f: 200 for f in pts}, ends, "classification", specs)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(len, models.values())) == [4] * 12
    assert len(sc.statusTracker().getJobIdsForGroup("boosting-levels")) <= 4 * 3


def test_no_draws_no_rows_and_bad_rows(spark):
    df = table(spark, 200, 1)
    constant = df.withColumn("a", F.lit(0.0)).withColumn("b", F.lit(0.0)).withColumn("c", F.lit(1.0)).persist()
    pts = boosting.points(constant, FEATURES, "label")
    ends = {0: boosting.cuts(pts, 200, 3)}
    trees = boosting.fit({0: pts}, {0: 200}, ends, "classification", [boosting.Spec(2, 3, 0.1, 1.0)])[0, 0]
    assert [len(t[0]) for t in trees] == [1, 1]
    mean = 2 * df.agg(F.avg("label")).first()[0] - 1
    assert abs(trees[0][3][0] - mean) < 1e-12
    with pytest.raises(Exception, match="null, NaN or infinity in a"):
        boosting.cuts(boosting.points(df.withColumn("a", F.lit(float("nan"))), FEATURES, "label"), 200, 3)


def test_search_does_not_fit_boosting_one_by_one(spark, monkeypatch):
    df = table(spark, 150, 1).withColumn("fold", (F.monotonically_increasing_id() % 2).cast("int"))
    monkeypatch.setattr(learners, "fit", lambda *a, **k: pytest.fail("a fit of its own"))
    folds = search.build_folds(df, FEATURES)
    candidates = [("Gradient Boosting", {"n_estimators": n, "max_depth": d}) for n in (1, 3) for d in (1, 2)]
    got = search.scores(folds, FEATURES, "classification", "accuracy", candidates, n_classes=2)
    assert [(c, f) for c, f, _ in got] == [(c, f) for c in range(4) for f in range(2)]


def test_linear_svm_is_fitted_once_for_all_gammas(spark, monkeypatch):
    df = table(spark, 150, 1).withColumn("fold", (F.monotonically_increasing_id() % 2).cast("int"))
    seen, plain = [], learners.fit
    monkeypatch.setattr(learners, "fit", lambda *a, **k: (seen.append(a[5]), plain(*a, **k))[1])
    folds = search.build_folds(df, FEATURES)
    candidates = [("SVM", {"C": c, "kernel": "linear", "gamma": g}) for c in (0.001,) for g in ("scale", "auto")]
    got = search.scores(folds, FEATURES, "classification", "f1", candidates, n_classes=2)
    assert [(c, f) for c, f, _ in got] == [(c, f) for c in range(2) for f in range(2)]
    assert len(seen) == 2
    m = plain("SVM", folds.train[0], FEATURES, "classification", "label", candidates[1][1], n_classes=2)
    pred = m.transform(folds.rows.where("fold = 0"))
    assert pred.where("score is null").count() == 0
    own = metrics.classification_metrics(pred).first()["f1_binary"]
    assert all(abs(own - s) < 1e-12 for _, f, s in got if f == 0)
