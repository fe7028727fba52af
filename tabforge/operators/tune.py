"""Hyper-parameter search over the top models."""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED
from .cv import _summarise, fold_scores
from .search import Folds, build_folds

RANDOM_ITER = 20

# The search spaces (reference parameter names).  ``None`` for
# max_depth means unlimited (MLlib's ceiling of 30).
CLASSIFICATION_GRIDS = {
    "Logistic Regression": ("grid", {"C": [0.01, 0.1, 1, 10], "solver": ["lbfgs", "liblinear"]}),
    "Decision Tree": ("grid", {"max_depth": [3, 5, 7, 10, None], "min_samples_split": [2, 5, 10],
                               "criterion": ["gini", "entropy"]}),
    "Random Forest": ("random", {"n_estimators": [50, 100, 200, 300], "max_depth": [3, 5, 7, None],
                                 "min_samples_split": [2, 5, 10], "max_features": ["sqrt", "log2"]}),
    "Gradient Boosting": ("random", {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                                     "max_depth": [3, 4, 5], "subsample": [0.7, 0.8, 1.0]}),
    "SVM": ("grid", {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]}),
    "KNN": ("grid", {"n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"],
                     "metric": ["euclidean", "manhattan"]}),
    "Naive Bayes": ("grid", {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]}),
}
REGRESSION_GRIDS = {
    "Linear Regression": ("grid", {}),
    "Decision Tree": ("grid", {"max_depth": [3, 5, 7, 10, None], "min_samples_split": [2, 5, 10]}),
    "Random Forest": ("random", {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7, None],
                                 "min_samples_split": [2, 5, 10]}),
    "Gradient Boosting": ("random", {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                                     "max_depth": [3, 4, 5]}),
    "SVM": ("grid", {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"]}),
    "KNN": ("grid", {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"]}),
}


def param_grids(problem_type: str) -> dict:
    """L7."""
    return CLASSIFICATION_GRIDS if problem_type == "classification" else REGRESSION_GRIDS


def combinations(space: dict) -> list[dict]:
    keys = list(space)
    return [dict(zip(keys, v)) for v in itertools.product(*[space[k] for k in keys])]


def random_pick(n_combos: int, n_iter: int = RANDOM_ITER, seed=SEED) -> list[int]:
    """The n_iter combination indices with the smallest md5(index|seed)."""
    h = sorted(range(n_combos), key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())
    return sorted(h[:min(n_iter, n_combos)])


def candidates_for(name: str, problem_type: str) -> tuple[list[dict], str]:
    search, space = param_grids(problem_type)[name]
    combos = combinations(space)
    if search == "random":
        combos = [combos[i] for i in random_pick(len(combos))]
    return combos, search


def tune_model(name: str, data: DataFrame, features: list[str], problem_type: str, metric: str,
               label: str = "label", key=None, parallelism: int = 4, n_classes=None,
               cv_mean: float | None = None, resample=None):
    """Search one model's space with 5-fold CV; returns (best_params, best_score, table).

    An empty space (linear regression) is not searched; its CV mean stands
    as the score (the reference reports 0.0 there).
    """
    combos, _ = candidates_for(name, problem_type)
    if n_classes is not None and n_classes > 2:  # that solver takes two classes, so its rows would repeat the other's
        combos = [c for c in combos if c.get("solver") != "liblinear"]
    spark = (data.rows if isinstance(data, Folds) else data).sparkSession
    if not combos or combos == [{}]:
        score = cv_mean if cv_mean is not None else 0.0
        t = spark.createDataFrame([(name, 0, "{}", float(score))],
                                  "model string, candidate int, params string, mean_score double")
        return {}, score, t
    # every candidate is fitted and keeps its own score; the pick is made on unrounded means
    res = fold_scores(data, features, problem_type, metric, [(name, p) for p in combos], label=label, key=key,
                      parallelism=parallelism, n_classes=n_classes, resample=resample)
    run = _summarise(spark, [(name, 0, ci, f, s) for ci, f, s in res])
    means = {r["candidate"]: r["m"] for r in run.scores.groupBy("candidate").agg(F.avg("score").alias("m")).collect()}
    best = max(range(len(combos)), key=lambda i: (means[i], -i))            # first best in candidate order
    t = spark.createDataFrame([(name, i, str(c), round(float(means[i]), 4)) for i, c in enumerate(combos)],
                              "model string, candidate int, params string, mean_score double")
    return combos[best], round(float(means[best]), 4), t


def run_tuning(data: DataFrame, features: list[str], problem_type: str, metric: str, top: list[str],
               label: str = "label", key=None, parallelism: int = 4, n_classes=None,
               cv_means: dict | None = None, resample=None):
    """Tune each of the top models; best = first maximum of the tuned score."""
    if not isinstance(data, Folds):
        data = build_folds(data, features, label, key, resample, parallelism)  # once for all models
    results, tables = {}, []
    for name in top:
        if name not in param_grids(problem_type):
            continue
        p, s, t = tune_model(name, data, features, problem_type, metric, label, key, parallelism, n_classes,
                             (cv_means or {}).get(name))
        results[name] = {"best_params": p, "best_score": s}
        tables.append(t)
    best = max(results, key=lambda n: results[n]["best_score"]) if results else None
    allt = tables[0]
    for t in tables[1:]:
        allt = allt.unionByName(t)
    return best, results, allt
