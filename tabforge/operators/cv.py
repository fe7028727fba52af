"""Cross-validation, leaderboard and refit.

Folds come from the stable-hash rank (``split.assign_folds``), so every
model sees the same folds and the assignment can be re-derived in SQL.
Fits are independent Spark jobs and run concurrently from a thread pool, as
``CrossValidator(parallelism=...)`` does; ``search`` does shared work once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learners, metrics, search

# The imbalance threshold behind the metric choice.
F1_MINORITY_PCT = 20.0


def scoring_metric(train: DataFrame, label: str, problem_type: str) -> str:
    """L2: 'f1' (binary) / 'f1_macro' (multiclass) when the minority is under 20 %,
    else 'f1_weighted'; 'r2' for regression."""
    if problem_type != "classification":
        return "r2"
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    a = g.agg(F.min("c").alias("mn"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if a["mn"] / a["n"] * 100 < F1_MINORITY_PCT:
        return "f1" if a["k"] <= 2 else "f1_macro"
    return "f1_weighted"


def evaluate(pred: DataFrame, metric: str, label: str = "label") -> float:
    """One metric value from a prediction frame (one small job)."""
    if metric in ("r2", "mae", "rmse", "mse"):
        r = metrics.regression_metrics(pred, label).first()
        return float(r[metric])
    r = metrics.classification_metrics(pred, label).first()
    col = {"f1": "f1_binary", "f1_weighted": "f1", "f1_macro": "f1_macro", "accuracy": "accuracy"}[metric]
    return float(r[col])


@dataclass
class CVRun:
    scores: DataFrame        # (model, zoo_index, candidate, fold, score)
    summary: DataFrame       # (model, zoo_index, candidate, mean_score, std_score)


def fold_scores(data: DataFrame | search.Folds, features: list[str], problem_type: str, metric: str,
                candidates: list[tuple[str, dict]], label: str = "label", key: list[str] | None = None,
                parallelism: int = 4, n_classes: int | None = None, resample=None) -> list[tuple[int, int, float]]:
    """Score every (candidate, fold); ``data`` has a ``fold`` column, or is a set of folds built before.

    ``resample(train_df) -> train_df`` runs inside each training fold (so
    synthetic rows never leak into the fold that scores them).
    """
    folds = data if isinstance(data, search.Folds) else search.build_folds(data, features, label, key, resample, parallelism)
    return search.scores(folds, features, problem_type, metric, candidates, label, key, parallelism, n_classes)


def cross_validate(data: DataFrame | search.Folds, features: list[str], problem_type: str, metric: str,
                   names: list[str] | None = None, label: str = "label", key: list[str] | None = None,
                   parallelism: int = 4, n_classes: int | None = None, resample=None) -> CVRun:
    """L4: 5-fold scores per model, mean and population std (4 dp)."""
    names = names or learners.model_names(problem_type)
    res = fold_scores(data, features, problem_type, metric, [(n, {}) for n in names], label=label, key=key,
                      parallelism=parallelism, n_classes=n_classes, resample=resample)
    spark = (data.rows if isinstance(data, search.Folds) else data).sparkSession
    return _summarise(spark, [(names[ci], ci, 0, f, s) for ci, f, s in res])


def _summarise(spark, rows) -> CVRun:
    sc = spark.createDataFrame(rows, "model string, zoo_index int, candidate int, fold int, score double")
    summ = (sc.groupBy("model", "zoo_index", "candidate")
              .agg(F.bround(F.avg("score"), 4).alias("mean_score"), F.bround(F.stddev_pop("score"), 4).alias("std_score")))
    return CVRun(sc, summ)


def leaderboard(summary: DataFrame) -> DataFrame:
    """Mean score descending; ties keep the zoo order."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("mean_score"), "zoo_index")      # one row per model
    return summary.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def top_models(board: DataFrame, n: int) -> list[str]:
    """T2 (n=1) / T3 (n=3)."""
    return [r["model"] for r in board.where(F.col("rank") <= n).orderBy("rank").collect()]


def holdout_metrics(pred: DataFrame, problem_type: str, label: str = "label") -> DataFrame:
    """M1: accuracy + weighted precision/recall/F1, or mae/rmse/r2 (4 dp)."""
    if problem_type == "classification":
        m = metrics.classification_metrics(pred, label)
        return m.select(*[F.bround(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
    m = metrics.regression_metrics(pred, label)
    return m.select(*[F.bround(c, 4).alias(c) for c in ("mae", "rmse", "r2")])


def population_std(xs: list[float]) -> float:
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))
