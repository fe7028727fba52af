"""Scores of many candidates over shared folds.

Work that candidates have in common is done once:

* folds and their (resampled) training rows are written once, in as many partitions as their bytes ask for;
* naive Bayes: one table of moments per fold and class; a training set is the other folds' moments merged, for every smoothing;
* nearest neighbours: one search over all folds at the largest k per metric; each k and weighting is a prefix of its list;
* boosting: models of one depth grow in step over all folds, a job a level (``boosting``); fewer rounds are the first trees of the most.
* candidates that differ only in what their model does not use (the linear SVM's gamma) share a fit; nothing here reads probabilities, so none are fitted.

Every candidate keeps its own score, the one a fit of its own would get; the other families are fitted one by one.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import boosting, learners, metrics
from .neighbors import knn

#: Bytes of a training partition, at every size of table.
PARTITION_BYTES = 32 << 20


def by_bytes(df: DataFrame, n_rows: int) -> DataFrame:
    """No more partitions than the rows' bytes ask for (eight bytes a value)."""
    return df.coalesce(max(1, math.ceil(n_rows * len(df.columns) * 8 / PARTITION_BYTES)))


@dataclass
class Folds:
    """Rows with their fold, and the training rows of each fold (its own rows left out, resampled if asked)."""
    rows: DataFrame
    train: dict[int, DataFrame]
    n_train: dict[int, int]
    resampled: bool

    def persist(self) -> Folds:
        level = StorageLevel.MEMORY_AND_DISK
        return replace(self, rows=self.rows.persist(level), train={f: t.persist(level) for f, t in self.train.items()})

    def unpersist(self) -> None:
        for t in (self.rows, *self.train.values()):
            t.unpersist()


def build_folds(data: DataFrame, features: list[str], label: str = "label", key: list[str] | None = None, resample=None, parallelism: int = 4) -> Folds:
    """``data`` has a ``fold`` column.  ``resample`` sees one fold's training rows only, so synthetic rows never reach the fold that scores them."""
    spark, path = data.sparkSession, scratch_path(data.sparkSession, "folds")
    keep = dict.fromkeys([*(key or []), label, *features])
    data.select(*keep, "fold").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    counts = {r["fold"]: r["c"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("c")).collect()}
    total = sum(counts.values())
    rows = by_bytes(rows, total)

    def one(f: int) -> tuple[int, DataFrame, int, bool]:
        plain = rows.where(F.col("fold") != f).select(*keep)
        t = resample(plain) if resample else plain
        if t is plain:
            return f, plain, total - counts[f], False
        t.select(*keep).write.parquet(f"{path}/train-{f}")
        t = spark.read.parquet(f"{path}/train-{f}")
        n = t.count()
        return f, by_bytes(t, n), n, True

    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        made = list(ex.map(one, sorted(counts)))
    return Folds(rows, {f: t for f, t, _, _ in made}, {f: n for f, _, n, _ in made}, any(r for *_, r in made))


def scores(folds: Folds, features: list[str], problem_type: str, metric: str, candidates: list[tuple[str, dict]], label: str = "label",
           key: list[str] | None = None, parallelism: int = 4, n_classes: int | None = None) -> list[tuple[int, int, float]]:
    """(candidate, fold, score) of every candidate over every fold, in that order."""
    if n_classes is None and problem_type == "classification":
        n_classes = int(folds.rows.agg(F.max(label)).first()[0]) + 1
    folds = folds.persist()
    numbered = [(ci, name, params) for ci, (name, params) in enumerate(candidates)]
    args = (features, problem_type, metric, label, n_classes)
    jobs = []
    bayes = [(ci, p) for ci, name, p in numbered if name == "Naive Bayes"]
    if bayes:
        jobs.append(lambda: _naive_bayes(folds, bayes, *args))
    near = defaultdict(list)
    boosted = defaultdict(list)
    for ci, name, p in numbered:
        if name == "KNN":
            near[p.get("metric", "euclidean")].append((ci, p))
        elif name == "Gradient Boosting" and (problem_type != "classification" or n_classes <= 2):
            boosted[int(p.get("max_depth", 3))].append((ci, p))
    if boosted:
        ends = _boosting_cuts(folds, features, label, parallelism)
    # longest first, so that the pool ends evenly
    for _, members in sorted(boosted.items(), reverse=True):
        jobs.append(lambda members=members: _boosting(folds, ends, members, *args))
    for how, members in near.items():
        jobs.append(lambda how=how, members=members: _neighbors(folds, how, members, key, *args))
    done = {ci for group in (bayes, *near.values(), *boosted.values()) for ci, _ in group}
    alike = defaultdict(list)
    for ci, name, p in numbered:
        if ci not in done:
            alike[name, tuple(sorted((k, str(v)) for k, v in p.items() if k in _used(name, p)))].append((ci, p))
    for ((name, _), members), f in itertools.product(alike.items(), folds.train):
        jobs.append(lambda name=name, members=members, f=f: _single(folds, f, [ci for ci, _ in members], name, members[0][1], *args))
    try:
        with ThreadPoolExecutor(max(1, parallelism)) as ex:
            return sorted(row for found in ex.map(lambda job: job(), jobs) for row in found)
    finally:
        folds.unpersist()


def _measured(pred: DataFrame, metric: str, problem_type: str, label: str) -> list[tuple[int, int, float]]:
    """Scores of predictions that carry their candidate and fold."""
    by = ["candidate", "fold"]
    if problem_type == "classification":
        m = metrics.classification_metrics(pred, label, by=by)
        column = {"f1": "f1_binary", "f1_weighted": "f1", "f1_macro": "f1_macro", "accuracy": "accuracy"}[metric]
    else:
        m, column = metrics.regression_metrics(pred, label, by=by), metric
    return [(r["candidate"], r["fold"], float(r[column])) for r in m.select(*by, column).collect()]  # candidates times folds rows


def _used(name: str, params: dict) -> list[str]:
    """The parameters that the model depends on."""
    return [k for k in params if not (name == "SVM" and k == "gamma" and params.get("kernel", "rbf") != "rbf")]


def _single(folds, f, cis, name, params, features, problem_type, metric, label, n_classes):
    """One fit, and its score for every candidate it stands for."""
    m = learners.fit(name, folds.train[f], features, problem_type, label, params, n_rows=folds.n_train[f], n_classes=n_classes, probabilities=False)
    pred = m.transform(folds.rows.where(F.col("fold") == f)).select(F.lit(cis[0]).alias("candidate"), F.lit(f).alias("fold"), label, "prediction")
    return [(ci, f, score) for _, _, score in _measured(pred, metric, problem_type, label) for ci in cis]


def _merged(moments: list[dict], n_features: int) -> dict:
    """Count, means and population variances of several sets of rows taken together."""
    n = sum(m["n"] for m in moments)
    mean = [sum(m["n"] * m["mean"][i] for m in moments) / n for i in range(n_features)]
    var = [sum(m["n"] * (m["var"][i] + (m["mean"][i] - mean[i]) ** 2) for m in moments) / n for i in range(n_features)]
    return {"cls": moments[0]["cls"], "n": n, "mean": mean, "var": var}


def _naive_bayes(folds, members, features, problem_type, metric, label, n_classes):
    if folds.resampled:
        rows = reduce(DataFrame.unionByName, [t.withColumn("fold", F.lit(f)) for f, t in folds.train.items()])
        own = learners.gnb_moments(rows, features, label, "fold")
    else:
        parts = learners.gnb_moments(folds.rows, features, label, "fold")
        own = {}
        for f in folds.train:
            others = defaultdict(list)
            for g, rows in parts.items():
                for m in rows if g != f else ():
                    others[m["cls"]].append(m)
            own[f] = [_merged(others[c], len(features)) for c in sorted(others)]
    preds = []
    for f in folds.train:  # one pass over a fold's rows for all candidates
        rows = folds.rows.where(F.col("fold") == f)
        for ci, p in members:
            m = learners.gnb_from_moments(own[f], features, float(p.get("var_smoothing", 1e-9)), n_classes)
            rows = m.transform(rows).withColumnRenamed("prediction", f"_p{ci}").drop("probability", "score")
        each = F.array(*[F.struct(F.lit(ci).alias("candidate"), F.col(f"_p{ci}").alias("prediction")) for ci, _ in members])
        preds.append(rows.select("fold", label, F.explode(each).alias("_c")).select("_c.candidate", "fold", label, "_c.prediction"))
    return _measured(reduce(DataFrame.unionByName, preds), metric, problem_type, label)


def neighbor_predictions(folds, how, members, key, features, problem_type, label):
    """candidate, fold, label, prediction of every KNN candidate of one metric, from one list of neighbours a row."""
    if not key:
        raise ValueError("KNN needs the row key columns")
    k = max(int(p.get("n_neighbors", 5)) for _, p in members)
    ref = reduce(DataFrame.unionByName, [t.withColumn("fold", F.lit(f)) for f, t in folds.train.items()])
    vector = [f for f in features if f not in key]
    ref = ref.select(*key, *vector, "fold", F.col(label).cast("double").alias("_y"))
    query = folds.rows.select(*key, *vector, "fold", F.col(label).alias("_label"))
    nn = knn(query, ref, features, k, [*key, "_label"], [*key, "_y"], group="fold", metric=how)
    row = [*[f"q_{c}" for c in key], "q__label", "fold"]
    plan = F.array(*[F.struct(F.lit(ci).alias("candidate"), F.lit(int(p.get("n_neighbors", 5))).alias("k"),
                              F.lit(p.get("weights", "uniform")).alias("weights")) for ci, p in members])
    votes = nn.select(*row, "r__y", "dist", F.explode(F.filter(plan, lambda c: c["k"] >= F.col("nn_rank"))).alias("c"))
    votes = votes.select(*row, F.col("c.candidate").alias("candidate"), F.col("r__y").alias("y"),
                         F.when(F.col("c.weights") == "uniform", 1.0).when(F.col("dist") == 0, 1e300).otherwise(1.0 / F.col("dist")).alias("w"))
    if problem_type == "classification":
        votes = votes.groupBy(*row, "candidate", "y").agg(F.sum("w").alias("w"))
        best = F.max_by("y", F.struct("w", (-F.col("y")).alias("first")))  # the first class of the most weight
    else:
        best = F.sum(F.col("y") * F.col("w")) / F.sum("w")
    return votes.groupBy(*row, "candidate").agg(best.alias("prediction")).select("candidate", "fold", F.col("q__label").alias(label), "prediction")


def _neighbors(folds, how, members, key, features, problem_type, metric, label, n_classes):
    return _measured(neighbor_predictions(folds, how, members, key, features, problem_type, label), metric, problem_type, label)


def _boosting_cuts(folds, features, label, parallelism):
    def of(f):
        return boosting.cuts(boosting.points(folds.train[f], features, label), folds.n_train[f], len(features))

    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        return dict(zip(folds.train, ex.map(of, folds.train)))


def _boosting(folds, ends, members, features, problem_type, metric, label, n_classes):
    rounds = {ci: int(p.get("n_estimators", 100)) for ci, p in members}
    alike = defaultdict(list)  # candidates that differ in rounds only are prefixes of one model
    for ci, p in members:
        alike[boosting.Spec.of(p, 0)].append(ci)
    specs = [replace(s, rounds=max(rounds[ci] for ci in of)) for s, of in alike.items()]
    train = {f: boosting.points(t, features, label) for f, t in folds.train.items()}
    trees = boosting.fit(train, folds.n_train, ends, problem_type, specs)
    models = {f: {ci: (s.step, trees[f, i], rounds[ci]) for i, (s, of) in enumerate(zip(specs, alike.values())) for ci in sorted(of, key=rounds.get)}
              for f in folds.train}
    rows = boosting.points(folds.rows, features, label, "fold").repartition(folds.rows.sparkSession.sparkContext.defaultParallelism)
    return _measured(boosting.predictions(rows, label, ends, problem_type, models), metric, problem_type, label)
