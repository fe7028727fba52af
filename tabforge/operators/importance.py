"""Feature importance.

Permutation importance is one Spark job, not features x repeats jobs: every
(feature, repeat) has a permutation of its own.  A test row sends its feature
values, one narrow row each, to the row index that takes them (computed
arithmetically, no sort) and one equi-join with the test rows makes all
variants; the model scores them in one ``transform`` and a grouped aggregation
yields every score at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED
from ..session import scratch_path
from .split import rank_within

N_REPEATS = 10


def tree_importance(model, features: list[str]) -> DataFrame | None:
    """The model's own impurity importances (None for non-tree models)."""
    if model.name not in ("Decision Tree", "Random Forest", "Gradient Boosting"):
        return None
    imp = model.importances()
    if imp is None:
        return None
    spark = _spark()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                 "feature string, importance double").orderBy(F.desc("importance"), "feature")


def forest_importance(train: DataFrame, features: list[str], problem_type: str, label: str = "label",
                      n_classes=None) -> DataFrame:
    """A fresh 100-tree forest (seed 42) on the training rows."""
    from . import learners
    m = learners.fit("Random Forest", train, features, problem_type, label, {"n_estimators": 100},
                     n_classes=n_classes)
    return train.sparkSession.createDataFrame(
        [(f, float(v)) for f, v in zip(features, m.importances())],
        "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def _grouped_score(pred: DataFrame, problem_type: str, groups: list[str], label: str = "label") -> DataFrame:
    """Accuracy (classifiers) or R^2 (regressors) per group, the default scorers."""
    y, p = F.col(label).cast("double"), F.col("prediction").cast("double")
    if problem_type == "classification":
        return pred.groupBy(*groups).agg(F.avg((y == p).cast("double")).alias("score"))
    a = pred.groupBy(*groups).agg(F.sum((y - p) ** 2).alias("ss_res"), (F.var_pop(y) * F.count(y)).alias("ss_tot"))
    return a.select(*groups, F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0))
                    .otherwise(1 - F.col("ss_res") / F.col("ss_tot")).alias("score"))


def _primes(lo: int, count: int) -> list[int]:
    """The first ``count`` primes at or above ``lo`` (trial division; a rule, not a table)."""
    out, x = [], lo
    while len(out) < count:
        if all(x % d for d in range(2, int(x ** 0.5) + 1)):
            out.append(x)
        x += 1
    return out


PERM_PRIMES = _primes(1_000_003, 256)


def replica_params(n_replicas: int, seed=SEED) -> list[tuple[int, int, int, int]]:
    """Per replica s: three candidate primes and a raw offset, all from md5(s|seed)."""
    import hashlib
    out = []
    for s in range(n_replicas):
        h = hashlib.md5(f"{s}|{seed}|perm".encode()).hexdigest()
        k = int(h[:8], 16) % (len(PERM_PRIMES) - 3)
        out.append((PERM_PRIMES[k], PERM_PRIMES[k + 1], PERM_PRIMES[k + 2], int(h[8:20], 16)))
    return out


def permutation_importance(model, test: DataFrame, features: list[str], key: list[str], problem_type: str,
                           label: str = "label", n_repeats: int = N_REPEATS, seed=SEED) -> DataFrame:
    """Mean and population std of (baseline - permuted score) per feature.

    Rows get an index i in [0, n) by hash rank.  Replica s = (feature, repeat)
    gives row i the feature value of row (p_s * i + b_s) mod n, where p_s is a
    prime not dividing n: a bijection, so each value is used exactly once.  Row
    j sends its values to the rows that take them, (j - b_s) / p_s mod n.
    """
    spark = test.sparkSession
    path = scratch_path(spark, "permutation")
    (rank_within(test.select(*key, *features, label), key, None, seed, "perm-base", None, "_r")
     .select((F.col("_r") - 1).alias("_i"), *key, *[F.col(f).cast("double").alias(f) for f in features if f not in key], label).write.parquet(path))
    idx = spark.read.parquet(path)
    n = idx.count()
    base_score = _grouped_score(model.transform(idx).withColumn("_g", F.lit(0)), problem_type, ["_g"], label).first()["score"]
    # the row index times an inverse below n: decimal where a bigint does not hold it
    whole = "bigint" if n < 3_000_000_000 else "decimal(38,0)"
    given = []
    for s, (p1, p2, p3, braw) in enumerate(replica_params(len(features) * n_repeats, seed)):
        p = next(q for q in (p1, p2, p3) if n % q != 0)
        to = F.pmod((F.col("_i").cast(whole) - F.lit(braw % n).cast(whole)) * F.lit(pow(p, -1, n)).cast(whole), F.lit(n).cast(whole))
        given.append(F.struct(to.cast("bigint").alias("_i"), F.lit(s).alias("_s"), F.col(features[s // n_repeats]).cast("double").alias("_x")))
    sent = idx.select(F.explode(F.array(*given)).alias("_v")).select("_v.*")
    # a data-sized side: never broadcast, however small its files look
    j = sent.join(idx.hint("shuffle_hash"), "_i").withColumns({"_f": F.floor(F.col("_s") / n_repeats).cast("int"), "_r": F.col("_s") % n_repeats})
    permuted = j.select(*key, label, "_f", "_r", *[F.when(F.col("_f") == i, F.col("_x")).otherwise(F.col(f)).alias(f)
                                                   for i, f in enumerate(features) if f not in key])
    s = _grouped_score(model.transform(permuted), problem_type, ["_f", "_r"], label)
    imp = s.withColumn("drop", F.lit(base_score) - F.col("score"))
    a = imp.groupBy("_f").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
    names = F.array(*[F.lit(f) for f in features])
    return (a.select(F.element_at(names, F.col("_f") + 1).alias("feature"), "importance_mean", "importance_std")
             .orderBy(F.desc("importance_mean"), "feature"))


def summary(tree_rows: list | None, perm_rows: list | None, model_name: str) -> str:
    """I4: plain-language summary (safe when fewer than three features exist)."""
    lines = []
    if tree_rows:
        top = [r[0] for r in tree_rows[:3]]
        if len(top) >= 3:
            lines.append(f"According to {model_name}, the three most important factors are: "
                         f"{top[0]}, {top[1]}, and {top[2]}.")
        else:
            lines.append(f"According to {model_name}, the most important factors are: {', '.join(top)}.")
    if perm_rows:
        lines.append(f"Permutation analysis confirms that '{perm_rows[0][0]}' has the strongest actual impact on "
                     f"predictions — shuffling this feature causes the biggest drop in performance.")
    if tree_rows and len(tree_rows) >= 2:
        b = [r[0] for r in tree_rows[-2:]]
        lines.append(f"The least influential features are '{b[0]}' and '{b[1]}', which contribute minimally "
                     f"to the model's decisions.")
    return " ".join(lines)
