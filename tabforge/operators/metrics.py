"""Evaluation metrics from (label, prediction[, score]) columns.

Classification metrics reduce the predictions to a (label, prediction)
count table first (partial aggregation leaves at most C^2 rows), so every
metric after that is arithmetic on a tiny table.  ROC needs cumulative
counts over distinct scores: scores are bucketed, bucket totals give
offsets, and running sums are taken inside each bucket, never in one task
over all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROC_BUCKETS = 4096


def pair_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: tuple | list = ()) -> DataFrame:
    return (pred.groupBy(*by, F.col(label).cast("double").alias("actual"),
                         F.col(prediction).cast("double").alias("predicted"))
                .agg(F.count(F.lit(1)).alias("count")))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: list[float] | None = None) -> DataFrame:
    """M5: full square over the sorted label set, zero cells included."""
    pc = pair_counts(pred, label, prediction)
    if classes is None:
        rows = pc.select(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("actual", "predicted")))))
                         .alias("c")).first()["c"]
        classes = [float(x) for x in (rows or [])]
    spark = pred.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual double, predicted double")
    return (F.broadcast(grid).join(pc, ["actual", "predicted"], "left")   # C^2 rows: bounded
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: tuple | list = ()) -> DataFrame:
    """M6: precision, recall, f1 and support per class (0 where undefined), within each group of ``by``."""
    pc = pair_counts(pred, label, prediction, by)
    a = pc.groupBy(*by, F.col("actual").alias("cls")).agg(F.sum("count").alias("support"),
                                                     F.sum(F.when(F.col("actual") == F.col("predicted"),
                                                                  F.col("count")).otherwise(0)).alias("tp"))
    p = pc.groupBy(*by, F.col("predicted").alias("cls")).agg(F.sum("count").alias("n_pred"))
    t = a.join(p, [*by, "cls"], "full").fillna(0, ["support", "tp", "n_pred"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    t = t.withColumn("precision", prec.cast("double")).withColumn("recall", rec.cast("double"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return t.withColumn("f1", f1).select(*by, F.col("cls").alias("class"), "precision", "recall", "f1",
                                         F.col("support").cast("bigint"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           positive: float = 1.0, by: tuple | list = ()) -> DataFrame:
    """M1-M4: accuracy, weighted precision/recall/F1, macro F1 and binary F1 (one row, or one per group of ``by``)."""
    pc = per_class(pred, label, prediction, by)
    tot = F.sum("support")
    return pc.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), tot).alias("accuracy"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"),
        F.avg("f1").alias("f1_macro"),
        F.coalesce(F.max(F.when(F.col("class") == positive, F.col("f1"))), F.lit(0.0)).alias("f1_binary"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: tuple | list = ()) -> DataFrame:
    """Mae, mse, rmse, r2 in one aggregation (r2: 1 if perfect on a constant target, else 0)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = pred.groupBy(*by).agg(F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) ** 2).alias("mse"),
                 F.sum((y - p) ** 2).alias("ss_res"), (F.var_pop(y) * F.count(y)).alias("ss_tot"))
    r2 = (F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0))
           .otherwise(1 - F.col("ss_res") / F.col("ss_tot")))
    return a.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def _score_table(pred: DataFrame, label: str, score: str, buckets: int) -> DataFrame:
    """Distinct scores with positive/negative counts and an exact descending position."""
    g = (pred.groupBy(F.col(score).cast("double").alias("score"))
             .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
                  F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")))
    # bucket boundaries at approximate quantiles of the distinct scores, so
    # buckets stay balanced however the scores concentrate
    qs = g.agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10 * buckets)
               .alias("q")).first()["q"] or []
    splits = sorted(set(float(x) for x in qs if x is not None))
    from pyspark.ml.feature import Bucketizer
    if splits:
        bz = Bucketizer(splits=[float("-inf")] + splits + [float("inf")], inputCol="score", outputCol="_bk")
        g = bz.transform(g).withColumn("bucket", (F.lit(len(splits)) - F.col("_bk")).cast("int")).drop("_bk")
    else:
        g = g.withColumn("bucket", F.lit(0))
    # bucket 0 holds the highest scores
    tot = g.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    wb = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)   # <= buckets rows
    off = (tot.withColumn("op", F.coalesce(F.sum("bp").over(wb), F.lit(0)))
              .withColumn("on", F.coalesce(F.sum("bn").over(wb), F.lit(0))).select("bucket", "op", "on"))
    w = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return (g.join(F.broadcast(off), "bucket")
             .withColumn("tp", F.sum("pos").over(w) + F.col("op"))
             .withColumn("fp", F.sum("neg").over(w) + F.col("on")))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score",
              buckets: int = ROC_BUCKETS) -> DataFrame:
    """M7: (threshold, fpr, tpr) at every distinct score, plus the (0, 0) start."""
    t = _score_table(pred, label, score, buckets)
    tot = pred.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("P"),
                   F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("N")).first()
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    curve = t.select(F.col("score").alias("threshold"),
                     (F.col("fp") / F.lit(N if N else float("nan"))).alias("fpr"),
                     (F.col("tp") / F.lit(P if P else float("nan"))).alias("tpr"))
    start = pred.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(curve)


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score",
            buckets: int = ROC_BUCKETS) -> DataFrame:
    """M8: trapezoid area under M7 (ties grouped), as one row ``roc_auc``.

    Each distinct score adds pos * (negatives above it + neg/2); divided by P*N.
    """
    t = _score_table(pred, label, score, buckets)
    a = t.agg(F.sum(F.col("pos") * ((F.col("fp") - F.col("neg")) + F.col("neg") / 2.0)).alias("s"),
              F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # s counts, for each positive, the negatives scored above it (half for ties)
    return a.select(F.try_divide(F.col("P") * F.col("N") - F.col("s"), F.col("P") * F.col("N")).alias("roc_auc"))


def prediction_pairs(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every distinct (actual, predicted) pair with its count; nothing is binned."""
    return (pred.groupBy(F.col(label).cast("double").alias("actual"), F.col(prediction).cast("double").alias("predicted"))
                .agg(F.count(F.lit(1)).alias("n")))


def prediction_vs_actual(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                         bins: int = 50) -> DataFrame:
    """The scatter as a bins x bins count grid over the shared [min, max] range, with the diagonal ends."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    r = pred.agg(F.min(y).alias("ymin"), F.max(y).alias("ymax"), F.min(p).alias("pmin"),
                 F.max(p).alias("pmax")).first()
    lo = min(r["ymin"], r["pmin"])
    hi = max(r["ymax"], r["pmax"])
    w = (hi - lo) / bins if hi > lo else 1.0

    def cell(c):
        return F.least(F.floor((c - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    return (pred.groupBy(cell(y).alias("actual_bin"), cell(p).alias("predicted_bin"))
                .agg(F.count(F.lit(1)).alias("count"))
                .withColumn("diag_min", F.lit(r["ymin"])).withColumn("diag_max", F.lit(r["ymax"])))
