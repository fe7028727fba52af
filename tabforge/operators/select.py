"""Feature selection.

Variance, correlation and univariate F scores are each one aggregation:
wide aggregates over all features, grouped by class for ANOVA so partial
aggregation leaves one row per class before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .eda import correlation_long

# Fixed values of the selection rules.
VAR_THRESHOLD = 0.01
CORR_THRESHOLD = 0.90
TOP_K = 10


def _long(items, name):
    return F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("feature"), e.alias(name))
                              for i, c, e in items]))


def variance_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Population variance per feature and the keep flag."""
    if not features:
        raise ValueError("No features remaining.")
    a = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(features)])
    t = a.select(_long([(i, c, F.col(f"v{i}")) for i, c in enumerate(features)], "variance"))
    return t.withColumn("keep", F.coalesce(F.col("variance") > VAR_THRESHOLD, F.lit(False)))


def correlated_drops(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature j is dropped when some earlier i has |r| > 0.9 (i may itself be dropped)."""
    c = correlation_long(df, features)
    return (c.where((F.col("i") < F.col("j")) & (F.abs(F.col("corr")) > CORR_THRESHOLD))
             .groupBy(F.col("j").alias("ordinal"), F.col("col_b").alias("feature"))
             .agg(F.min("i").alias("first_partner")))


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature (between / within mean squares).

    Grouping by class gives n, sum and sum of squares per (class, feature);
    the F statistics follow from that k-row table.
    """
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                              *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)],
                              *[F.sum(F.col(c).cast("double") ** 2).alias(f"q{i}") for i, c in enumerate(features)])
    aggs = [F.sum("n").alias("N"), F.count(F.lit(1)).alias("K")]
    for i in range(len(features)):
        aggs += [F.sum(f"s{i}").alias(f"S{i}"), F.sum(f"q{i}").alias(f"Q{i}"),
                 F.sum(F.col(f"s{i}") ** 2 / F.col("n")).alias(f"B{i}")]
    t = g.agg(*aggs)
    items = []
    for i, c in enumerate(features):
        n, k = F.col("N").cast("double"), F.col("K").cast("double")
        sstot = F.col(f"Q{i}") - F.col(f"S{i}") ** 2 / n
        ssbn = F.col(f"B{i}") - F.col(f"S{i}") ** 2 / n
        sswn = sstot - ssbn
        f = F.try_divide(F.try_divide(ssbn, k - 1), F.try_divide(sswn, n - k))
        items.append((i, c, f))
    return t.select(_long(items, "score"))


def regression_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2); constant sides score 0."""
    y = F.col(label).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("sy")]
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"sx{i}")]
    t = df.agg(*aggs)
    items = []
    for i, c in enumerate(features):
        r = F.try_divide(F.col(f"c{i}"), F.col(f"sx{i}") * F.col("sy"))
        r2 = r * r
        f = F.when((F.col(f"sx{i}") == 0) | (F.col("sy") == 0), F.lit(0.0)).otherwise(
            F.try_divide(r2, 1 - r2) * (F.col("n") - 2))
        items.append((i, c, f))
    return t.select(_long(items, "score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """T5: k best by score (NaN/NULL lowest, ties to the later column), kept in column order.

    The window runs over the small score table (one row per feature).
    """
    w = Window.orderBy(F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double"))), F.desc("ordinal"))
    return (scores.withColumn("rank", F.row_number().over(w))
                  .withColumn("selected", F.col("rank") <= k))


@dataclass
class Selection:
    selected: list[str]
    variance: DataFrame
    dropped_corr: list[str]
    scores: DataFrame


def select_features(df: DataFrame, features: list[str], label: str, problem_type: str,
                    k: int = TOP_K) -> Selection:
    """Variance filter -> correlation filter -> univariate top-k."""
    var = variance_table(df, features)
    kept = [r["feature"] for r in var.where("keep").orderBy("ordinal").collect()]
    if not kept:
        raise ValueError("No features left after the variance filter.")
    drops = [r["feature"] for r in correlated_drops(df, kept).collect()] if len(kept) > 1 else []
    kept = [c for c in kept if c not in set(drops)]
    kk = min(k, len(kept))
    sc = anova_f(df, kept, label) if problem_type == "classification" else regression_f(df, kept, label)
    ranked = top_k(sc, kk)
    sel = [r["feature"] for r in ranked.where("selected").orderBy("ordinal").collect()]
    return Selection(sel, var, drops, ranked)
