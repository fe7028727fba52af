"""Data-quality checks and score.

Every check is one aggregation over the data; the results are small
finding tables (one row per column at most) that the report unions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import round_half_even

# Thresholds and penalties of the quality rules.
MISSING_TIERS = [(40, 15, "CRITICAL"), (20, 8, "WARNING"), (0, 3, "INFO")]
IMBALANCE_TIERS = [(10, 20, "CRITICAL"), (20, 10, "WARNING")]
DUPLICATE_TIERS = [(10, 10, "CRITICAL"), (5, 5, "WARNING")]
OUTLIER_Z = 3.0
OUTLIER_PCT = 10.0
OUTLIER_PENALTY = 5
LABELS = [(80, "Good"), (60, "Moderate"), (40, "Poor")]

FINDING_COLS = ["check", "ordinal", "column_name", "penalty", "severity", "message"]


def _fmt1(c: Column) -> Column:
    return F.format_string("%.1f", c)


def missing_table(df: DataFrame) -> DataFrame:
    """A1: per column with nulls: n_missing, missing_pct (2 dp), penalty, severity, message."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = agg.select(F.col("_n").alias("n_rows"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                 F.col(f"_m{i}").alias("n_missing")) for i, c in enumerate(cols)])))
    raw = F.try_divide(F.col("n_missing"), F.col("n_rows")) * 100.0
    long = long.withColumn("missing_raw", raw).where(F.col("missing_raw") > 0)
    pct = F.col("missing_pct")
    long = long.withColumn("missing_pct", round_half_even(F.col("missing_raw"), 2))
    pen = F.when(pct > 40, 15).when(pct > 20, 8).when(pct > 0, 3).otherwise(0)
    sev = F.when(pct > 40, "CRITICAL").when(pct > 20, "WARNING").when(pct > 0, "INFO")
    p = pct.cast("string")
    msg = (F.when(pct > 40, F.concat(F.lit("CRITICAL: '"), F.col("column_name"), F.lit("' has "), p,
                                     F.lit("% missing values. Consider dropping.")))
            .when(pct > 20, F.concat(F.lit("WARNING: '"), F.col("column_name"), F.lit("' has "), p,
                                     F.lit("% missing values.")))
            .when(pct > 0, F.concat(F.lit("INFO: '"), F.col("column_name"), F.lit("' has "), p,
                                    F.lit("% missing values."))))
    return long.select("ordinal", "column_name", "n_missing", "missing_raw", "missing_pct",
                       pen.alias("penalty"), sev.alias("severity"), msg.alias("message"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """A3: value counts of the target (nulls excluded), descending, ties by value."""
    return (df.where(F.col(target).isNotNull()).groupBy(target)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(target)))


def imbalance_table(df: DataFrame, target: str, problem_type: str) -> DataFrame:
    """A4: minority share over all rows; one finding row (none for regression)."""
    if problem_type != "classification":
        return df.sparkSession.createDataFrame(
            [], "minority_pct double, n_classes bigint, penalty int, severity string, message string")
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    a = g.agg(F.sum("c").alias("total"),
              F.min(F.when(F.col(target).isNotNull(), F.col("c"))).alias("min_c"),
              F.count(F.col(target)).alias("n_classes"))
    pct = F.col("minority_pct")
    a = a.withColumn("minority_pct", F.try_divide(F.col("min_c"), F.col("total")) * 100.0)
    pen = F.when(pct < 10, 20).when(pct < 20, 10).otherwise(0)
    sev = F.when(pct < 10, "CRITICAL").when(pct < 20, "WARNING").otherwise("INFO")
    msg = (F.when(pct < 10, F.concat(F.lit("CRITICAL: Severe class imbalance. Minority class is only "),
                                     _fmt1(pct), F.lit("% of data. SMOTE will be applied.")))
            .when(pct < 20, F.concat(F.lit("WARNING: Class imbalance detected. Minority class is "),
                                     _fmt1(pct), F.lit("% of data.")))
            .otherwise(F.concat(F.lit("INFO: Class distribution is acceptable. Minority class is "),
                                _fmt1(pct), F.lit("% of data."))))
    return a.select("minority_pct", F.col("n_classes").cast("bigint"), pen.alias("penalty"),
                    sev.alias("severity"), msg.alias("message"))


def duplicate_table(df: DataFrame) -> DataFrame:
    """A5: rows minus distinct rows (NULLs equal), share and penalty.

    One grouping over all columns; map-side partial aggregation collapses a
    hot duplicate group before the shuffle.
    """
    g = df.groupBy(*[F.col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("c"))
    a = g.agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("duplicate_rows"))
    pct = F.col("duplicate_pct")
    a = a.select(F.col("n_rows").cast("bigint"), F.col("duplicate_rows").cast("bigint"),
                 (F.try_divide(F.col("duplicate_rows"), F.col("n_rows")) * 100.0).alias("duplicate_pct"))
    pen = F.when(pct > 10, 10).when(pct > 5, 5).otherwise(0)
    sev = F.when(pct > 10, "CRITICAL").when(pct > 5, "WARNING").otherwise("INFO")
    d = F.col("duplicate_rows").cast("string")
    msg = (F.when(pct > 10, F.concat(F.lit("CRITICAL: "), d, F.lit(" duplicate rows ("), _fmt1(pct),
                                     F.lit("%). Remove before training.")))
            .when(pct > 5, F.concat(F.lit("WARNING: "), d, F.lit(" duplicate rows ("), _fmt1(pct),
                                    F.lit("%) found.")))
            .otherwise(F.concat(F.lit("INFO: "), d, F.lit(" duplicate rows found. Acceptable."))))
    return a.select("*", pen.alias("penalty"), sev.alias("severity"), msg.alias("message"))


def moments(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """Pass 1 of A6: (count, mean, sample sd) per column, one aggregation."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"n{i}"], r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def outlier_table(df: DataFrame, numeric_cols: list[str]) -> DataFrame:
    """|z| > 3 with the sample sd; fitted mean/sd re-enter as literals."""
    spark = df.sparkSession
    schema = ("ordinal int, column_name string, n_nonnull bigint, outliers bigint, outlier_pct double, "
              "penalty int, severity string, message string")
    if not numeric_cols:
        return spark.createDataFrame([], schema)
    st = moments(df, numeric_cols)
    aggs = []
    for i, c in enumerate(numeric_cols):
        n, mu, sd = st[c]
        if n and sd is not None and sd > 0:
            z = F.abs((F.col(c).cast("double") - F.lit(mu)) / F.lit(sd))
            aggs.append(F.count_if(z > OUTLIER_Z).alias(f"o{i}"))
        else:
            aggs.append(F.lit(0).cast("bigint").alias(f"o{i}"))
    a = df.agg(*aggs)
    long = a.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                 F.lit(st[c][0]).cast("bigint").alias("n_nonnull"),
                 F.col(f"o{i}").cast("bigint").alias("outliers"))
        for i, c in enumerate(numeric_cols)])))
    pct = F.col("outlier_pct")
    long = long.withColumn("outlier_pct", F.try_divide(F.col("outliers"), F.col("n_nonnull")) * 100.0)
    o = F.col("outliers").cast("string")
    return long.select(
        "ordinal", "column_name", "n_nonnull", "outliers", "outlier_pct",
        F.when(pct > OUTLIER_PCT, OUTLIER_PENALTY).otherwise(0).alias("penalty"),
        F.when(pct > OUTLIER_PCT, "WARNING").when(F.col("outliers") > 0, "INFO").alias("severity"),
        F.when(pct > OUTLIER_PCT, F.concat(F.lit("WARNING: '"), F.col("column_name"), F.lit("' has "), o,
                                           F.lit(" outliers ("), _fmt1(pct), F.lit("%).")))
         .when(F.col("outliers") > 0, F.concat(F.lit("INFO: '"), F.col("column_name"), F.lit("' has "), o,
                                               F.lit(" outliers."))).alias("message"))


def quality_score(total_penalty: Column) -> Column:
    """max(0, 100 - penalties), one decimal."""
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - total_penalty.cast("double")), 1)


def quality_label(score: Column) -> Column:
    """A8."""
    return (F.when(score >= 80, "Good").when(score >= 60, "Moderate")
             .when(score >= 40, "Poor").otherwise("Critical"))


@dataclass
class QualityReport:
    missing: DataFrame
    distribution: DataFrame
    imbalance: DataFrame
    duplicates: DataFrame
    outliers: DataFrame
    warnings: DataFrame
    summary: DataFrame


def run_quality_check(df: DataFrame, kinds: dict[str, str], target: str,
                      problem_type: str) -> QualityReport:
    """All checks, warnings merged in check order, one-row summary."""
    numeric = [c for c, k in kinds.items() if k == "numerical" and c in df.columns]
    miss = missing_table(df)
    imb = imbalance_table(df, target, problem_type)
    dup = duplicate_table(df)
    out = outlier_table(df, numeric)
    w = (miss.where(F.col("message").isNotNull())
             .select(F.lit(1).alias("part"), "ordinal", "severity", "message")
         .unionByName(imb.select(F.lit(2).alias("part"), F.lit(0).alias("ordinal"), "severity", "message"))
         .unionByName(dup.select(F.lit(3).alias("part"), F.lit(0).alias("ordinal"), "severity", "message"))
         .unionByName(out.where(F.col("message").isNotNull())
                         .select(F.lit(4).alias("part"), "ordinal", "severity", "message")))
    warnings = w.select(((F.col("part") * 100000) + F.col("ordinal")).alias("seq"), "severity", "message")
    parts = (miss.select(F.lit(1).alias("part"), "penalty", F.lit(None).cast("bigint").alias("dups"))
             .unionByName(imb.select(F.lit(2).alias("part"), "penalty", F.lit(None).cast("bigint").alias("dups")))
             .unionByName(dup.select(F.lit(3).alias("part"), "penalty", F.col("duplicate_rows").alias("dups")))
             .unionByName(out.select(F.lit(4).alias("part"), "penalty", F.lit(None).cast("bigint").alias("dups"))))

    def _pen(k):
        return F.coalesce(F.sum(F.when(F.col("part") == k, F.col("penalty"))), F.lit(0))

    pens = parts.agg(_pen(1).alias("missing_penalty"), _pen(2).alias("imbalance_penalty"),
                     _pen(3).alias("duplicate_penalty"), _pen(4).alias("outlier_penalty"),
                     F.max("dups").alias("duplicate_rows"))
    total = (F.col("missing_penalty") + F.col("imbalance_penalty") + F.col("duplicate_penalty")
             + F.col("outlier_penalty"))
    summary = pens.select(
        quality_score(total).alias("quality_score"),
        quality_label(quality_score(total)).alias("quality_label"),
        F.col("missing_penalty").cast("int"), F.col("imbalance_penalty").cast("int"),
        F.col("duplicate_penalty").cast("int"), F.col("outlier_penalty").cast("int"),
        total.cast("int").alias("total_penalty"), F.col("duplicate_rows").cast("bigint"))
    return QualityReport(miss, class_counts(df, target) if problem_type == "classification" else None,
                         imb, dup, out, warnings, summary)
