"""Report tables (R1-R8, S7, S8): the data of the HTML report, as DataFrames.

Inputs are the small stage outputs (findings, metrics, leaderboard), so
each table is a projection of a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report tiers, advice texts and the medal labels.
ADVICE = [(80, "good", "Your data is in good shape. The model should learn reliably from it."),
          (60, "moderate", "Your data has some issues. The model will still work but fixing these issues "
                           "would improve results."),
          (None, "poor", "Your data has serious issues. Consider cleaning it before trusting the model results.")]
MEDALS = ["gold", "silver", "bronze"]


def band(score):
    return F.when(score >= 80, "green").when(score >= 60, "amber").otherwise("red")


def headline(quality_summary: DataFrame, metrics_row: DataFrame, best_model: str, problem_type: str,
             n_models: int) -> DataFrame:
    """Quality score and colour band, best model, headline metric."""
    q = quality_summary.select("quality_score", "quality_label")
    if problem_type == "classification":
        m = metrics_row.select(F.format_string("%.1f%%", F.col("accuracy") * 100).alias("performance"),
                               F.lit("Model Accuracy").alias("performance_label"))
    else:
        m = metrics_row.select(F.format_string("%.2f", F.col("r2")).alias("performance"),
                               F.lit("R² Score").alias("performance_label"))
    qr, mr = q.first(), m.first()
    spark = quality_summary.sparkSession
    return spark.createDataFrame([(float(qr["quality_score"]), qr["quality_label"], best_model, mr["performance"],
                                   mr["performance_label"], n_models)],
                                 "quality_score double, quality_label string, best_model string, performance string, "
                                 "performance_label string, models_compared int").withColumn(
        "quality_band", band(F.col("quality_score")))


def quality_findings(warnings: DataFrame, score: float) -> DataFrame:
    """R2: advice tier plus each warning tagged and stripped of its severity prefix."""
    tier = next(t for t in ADVICE if t[0] is None or score >= t[0])
    clean = F.regexp_replace("message", "^(CRITICAL|WARNING|INFO): ", "")
    return warnings.select("seq", F.lower("severity").alias("tag"), clean.alias("text"), F.lit(tier[1]).alias("tier"),
                           F.lit(tier[2]).alias("advice"))


def class_shares(counts: DataFrame, target: str, total_rows: int) -> DataFrame:
    """Count and round(count / rows * 100, 1) per class."""
    return counts.select(F.col(target).cast("string").alias("class"), "count",
                         F.bround(F.col("count") / F.lit(float(total_rows)) * 100, 1).alias("pct"))


def eda_cards(stats: DataFrame) -> DataFrame:
    """R4."""
    return stats.select("total_rows", "total_columns", "missing_percentage", "duplicate_rows")


def leaderboard_view(board: DataFrame) -> DataFrame:
    """Rank, medal for the top three, score as a percentage, first seven."""
    medal = F.element_at(F.array(*[F.lit(m) for m in MEDALS]), F.col("rank").cast("int"))
    return (board.where(F.col("rank") <= 7)
                 .select("rank", "model", F.when(F.col("rank") <= 3, medal).otherwise(F.concat(F.col("rank").cast("string"), F.lit("."))).alias("medal"),
                         F.bround(F.col("mean_score") * 100, 1).alias("pct"), (F.col("rank") == 1).alias("is_best")))


def metric_cards(metrics_row: DataFrame, problem_type: str) -> DataFrame:
    """The metrics as (metric, value, display)."""
    if problem_type == "classification":
        names = [c for c in ("accuracy", "precision", "recall", "f1", "roc_auc") if c in metrics_row.columns]
        disp = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    else:
        names = [c for c in ("r2", "rmse", "mae") if c in metrics_row.columns]
        disp = lambda c: F.format_string("%.4f", F.col(c))
    return metrics_row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"),
                                                          disp(c).alias("display")) for c in names])))


def importance_section(imp: dict) -> DataFrame:
    """The three rankings with a method column (top 10 each), and the summary text on every row."""
    out = None
    for method in ("tree", "random_forest", "permutation"):
        t = imp.get(method)
        if t is None:
            continue
        col = "importance_mean" if method == "permutation" else "importance"
        r = (t.select(F.lit(method).alias("method"), "feature", F.col(col).alias("importance"))
              .orderBy(F.desc("importance"), "feature").limit(10))
        out = r if out is None else out.unionByName(r)
    return out if out is None else out.withColumn("summary", F.lit(imp.get("summary")))


def recommendation(best: str, tuned: dict | None, metrics_row: DataFrame, problem_type: str) -> DataFrame:
    """Best model, headline metric and one row per best parameter."""
    spark = metrics_row.sparkSession
    r = metrics_row.first()
    if problem_type == "classification":
        head = f"{(r['accuracy'] or 0) * 100:.1f}% accuracy on unseen data"
    else:
        head = f"R² of {(r['r2'] or 0):.2f} on unseen data"
    params = (tuned or {}).get(best, {}).get("best_params", {})
    rows = [(best, head, str(k), str(v)) for k, v in params.items()] or [(best, head, None, None)]
    return spark.createDataFrame(rows, "model string, headline string, param string, value string")


def build(q, e, tr, tu, ev, ex, prep) -> dict[str, DataFrame]:
    best = tu["best"] if tu else tr["best"]
    qs = q.summary.first()
    stats = e["statistics"]
    total = stats.first()["total_rows"]
    n_models = tr["leaderboard"].count()
    out = {
        "headline": headline(q.summary, ev["metrics"], best, prep.problem_type, n_models),
        "quality": quality_findings(q.warnings, float(qs["quality_score"])),
        "eda_cards": eda_cards(stats),
        "leaderboard": leaderboard_view(tr["leaderboard"]),
        "metrics": metric_cards(ev["metrics"], prep.problem_type),
        "importance": importance_section(ex),
        "recommendation": recommendation(best, tu["results"] if tu else None, ev["metrics"], prep.problem_type),
    }
    if prep.problem_type == "classification" and q.distribution is not None:
        out["class_shares"] = class_shares(q.distribution, prep.target, total)
    return out


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each report table as Parquet under ``path/<name>``."""
    for name, t in tables.items():
        if t is not None:
            t.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def response(run: dict) -> DataFrame:
    """The one-record answer of a run (first five selected features, in importance order)."""
    prep = run["prep"]
    tu = run["tuning"]
    best = tu["best"] if tu else run["training"]["best"]
    scores = prep.selection.scores.where("selected").orderBy("rank").select("feature").collect()
    top = [r["feature"] for r in scores][:5]
    m = run["evaluation"]["metrics"].first().asDict()
    q = run["quality"].summary.first()
    board = [(r["model"], float(r["mean_score"]), float(r["std_score"]))
             for r in run["training"]["leaderboard"].collect()]
    spark = run["quality"].summary.sparkSession
    return spark.createDataFrame([(run["problem_type"], float(q["quality_score"]), q["quality_label"], best,
                                   float(tu["results"][best]["best_score"]) if tu else None,
                                   str(tu["results"][best]["best_params"]) if tu else "{}",
                                   {k: float(v) for k, v in m.items() if v is not None}, top,
                                   run["importance"]["summary"], board)],
                                 "problem_type string, quality_score double, quality_label string, best_model string, "
                                 "tuned_score double, best_params string, metrics map<string,double>, "
                                 "top_features array<string>, summary string, "
                                 "leaderboard array<struct<model:string,mean_score:double,std_score:double>>")
