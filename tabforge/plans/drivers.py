"""Stage drivers: preprocessing (X12), EDA (A21), training (L6), tuning (L12),
evaluation (M12), importance (I5) and the end-to-end run (I7)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, cv, eda, importance, learners, metrics, resample, scale, schema, search, select, split
from ..operators import quality as qual
from ..operators import tune as tuning

KEY = "_key"


def with_key(df: DataFrame, key: list[str]) -> DataFrame:
    """One string row key; hashing it equals hashing the key columns."""
    return df.withColumn(KEY, F.concat_ws("|", *[F.col(c).cast("string") for c in key]))


@dataclass
class Prepared:
    data: DataFrame                  # _key, selected features, label, is_test
    features: list[str]
    raw_features: list[str]
    kinds: dict
    problem_type: str
    target: str
    key: list[str]
    impute: dict
    encoding: clean.Encoding
    dropped: list[tuple[str, str]]
    selection: select.Selection | None
    n_classes: int
    null_target_rows: int
    scale: dict = field(default_factory=dict)

    def metadata(self) -> dict:
        return {"key": self.key, "raw_features": self.raw_features, "kinds": self.kinds,
                "impute": self.impute, "features": self.features,
                "encoding": {"label": self.encoding.label, "onehot": self.encoding.onehot,
                             "dropped": self.encoding.dropped},
                "classes": [str(c) for c in (self.encoding.target_classes or [])], "scale": self.scale,
                "target": self.target, "problem_type": self.problem_type}


def preprocess(df: DataFrame, target: str, key: list[str], kinds: dict, problem_type: str,
               fit_on: str = "train", k: int = select.TOP_K, robust_scale: bool = False) -> Prepared:
    """Drop -> split -> impute -> encode -> select -> (scale).

    Statistics are fitted on the training rows by default (``fit_on="all"``
    fits them on every row, before the split, as the reference does).
    Resampling is left to training so it can run inside each fold.
    """
    cnt = df.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.col(target)).alias("n")).first()
    n_all, n = cnt["n_all"], cnt["n"]
    df = df.where(F.col(target).isNotNull())
    useless = clean.useless_columns(df, target, kinds, exclude=key).collect()
    drop = [r["column_name"] for r in useless]
    raw = [c for c in df.columns if c not in drop and c != target and c not in key and
           kinds.get(c) in ("numerical", "categorical")]
    d = with_key(df, key).select(KEY, *key, *raw, target)
    d = split.split(d, [KEY], target if problem_type == "classification" else None, n_rows=n)
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    fit_rows = d.where(~F.col("is_test")) if fit_on == "train" else d
    imp = clean.fit_impute(fit_rows, kinds, raw, every=True)
    d2 = clean.apply_impute(d, imp)
    fit_rows = d2.where(~F.col("is_test")) if fit_on == "train" else d2
    enc = clean.fit_encoding(fit_rows, kinds, target, problem_type, raw)
    d3 = clean.apply_encoding(d2, enc, target)
    if problem_type != "classification":
        d3 = d3.withColumn("label", F.col(target).cast("double"))
    feats_all = enc.feature_columns(raw)
    d3 = clean.bool_to_int(d3, feats_all)
    fit_rows = d3.where(~F.col("is_test")) if fit_on == "train" else d3
    sel = select.select_features(fit_rows, feats_all, "label", problem_type, k)
    feats = sel.selected
    data = d3.select(KEY, *[F.col(f).cast("double").alias(f) for f in feats], "label", "is_test")
    sc = {}
    if robust_scale:
        sc = scale.fit_robust(data.where(~F.col("is_test")), feats)
        data = scale.apply_robust(data, sc)
    nc = len(enc.target_classes) if enc.target_classes else 0
    return Prepared(data, feats, raw, kinds, problem_type, target, key, imp, enc,
                    [(r["column_name"], r["reason"]) for r in useless], sel, nc, n_all - n, sc)


def run_eda(df: DataFrame, kinds: dict, target: str, problem_type: str) -> dict[str, DataFrame]:
    """The EDA tables by name."""
    num = [c for c, k in kinds.items() if k == "numerical" and c in df.columns]
    out = {}
    if problem_type == "classification":
        out["target"] = qual.class_counts(df, target)
    else:
        out["target"] = eda.histogram(df, [target])
        out["target_kde"] = eda.kde(df, target)
    out["missing"] = eda.missing_bars(df)
    if num:
        out["distributions"] = eda.histogram(df, num)
        out["outliers"] = eda.box_stats(df, num)
        out["skewness"] = eda.skewness_table(df, num)
    if len(num) >= 2:
        out["correlation"] = eda.correlation_long(df, num)
    out["statistics"] = eda.eda_stats(df, kinds, target)
    return out


def _resampler(prep: Prepared):
    if prep.problem_type != "classification":
        return None

    def rs(train: DataFrame) -> DataFrame:
        if resample.needs_smote(train):
            return resample.smote(train.select(KEY, "label", *prep.features), prep.features)
        return train
    return rs


def _final_train(prep: Prepared, tr: DataFrame) -> DataFrame:
    """All training rows, resampled where needed; those are held, since the refits of training and tuning read them again and again."""
    rows = _resampler(prep)(tr) if prep.problem_type == "classification" else tr
    return rows if rows is tr else rows.persist(StorageLevel.MEMORY_AND_DISK)


def train_models(prep: Prepared, names: list[str] | None = None, parallelism: int = 4):
    """Metric choice, 5-fold CV, leaderboard, refit of the best, hold-out metrics."""
    tr = prep.data.where(~F.col("is_test")).drop("is_test")
    te = prep.data.where("is_test").drop("is_test")
    metric = cv.scoring_metric(tr, "label", prep.problem_type)
    strata = "label" if prep.problem_type == "classification" else None
    trf = split.assign_folds(tr, [KEY], strata)
    folds = search.build_folds(trf, prep.features, key=[KEY], resample=_resampler(prep), parallelism=parallelism)
    run = cv.cross_validate(folds, prep.features, prep.problem_type, metric, names, key=[KEY],
                            parallelism=parallelism, n_classes=prep.n_classes)
    board = cv.leaderboard(run.summary)
    best = cv.top_models(board, 1)[0]
    final_train = _final_train(prep, tr)
    model = learners.fit(best, final_train, prep.features, prep.problem_type, "label", {"key": [KEY]},
                         n_classes=prep.n_classes)
    test_metrics = cv.holdout_metrics(model.transform(te), prep.problem_type)
    return {"metric": metric, "cv": run, "leaderboard": board, "best": best, "model": model,
            "test_metrics": test_metrics, "folds": folds, "final_train": final_train}


def tune_top(prep: Prepared, trained: dict, top_n: int = 3, parallelism: int = 4):
    """Tune the top models, refit the best tuned one on all training rows."""
    board = trained["leaderboard"]
    top = cv.top_models(board, top_n)
    means = {r["model"]: r["mean_score"] for r in board.collect()}
    best, results, table = tuning.run_tuning(trained["folds"], prep.features, prep.problem_type, trained["metric"],
                                             top, key=[KEY], parallelism=parallelism, n_classes=prep.n_classes,
                                             cv_means=means)
    final_train = trained.get("final_train")
    if final_train is None:
        final_train = _final_train(prep, prep.data.where(~F.col("is_test")).drop("is_test"))
    params = dict(results[best]["best_params"])
    params["key"] = [KEY]
    model = learners.fit(best, final_train, prep.features, prep.problem_type, "label", params,
                         n_classes=prep.n_classes)
    return {"best": best, "results": results, "table": table, "model": model}


def evaluate(model, prep: Prepared) -> dict[str, DataFrame]:
    """Metrics and the curve / matrix tables for the hold-out rows."""
    te = prep.data.where("is_test").drop("is_test")
    pred = model.transform(te).persist(StorageLevel.MEMORY_AND_DISK)
    out = {"predictions": pred}
    if prep.problem_type == "classification":
        m = metrics.classification_metrics(pred)
        out["confusion_matrix"] = metrics.confusion_matrix(pred)
        out["report"] = metrics.per_class(pred)
        if prep.n_classes == 2 and pred.where(F.col("score").isNotNull()).limit(1).count() > 0:
            out["roc_curve"] = metrics.roc_curve(pred)
            auc = metrics.roc_auc(pred).first()["roc_auc"]
            m = m.withColumn("roc_auc", F.lit(auc))
        out["metrics"] = m
    else:
        out["metrics"] = metrics.regression_metrics(pred)
        out["pred_vs_actual"] = metrics.prediction_vs_actual(pred)
    return out


def explain(model, prep: Prepared) -> dict:
    """Tree, forest and permutation importance plus the summary."""
    tr = prep.data.where(~F.col("is_test")).drop("is_test")
    te = prep.data.where("is_test").drop("is_test")
    tree = importance.tree_importance(model, prep.features)
    rf = importance.forest_importance(tr, prep.features, prep.problem_type, n_classes=prep.n_classes)
    perm = importance.permutation_importance(model, te, prep.features, [KEY], prep.problem_type)
    tree_rows = [tuple(r) for r in tree.collect()] if tree is not None else None
    perm_rows = [tuple(r) for r in perm.collect()]
    return {"tree": tree, "random_forest": rf, "permutation": perm,
            "summary": importance.summary(tree_rows, perm_rows, model.name)}


def run_all(df: DataFrame, target: str, key: list[str], model_dir: str | None = None,
            names: list[str] | None = None, tune: bool = True, parallelism: int = 4,
            prep: Prepared | None = None, trained: dict | None = None, tuned: dict | None = None) -> dict:
    """Ingest -> quality -> EDA -> preprocess -> train -> tune -> evaluate ->
    importance -> save -> report tables.  ``prep`` / ``trained`` / ``tuned`` reuse earlier stages."""
    from ..operators import report
    typed, kinds, problem = schema.ingest_frame(df, target)
    q = qual.run_quality_check(typed, kinds, target, problem)
    e = run_eda(typed, kinds, target, problem)
    prep = prep or preprocess(typed, target, key, kinds, problem)
    tr = trained or train_models(prep, names, parallelism)
    tu = tuned or (tune_top(prep, tr, parallelism=parallelism) if tune else None)
    model = tu["model"] if tu else tr["model"]
    ev = evaluate(model, prep)
    ex = explain(model, prep)
    if model_dir:
        from ..sources.models import save_fitted
        save_fitted(model, model_dir, prep.metadata())
    rep = report.build(q, e, tr, tu, ev, ex, prep)
    return {"problem_type": problem, "kinds": kinds, "quality": q, "eda": e, "prep": prep, "training": tr,
            "tuning": tu, "evaluation": ev, "importance": ex, "model": model, "report": rep}
