"""Queries over the model lifecycle (rows-only checks: fitted models have no SQL twin)."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ..operators import clean, cv, importance, learners, report, resample, schema, split
from ..operators import scoring as sc
from ..operators import tune as tuning
from ..session import scratch_path
from ..sources.csv import read_csv
from ..sources.fixtures import LINE_FEATURES, LINEITEM_KEY, fixture, fixture_cte
from ..operators import quality as qual
from ..sources.models import load_fitted, save_fitted
from ..sources.tables import Tables
from ..streaming import score_stream
from . import drivers
from .catalog import finish, query

PARALLELISM = 8
_CACHE: dict = {}
_LOCK = threading.RLock()


def _cached(kind, spark, sf_dir, build):
    k = (kind, sf_dir, id(spark))
    with _LOCK:
        if k not in _CACHE:
            _CACHE[k] = build()
        return _CACHE[k]


def _imb_raw(spark, sf_dir):
    return fixture(Tables(spark, sf_dir), "fx_imbalanced")


def _imb_prep(spark, sf_dir):
    def b():
        df = _imb_raw(spark, sf_dir)
        typed, kinds, problem = schema.ingest_frame(df, "toxic")
        return drivers.preprocess(typed, "toxic", ["doc_id"], kinds, problem)
    return _cached("imb_prep", spark, sf_dir, b)


def _imb_train(spark, sf_dir):
    return _cached("imb_train", spark, sf_dir,
                   lambda: drivers.train_models(_imb_prep(spark, sf_dir), parallelism=PARALLELISM))


def _imb_tune(spark, sf_dir):
    return _cached("imb_tune", spark, sf_dir,
                   lambda: drivers.tune_top(_imb_prep(spark, sf_dir), _imb_train(spark, sf_dir), parallelism=PARALLELISM))


def _imb_run(spark, sf_dir):
    def b():
        return drivers.run_all(_imb_raw(spark, sf_dir), "toxic", ["doc_id"],
                               model_dir=scratch_path(spark, "model-run"), parallelism=PARALLELISM,
                               prep=_imb_prep(spark, sf_dir), trained=_imb_train(spark, sf_dir), tuned=_imb_tune(spark, sf_dir))
    return _cached("imb_run", spark, sf_dir, b)


def _fit_pred(spark, sf_dir, name):
    p = _imb_prep(spark, sf_dir)
    tr, te = p.data.where(~F.col("is_test")), p.data.where("is_test")
    m = learners.fit(name, tr, p.features, p.problem_type, params={"key": [drivers.KEY]}, n_classes=p.n_classes)
    return finish(m.transform(te).select(drivers.KEY, "label", "prediction", "score"))


# ---- L3: the zoo members --------------------------------------------------------
@query("l3a_logistic_regression")
def l3a_logistic_regression(spark, sf_dir):
    return _fit_pred(spark, sf_dir, "Logistic Regression")


@query("l3c_decision_tree")
def l3c_decision_tree(spark, sf_dir):
    return _fit_pred(spark, sf_dir, "Decision Tree")


@query("l3d_random_forest")
def l3d_random_forest(spark, sf_dir):
    return _fit_pred(spark, sf_dir, "Random Forest")


@query("l3e_gradient_boosting")
def l3e_gradient_boosting(spark, sf_dir):
    return _fit_pred(spark, sf_dir, "Gradient Boosting")


@query("l3f_svm_classifier")
def l3f_svm_classifier(spark, sf_dir):
    return _fit_pred(spark, sf_dir, "SVM")


@query("l3g_svm_regressor")
def l3g_svm_regressor(spark, sf_dir):
    d = fixture(Tables(spark, sf_dir), "fx_regression").select(*LINEITEM_KEY, *LINE_FEATURES, F.col("net").alias("label"))
    d = split.split(d, LINEITEM_KEY, None)
    train = d.where(~F.col("is_test")).select(*LINE_FEATURES)
    enc = clean.fit_encoding(train, schema.detect_column_types(train), "label", "regression")
    d = clean.apply_encoding(d, enc)
    feats = enc.feature_columns(LINE_FEATURES)
    m = learners.fit("SVM", d.where(~F.col("is_test")), feats, "regression")
    return finish(m.transform(d.where("is_test")).select(*LINEITEM_KEY, "label", "prediction"))


# ---- X11 / X12 ------------------------------------------------------------------
@query("x12_preprocess")
def x12_preprocess(spark, sf_dir):
    return finish(_imb_prep(spark, sf_dir).data)


@query("x11_smote")
def x11_smote(spark, sf_dir):
    p = _imb_prep(spark, sf_dir)
    tr = p.data.where(~F.col("is_test")).select(drivers.KEY, "label", *p.features)
    return finish(resample.smote(tr, p.features))


# ---- L4-L6, T1-T3 -------------------------------------------------------------
@query("l4_cross_validation")
def l4_cross_validation(spark, sf_dir):
    return _imb_train(spark, sf_dir)["cv"].summary


@query("t1_leaderboard")
def t1_leaderboard(spark, sf_dir):
    return _imb_train(spark, sf_dir)["leaderboard"]


@query("l6_training_holdout")
def l6_training_holdout(spark, sf_dir):
    t = _imb_train(spark, sf_dir)
    return t["test_metrics"].select(F.lit(t["best"]).alias("best_model"), F.lit(t["metric"]).alias("cv_metric"), "*")


# ---- L7-L12, T4 ------------------------------------------------------------------
@query("l7_param_grids")
def l7_param_grids(spark, sf_dir):
    # the search spaces joined to the problem types the fixtures yield
    rows = []
    for pt in ("classification", "regression"):
        for name, (search, space) in tuning.param_grids(pt).items():
            combos, _ = tuning.candidates_for(name, pt)
            rows.append((pt, name, search, len(tuning.combinations(space)), len(combos)))
    grids = spark.createDataFrame(rows, "problem_type string, model string, search string, n_combinations int, "
                                        "n_candidates int")
    pts = schema.problem_type_frame(_imb_raw(spark, sf_dir), "toxic").select("problem_type")
    return grids.join(F.broadcast(pts), "problem_type", "left_semi")


def _imb_folds(spark, sf_dir):
    def b():
        p = _imb_prep(spark, sf_dir)
        tr = p.data.where(~F.col("is_test")).drop("is_test")
        folds = split.assign_folds(tr, [drivers.KEY], "label").persist()
        return folds, cv.scoring_metric(tr, "label", p.problem_type)
    return _cached("imb_folds", spark, sf_dir, b)


@query("l11_tune_naive_bayes")
def l11_tune_naive_bayes(spark, sf_dir):
    p = _imb_prep(spark, sf_dir)
    folds, metric = _imb_folds(spark, sf_dir)
    _, _, table = tuning.tune_model("Naive Bayes", folds, p.features, p.problem_type, metric,
                                    key=[drivers.KEY], parallelism=PARALLELISM, n_classes=p.n_classes,
                                    resample=drivers._resampler(p))
    return table


@query("l12_tuning_top3")
def l12_tuning_top3(spark, sf_dir):
    r = _imb_tune(spark, sf_dir)
    rows = [(n, float(v["best_score"]), str(v["best_params"]), n == r["best"]) for n, v in r["results"].items()]
    return spark.createDataFrame(rows, "model string, best_score double, best_params string, is_best boolean")


# ---- M12 / I1-I5 ---------------------------------------------------------------------
@query("m12_evaluation")
def m12_evaluation(spark, sf_dir):
    return finish(drivers.evaluate(_imb_tune(spark, sf_dir)["model"], _imb_prep(spark, sf_dir))["metrics"])


@query("i1_tree_importance")
def i1_tree_importance(spark, sf_dir):
    p = _imb_prep(spark, sf_dir)
    m = learners.fit("Decision Tree", p.data.where(~F.col("is_test")), p.features, p.problem_type,
                     n_classes=p.n_classes)
    return finish(importance.tree_importance(m, p.features))


@query("i2_forest_importance")
def i2_forest_importance(spark, sf_dir):
    p = _imb_prep(spark, sf_dir)
    return finish(importance.forest_importance(p.data.where(~F.col("is_test")), p.features, p.problem_type,
                                               n_classes=p.n_classes))


def _binary_prep(spark, sf_dir):
    def b():
        df = fixture(Tables(spark, sf_dir), "fx_binary")
        typed, kinds, problem = schema.ingest_frame(df, "high_value")
        return drivers.preprocess(typed, "high_value", LINEITEM_KEY, kinds, problem)
    return _cached("bin_prep", spark, sf_dir, b)


@query("i3_permutation_importance", headline=True)
def i3_permutation_importance(spark, sf_dir):
    p = _binary_prep(spark, sf_dir)
    m = learners.fit("Naive Bayes", p.data.where(~F.col("is_test")), p.features, p.problem_type,
                     n_classes=p.n_classes)
    return finish(importance.permutation_importance(m, p.data.where("is_test"), p.features, [drivers.KEY],
                                                    p.problem_type))


@query("i5_importance_summary")
def i5_importance_summary(spark, sf_dir):
    ex = drivers.explain(_imb_tune(spark, sf_dir)["model"], _imb_prep(spark, sf_dir))
    return spark.createDataFrame([(ex["summary"],)], "summary string")


# ---- S5 / S6 / P8 / X13 / I6 / ST1 ----------------------------------------------
def _saved(spark, sf_dir):
    def b():
        p = _imb_prep(spark, sf_dir)
        m = learners.fit("Naive Bayes", p.data.where(~F.col("is_test")), p.features, p.problem_type,
                         n_classes=p.n_classes)
        path = scratch_path(spark, "model")
        save_fitted(m, path, p.metadata())
        return path
    return _cached("saved", spark, sf_dir, b)


@query("s5s6_model_roundtrip")
def s5s6_model_roundtrip(spark, sf_dir):
    m, prep = load_fitted(_saved(spark, sf_dir))
    return spark.createDataFrame([(m.name, m.kind, m.problem_type, ",".join(m.features), ",".join(prep["classes"]))],
                                 "model string, kind string, problem_type string, features string, classes string")


@query("p8_input_check")
def p8_input_check(spark, sf_dir):
    _, prep = load_fitted(_saved(spark, sf_dir))
    raw = _imb_raw(spark, sf_dir)
    rows = [("full_input", "", ",".join(sc.validate_input(raw.withColumn("extra_col", F.lit(1)), prep)))]
    try:
        sc.validate_input(raw.drop(sc.required_columns(prep)[0]), prep)
        rows.append(("missing_column", "", ""))
    except sc.InputError as e:
        rows.append(("missing_column", str(e), ""))
    return spark.createDataFrame(rows, "case string, error string, ignored_extra string")


@query("x13_score_prep_batch")
def x13_score_prep_batch(spark, sf_dir):
    _, prep = load_fitted(_saved(spark, sf_dir))
    return finish(sc.preprocess_input(_imb_raw(spark, sf_dir), prep, batch_stats=True))


@query("i6_batch_scoring", headline=True)
def i6_batch_scoring(spark, sf_dir):
    m, prep = load_fitted(_saved(spark, sf_dir))
    return finish(sc.predict(_imb_raw(spark, sf_dir), m, prep).drop("probability"))


@query("st1_stream_scoring")
def st1_stream_scoring(spark, sf_dir):
    raw = _imb_raw(spark, sf_dir)
    src = scratch_path(spark, "stream-in")
    raw.write.parquet(src)
    sink, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    q = score_stream(spark, src, raw.schema, _saved(spark, sf_dir), sink, ck)
    q.awaitTermination()
    return finish(spark.read.parquet(sink).drop("probability"))


# ---- S1 / S7 / S8 / I7 / R1-R8 --------------------------------------------------------
@query("s1_csv_scan")
def s1_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "fx_missing") + ".csv"
    fixture(Tables(spark, sf_dir), "fx_missing").write.option("header", True).csv(path)
    return read_csv(spark, path)


@query("i7_end_to_end")
def i7_end_to_end(spark, sf_dir):
    return report.response(_imb_run(spark, sf_dir))


@query("s7_report_sink")
def s7_report_sink(spark, sf_dir):
    rep = _imb_run(spark, sf_dir)["report"]
    path = scratch_path(spark, "report")
    report.write_report(rep, path)
    return spark.createDataFrame([(n, spark.read.parquet(f"{path}/{n}").count()) for n, t in rep.items() if t is not None],
                                 "table string, n_rows bigint")


def _checked(spark, sf_dir):
    """Ingest and quality alone: what R2-R4 read."""
    typed, kinds, problem = schema.ingest_frame(_imb_raw(spark, sf_dir), "toxic")
    return typed, kinds, problem, qual.run_quality_check(typed, kinds, "toxic", problem)


@query("r2_report_quality")
def r2_report_quality(spark, sf_dir):
    q = _checked(spark, sf_dir)[3]
    return report.quality_findings(q.warnings, float(q.summary.first()["quality_score"]))


@query("r3_report_class_shares", sql=fixture_cte("fx_imbalanced") + """
SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS count,
       round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fx_imbalanced) * 100, 1) AS pct
FROM fx_imbalanced GROUP BY toxic""")
def r3_report_class_shares(spark, sf_dir):
    typed, _, _, q = _checked(spark, sf_dir)
    return report.class_shares(q.distribution, "toxic", typed.count())


@query("r4_report_eda_cards")
def r4_report_eda_cards(spark, sf_dir):
    typed, kinds, problem, _ = _checked(spark, sf_dir)
    return report.eda_cards(drivers.run_eda(typed, kinds, "toxic", problem)["statistics"])


@query("r5_report_leaderboard")
def r5_report_leaderboard(spark, sf_dir):
    return report.leaderboard_view(_imb_train(spark, sf_dir)["leaderboard"])


def _rep(name):
    def q(spark, sf_dir):
        return _imb_run(spark, sf_dir)["report"][name]
    return q


for _id, _name in [("r1", "headline"), ("r6", "metrics"), ("r7", "importance"), ("r8", "recommendation")]:
    query(f"{_id}_report_{_name}")(_rep(_name))
