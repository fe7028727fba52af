"""Queries: learners, metrics, neighbours, resampling, CV and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cv, learners, metrics, neighbors, scale, split
from ..operators import tune as tuning
from ..session import scratch_path
from ..sources.fixtures import LINEITEM_KEY, fixture, fixture_cte
from ..sources.models import load_fitted, save_fitted
from ..sources.tables import Tables
from .catalog import finish, query, sig, sig_sql
from .q_prep import BIN_FEATS, KEY_SQL, encoded, encoded_sql
from .sqlgen import least_squares_sql, lit, union_all


# ---- shared: fx_binary split + Gaussian naive Bayes predictions --------------
def _binary_split(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_binary")
    d = split.split(out.select(*LINEITEM_KEY, *feats, "label"), LINEITEM_KEY, "label")
    return d, feats


def _gnb_pred(spark, sf_dir):
    d, feats = _binary_split(spark, sf_dir)
    tr, te = d.where(~F.col("is_test")), d.where("is_test")
    m = learners.fit("Naive Bayes", tr, feats, "classification", n_classes=2)
    p = m.transform(te)
    return p.withColumn("score", F.round("score", 9))


def _gnb_sql(feats=BIN_FEATS):
    n = len(feats)
    st = ", ".join(f"avg({f}) AS m{i}, var_pop({f}) AS v{i}" for i, f in enumerate(feats))
    tv = ", ".join(f"var_pop({f}) AS t{i}" for i, f in enumerate(feats))
    lg = " + ".join(f"ln(2 * pi() * (v{i} + e))" for i in range(n))
    cl = ", ".join(f"m{i}, v{i} + e AS s{i}" for i in range(n))
    q = " + ".join(f"pow(te.{f} - cl.m{i}, 2) / cl.s{i}" for i, f in enumerate(feats))
    return encoded_sql("fx_binary") + f""", sp AS {split.split_sql('enc', LINEITEM_KEY, 'label')},
tr AS (SELECT * FROM sp WHERE NOT is_test), te AS (SELECT * FROM sp WHERE is_test),
st AS (SELECT label AS cls, count(*) AS n, {st} FROM tr GROUP BY label),
eps AS (SELECT 1e-9 * greatest({', '.join(f't{i}' for i in range(n))}) AS e FROM (SELECT {tv} FROM tr)),
cl AS (SELECT cls, ln(n / (SELECT count(*) FROM tr)) - 0.5 * ({lg}) AS c, {cl} FROM st, eps),
jl AS (SELECT {', '.join('te.' + k for k in LINEITEM_KEY)}, te.label, cl.cls, cl.c - 0.5 * ({q}) AS j FROM te, cl),
pr AS (SELECT {KEY_SQL}, label, arg_max(cls, j) AS prediction,
              max(j) AS mx, max(j) FILTER (WHERE cls = 1) AS j1, max(j) FILTER (WHERE cls = 0) AS j0
       FROM jl GROUP BY {KEY_SQL}, label),
pred AS (SELECT {KEY_SQL}, label, prediction, round(exp(j1 - mx) / (exp(j0 - mx) + exp(j1 - mx)), 9) AS score FROM pr)
"""


@query("l3i_naive_bayes", sql=_gnb_sql() + f"SELECT {KEY_SQL}, label, prediction, round(score, 6) AS score FROM pred",
       headline=True)
def l3i_naive_bayes(spark, sf_dir):
    p = _gnb_pred(spark, sf_dir)
    return finish(p.select(*LINEITEM_KEY, "label", "prediction", "score"))


@query("s6_reloaded_predictions", sql=_gnb_sql() + f"SELECT {KEY_SQL}, label, prediction, round(score, 6) AS score FROM pred")
def s6_reloaded_predictions(spark, sf_dir):
    """The saved model, read back, predicts what the fitted one does."""
    d, feats = _binary_split(spark, sf_dir)
    m = learners.fit("Naive Bayes", d.where(~F.col("is_test")), feats, "classification", n_classes=2)
    path = scratch_path(spark, "model")
    save_fitted(m, path)
    again, _ = load_fitted(path)
    p = again.transform(d.where("is_test")).withColumn("score", F.round("score", 9))
    return finish(p.select(*LINEITEM_KEY, "label", "prediction", "score"))


_PC_SQL = """, pc AS (SELECT label AS actual, prediction AS predicted, count(*) AS cnt FROM pred GROUP BY ALL),
cls AS (SELECT actual AS c FROM pc UNION SELECT predicted FROM pc),
pcl AS (SELECT c AS cls, coalesce((SELECT sum(cnt) FROM pc WHERE actual = c), 0) AS support,
               coalesce((SELECT sum(cnt) FROM pc WHERE actual = c AND predicted = c), 0) AS tp,
               coalesce((SELECT sum(cnt) FROM pc WHERE predicted = c), 0) AS n_pred FROM cls),
pcm AS (SELECT cls, support, coalesce(tp / nullif(n_pred, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall FROM pcl),
pcf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pcm)
"""


@query("m5_confusion_matrix", sql=_gnb_sql() + _PC_SQL + """
SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(pc.cnt, 0) AS BIGINT) AS count
FROM cls a JOIN cls b ON true LEFT JOIN pc ON pc.actual = a.c AND pc.predicted = b.c""")
def m5_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_gnb_pred(spark, sf_dir))


@query("m6_class_report", sql=_gnb_sql() + _PC_SQL + """
SELECT cls AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pcf""")
def m6_class_report(spark, sf_dir):
    return finish(metrics.per_class(_gnb_pred(spark, sf_dir)))


@query("m1_holdout_metrics", sql=_gnb_sql() + _PC_SQL + """
SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1,
       round(avg(f1), 6) AS f1_macro, round(coalesce(max(f1) FILTER (WHERE cls = 1), 0.0), 6) AS f1_binary FROM pcf""")
def m1_holdout_metrics(spark, sf_dir):
    return finish(metrics.classification_metrics(_gnb_pred(spark, sf_dir)))


_ROC_SQL = """, g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
       FROM pred GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
"""


@query("m7_roc_curve", sql=_gnb_sql() + _ROC_SQL + """
SELECT 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT round(score, 6), round(fp / N, 6), round(tp / P, 6) FROM c, t""")
def m7_roc_curve(spark, sf_dir):
    return finish(metrics.roc_curve(_gnb_pred(spark, sf_dir)))


@query("m8_roc_auc", sql=_gnb_sql() + _ROC_SQL + """
SELECT round((P * N - sum(pos * ((fp - neg) + neg / 2.0))) / (P * N), 6) AS roc_auc FROM c, t GROUP BY P, N""")
def m8_roc_auc(spark, sf_dir):
    return finish(metrics.roc_auc(_gnb_pred(spark, sf_dir)))


# ---- linear regression on all features and regression metrics ----------------
def _lin_pred(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_regression")
    d = out.select(*LINEITEM_KEY, *[f for f in feats if f not in LINEITEM_KEY], "label")
    d = split.split(d, LINEITEM_KEY, None)
    m = learners.fit("Linear Regression", d.where(~F.col("is_test")), feats, "regression")
    return m.transform(d.where("is_test"))


_LIN_SQL = (encoded_sql("fx_regression").rstrip() + f", sp AS {split.split_sql('enc', LINEITEM_KEY, None)},\n"
            + least_squares_sql("(SELECT * FROM sp WHERE NOT is_test)", BIN_FEATS, "label") + f""",
pred AS (SELECT {KEY_SQL}, label, {' + '.join(f'c{i} * ({f} - m{i})' for i, f in enumerate(BIN_FEATS))} + my AS prediction
         FROM sp, coef, centre WHERE is_test)
""")


@query("l3b_linear_regression", sql=_LIN_SQL + f"SELECT {KEY_SQL}, round(label, 6) AS label, {sig_sql('prediction', 7)} AS prediction FROM pred")
def l3b_linear_regression(spark, sf_dir):
    p = _lin_pred(spark, sf_dir)
    return finish(p.select(*LINEITEM_KEY, "label", sig(F.col("prediction"), 7).alias("prediction")))


@query("m10_regression_metrics", sql=_LIN_SQL + f"""
SELECT {sig_sql('avg(abs(label - prediction))', 7)} AS mae, {sig_sql('avg(pow(label - prediction, 2))', 7)} AS mse,
       {sig_sql('sqrt(avg(pow(label - prediction, 2)))', 7)} AS rmse,
       round(1 - sum(pow(label - prediction, 2)) / (var_pop(label) * count(label)), 6) AS r2 FROM pred""")
def m10_regression_metrics(spark, sf_dir):
    m = metrics.regression_metrics(_lin_pred(spark, sf_dir))
    return m.select(*[sig(F.col(c), 7).alias(c) for c in ("mae", "mse", "rmse")], F.round("r2", 6).alias("r2"))


@query("m11_pred_vs_actual", sql=_LIN_SQL + """, r AS (SELECT least(min(label), min(prediction)) AS lo,
   greatest(max(label), max(prediction)) AS hi, min(label) AS dmin, max(label) AS dmax FROM pred)
SELECT CAST(least(floor((label - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS actual_bin,
       CAST(least(floor((prediction - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS predicted_bin,
       count(*) AS count, round(any_value(dmin), 6) AS diag_min, round(any_value(dmax), 6) AS diag_max
FROM pred, r GROUP BY ALL""")
def m11_pred_vs_actual(spark, sf_dir):
    return finish(metrics.prediction_vs_actual(_lin_pred(spark, sf_dir)))


@query("m11_prediction_pairs", sql=_LIN_SQL + """
SELECT round(label, 6) AS actual, """ + sig_sql("prediction", 7) + """ AS predicted, count(*) AS n FROM pred GROUP BY label, prediction""")
def m11_prediction_pairs(spark, sf_dir):
    p = metrics.prediction_pairs(_lin_pred(spark, sf_dir))
    return finish(p.withColumn("predicted", sig(F.col("predicted"), 7)))


# ---- J4 / L3h: exact neighbours on the embeddings ---------------------------
_DIST_SQL = ("sqrt(list_reduce(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), "
             "lambda t: (t[1] - t[2]) * (t[1] - t[2])), lambda x, y: x + y))")


@query("j4_neighbor_join", sql=fixture_cte("fx_vectors") + f"""
SELECT q_vec_id, label, CAST(nn_rank AS INTEGER) AS nn_rank, r_vec_id, round(dist, 6) AS dist FROM (
  SELECT a.vec_id AS q_vec_id, a.label, b.vec_id AS r_vec_id, {_DIST_SQL} AS dist,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST_SQL}, b.vec_id) AS nn_rank
  FROM fx_vectors a JOIN fx_vectors b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE nn_rank <= 5""",
       headline=True)
def j4_neighbor_join(spark, sf_dir):
    v = fixture(Tables(spark, sf_dir), "fx_vectors")
    return finish(neighbors.knn(v, v, ["embedding"], 5, ["vec_id"], ["vec_id"], group="label", exclude_self=True))


@query("l3h_knn_classifier", sql=fixture_cte("fx_vectors") + f""", sp AS {split.split_sql('fx_vectors', ['vec_id'], 'label')},
nn AS (SELECT a.vec_id AS q, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST_SQL}, b.vec_id) AS rn
       FROM sp a JOIN sp b ON a.is_test AND NOT b.is_test),
v AS (SELECT q, y, count(*) AS c FROM nn WHERE rn <= 5 GROUP BY q, y),
w AS (SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY c DESC, y) AS r FROM v)
SELECT sp.vec_id, CAST(sp.label AS DOUBLE) AS label, CAST(w.y AS DOUBLE) AS prediction FROM sp JOIN w ON sp.vec_id = w.q AND w.r = 1""")
def l3h_knn_classifier(spark, sf_dir):
    v = fixture(Tables(spark, sf_dir), "fx_vectors").withColumn("label", F.col("label").cast("double"))
    d = split.split(v, ["vec_id"], "label")
    m = learners.fit("KNN", d.where(~F.col("is_test")), ["embedding"], "classification", params={"key": ["vec_id"]},
                     n_classes=10)
    return m.transform(d.where("is_test")).select("vec_id", "label", "prediction")


_MANHATTAN_SQL = _DIST_SQL.replace("(t[1] - t[2]) * (t[1] - t[2])", "abs(t[1] - t[2])").replace("sqrt(", "(", 1)


@query("l3h_knn_regressor", sql=fixture_cte("fx_vectors") + f""", sp AS {split.split_sql('fx_vectors', ['vec_id'], 'label')},
nn AS (SELECT a.vec_id AS q, b.label AS y, {_MANHATTAN_SQL} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_MANHATTAN_SQL}, b.vec_id) AS rn
       FROM sp a JOIN sp b ON a.is_test AND NOT b.is_test),
p AS (SELECT q, sum(y * CASE WHEN d = 0 THEN 1e300 ELSE 1 / d END) / sum(CASE WHEN d = 0 THEN 1e300 ELSE 1 / d END) AS prediction
      FROM nn WHERE rn <= 7 GROUP BY q)
SELECT sp.vec_id, CAST(sp.label AS DOUBLE) AS label, round(prediction, 6) AS prediction FROM sp JOIN p ON sp.vec_id = p.q""")
def l3h_knn_regressor(spark, sf_dir):
    v = fixture(Tables(spark, sf_dir), "fx_vectors").withColumn("label", F.col("label").cast("double"))
    d = split.split(v, ["vec_id"], "label")
    m = learners.fit("KNN", d.where(~F.col("is_test")), ["embedding"], "regression",
                     params={"key": ["vec_id"], "n_neighbors": 7, "weights": "distance", "metric": "manhattan"})
    return finish(m.transform(d.where("is_test")).select("vec_id", "label", "prediction"))


# ---- X10: robust scaling --------------------------------------------------------
_SC = ["l_quantity", "l_extendedprice"]


@query("x10_robust_scale", sql=fixture_cte("fx_regression") + f""", sp AS {split.split_sql('fx_regression', LINEITEM_KEY, None)},
q AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.5) AS m{i}, quantile_cont({c}, 0.75) AS b{i}' for i, c in enumerate(_SC))}
      FROM sp WHERE NOT is_test)
SELECT {KEY_SQL}, {', '.join(f'round(({c} - m{i}) / CASE WHEN b{i} - a{i} = 0 THEN 1 ELSE b{i} - a{i} END, 6) AS {c}' for i, c in enumerate(_SC))}
FROM sp, q""")
def x10_robust_scale(spark, sf_dir):
    d = split.split(fixture(Tables(spark, sf_dir), "fx_regression").select(*LINEITEM_KEY, *_SC), LINEITEM_KEY, None)
    p = scale.fit_robust(d.where(~F.col("is_test")), _SC)
    return finish(scale.apply_robust(d, p).select(*LINEITEM_KEY, *_SC))


# ---- L2: metric choice -------------------------------------------------------------
_L2 = [("fx_imbalanced", "doc_id", "toxic"), ("fx_binary", None, "high_value"), ("fx_multiclass", "o_orderkey", "o_orderstatus")]


def _l2_sql():
    parts = []
    for f, k, t in _L2:
        key = [k] if k else LINEITEM_KEY
        parts.append(f"""SELECT {lit(f)} AS fixture, CASE WHEN min(c) / sum(c) * 100 < 20 THEN CASE WHEN count(*) <= 2 THEN 'f1' ELSE 'f1_macro' END
  ELSE 'f1_weighted' END AS metric FROM (SELECT {t}, count(*) AS c FROM {split.split_sql(f, key, t)} WHERE NOT is_test GROUP BY {t})""")
    return fixture_cte("fx_imbalanced", "fx_binary", "fx_multiclass") + union_all(parts)


@query("l2_scoring_metric", sql=_l2_sql())
def l2_scoring_metric(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = []
    for f, k, tgt in _L2:
        key = [k] if k else LINEITEM_KEY
        d = split.split(fixture(t, f), key, tgt)
        rows.append((f, cv.scoring_metric(d.where(~F.col("is_test")), tgt, "classification")))
    return spark.createDataFrame(rows, "fixture string, metric string")


# ---- I3 with a SQL twin: permutation importance of the naive Bayes model ---------
def _perm_sql(feats=BIN_FEATS, repeats=10):
    from ..functions.hashing import hash_hex_sql
    from ..operators.importance import replica_params
    n = len(feats)
    base_h = hash_hex_sql(LINEITEM_KEY, 42, "perm-base")
    params = ", ".join(f"({sidx}, {sidx // repeats}, {sidx % repeats}, {p1}, {p2}, {p3}, {braw})"
                       for sidx, (p1, p2, p3, braw) in enumerate(replica_params(n * repeats)))
    pick = ", ".join(f"CASE WHEN r._f = {i} THEN d.{f} ELSE r.{f} END AS {f}" for i, f in enumerate(feats))
    q = " + ".join(f"pow(x.{f} - cl.m{i}, 2) / cl.s{i}" for i, f in enumerate(feats))
    return _gnb_sql(feats) + f""", idx AS (SELECT *, row_number() OVER (ORDER BY {base_h}) - 1 AS _i FROM te),
nn AS (SELECT count(*) AS n FROM te),
combos AS (SELECT _s, _f, _r, CASE WHEN n % p1 <> 0 THEN p1 WHEN n % p2 <> 0 THEN p2 ELSE p3 END AS _p, braw % n AS _b
           FROM (VALUES {params}) v(_s, _f, _r, p1, p2, p3, braw), nn),
rep AS (SELECT idx.*, combos._f, combos._r, CAST((CAST(combos._p AS HUGEINT) * idx._i + combos._b) % nn.n AS BIGINT) AS _j
        FROM idx, combos, nn),
perm AS (SELECT r._i, r.label, r._f, r._r, {pick} FROM rep r JOIN idx d ON r._j = d._i),
pj AS (SELECT x._i, x._f, x._r, x.label, cl.cls, cl.c - 0.5 * ({q}) AS j FROM perm x, cl),
pp AS (SELECT _f, _r, _i, label, arg_max(cls, j) AS prediction FROM pj GROUP BY _f, _r, _i, label),
base AS (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS b FROM pred)
"""


def _perm_sql_final():
    names = "[" + ", ".join(lit(f) for f in BIN_FEATS) + "]"
    return _perm_sql() + f"""
SELECT {names}[_f + 1] AS feature, round(avg(b - acc), 6) AS importance_mean, round(stddev_pop(b - acc), 6) AS importance_std
FROM (SELECT _f, _r, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc FROM pp GROUP BY _f, _r), base
GROUP BY _f"""


@query("i3_permutation_gnb", sql=_perm_sql_final())
def i3_permutation_gnb(spark, sf_dir):
    from ..operators import importance
    d, feats = _binary_split(spark, sf_dir)
    tr, te = d.where(~F.col("is_test")), d.where("is_test")
    m = learners.fit("Naive Bayes", tr, feats, "classification", n_classes=2)
    return finish(importance.permutation_importance(m, te, feats, LINEITEM_KEY, "classification"))


# ---- X11 with a SQL twin: SMOTE on a fixed encoding of fx_imbalanced ----------------
_SM_FEATS = ["n_chars", "lang_en", "lang_es", "lang_fr"]


def _smote_input(spark, sf_dir):
    d = fixture(Tables(spark, sf_dir), "fx_imbalanced")
    return d.select(F.col("doc_id").cast("string").alias("_key"), F.col("toxic").cast("double").alias("label"),
                    F.col("n_chars").cast("double").alias("n_chars"),
                    *[(F.col("lang") == v).cast("double").alias(f"lang_{v}") for v in ("en", "es", "fr")])


def _smote_sql():
    from ..functions.hashing import hash_hex_sql, hash_int_sql, hash_unit_sql
    f = _SM_FEATS
    dist = "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in f) + ")"
    base_h = hash_hex_sql(["_key"], 42, "smote-base")
    nn_h = hash_hex_sql(["_key", "_j"], 42, "smote")
    gap_h = hash_hex_sql(["_key", "_j"], 42, "gap")
    interp = ", ".join(f"round(CASE WHEN n.r IS NULL THEN g.{c} ELSE g.{c} + g._u * (n.{c} - g.{c}) END, 6) AS {c}"
                       for c in f)
    return fixture_cte("fx_imbalanced") + f""", x AS (SELECT CAST(doc_id AS VARCHAR) AS _key, CAST(toxic AS DOUBLE) AS label,
    CAST(n_chars AS DOUBLE) AS n_chars, CAST(lang = 'en' AS DOUBLE) AS lang_en, CAST(lang = 'es' AS DOUBLE) AS lang_es,
    CAST(lang = 'fr' AS DOUBLE) AS lang_fr FROM fx_imbalanced),
cnt AS (SELECT label, count(*) AS nc FROM x GROUP BY label),
need AS (SELECT label, nc, (SELECT max(nc) FROM cnt) - nc AS nd, least(5, nc - 1) AS k FROM cnt WHERE nc < (SELECT max(nc) FROM cnt)),
mr AS (SELECT x.*, need.nc, need.nd, need.k, row_number() OVER (PARTITION BY x.label ORDER BY {base_h}) AS _r
       FROM x JOIN need USING (label)),
alloc AS (SELECT *, CAST(floor(nd / nc) + CASE WHEN _r <= nd % nc THEN 1 ELSE 0 END AS BIGINT) AS _q FROM mr),
gen AS (SELECT a.*, j.j AS _j FROM alloc a, LATERAL (SELECT unnest(range(a._q)) AS j) j WHERE a._q > 0),
g AS (SELECT *, CASE WHEN k > 0 THEN ({hash_int_sql(nn_h)} % k) + 1 END AS _nn, {hash_unit_sql(gap_h)} AS _u FROM gen),
nb AS (SELECT a._key AS q, b._key AS r, b.n_chars, b.lang_en, b.lang_es, b.lang_fr,
              row_number() OVER (PARTITION BY a._key ORDER BY {dist}, b._key) AS rk
       FROM mr a JOIN mr b ON a.label = b.label AND a._key <> b._key),
syn AS (SELECT g._key || '|smote|' || CAST(g._j AS VARCHAR) AS _key, g.label, {interp}
        FROM g LEFT JOIN nb n ON n.q = g._key AND n.rk = g._nn)
SELECT _key, label, {', '.join(f'round({c}, 6) AS {c}' for c in f)}, false AS _synthetic FROM x
UNION ALL SELECT *, true FROM syn"""


@query("x11_smote_fixed", sql=_smote_sql())
def x11_smote_fixed(spark, sf_dir):
    from ..operators import resample
    return finish(resample.smote(_smote_input(spark, sf_dir), _SM_FEATS))


# ---- L4 with a SQL twin: 5-fold CV of naive Bayes (weighted F1) ---------------------
def _cv_nb_sql(feats=BIN_FEATS, smoothing=1e-9):
    n = len(feats)
    k = LINEITEM_KEY
    st = ", ".join(f"avg(fo.{c}) AS m{i}, var_pop(fo.{c}) AS v{i}" for i, c in enumerate(feats))
    tv = ", ".join(f"var_pop(fo.{c}) AS t{i}" for i, c in enumerate(feats))
    lg = " + ".join(f"ln(2 * pi() * (v{i} + e))" for i in range(n))
    cl = ", ".join(f"m{i}, v{i} + e AS s{i}" for i in range(n))
    q = " + ".join(f"pow(fo.{c} - cl.m{i}, 2) / cl.s{i}" for i, c in enumerate(feats))
    return encoded_sql("fx_binary") + f""", sp AS {split.split_sql('enc', k, 'label')},
tr AS (SELECT * FROM sp WHERE NOT is_test),
fo AS {split.folds_sql('tr', k, 'label')},
fs AS (SELECT DISTINCT fold AS f FROM fo),
st AS (SELECT fs.f, fo.label AS cls, count(*) AS n, {st} FROM fs JOIN fo ON fo.fold <> fs.f GROUP BY fs.f, fo.label),
ntr AS (SELECT f, sum(n) AS nt FROM st GROUP BY f),
eps AS (SELECT f, {smoothing} * greatest({', '.join(f't{i}' for i in range(n))}) AS e
        FROM (SELECT fs.f, {tv} FROM fs JOIN fo ON fo.fold <> fs.f GROUP BY fs.f)),
cl AS (SELECT st.f, cls, ln(n / nt) - 0.5 * ({lg}) AS c, {cl} FROM st JOIN ntr USING (f) JOIN eps USING (f)),
jl AS (SELECT {', '.join('fo.' + c for c in k)}, fo.fold, fo.label, cl.cls, cl.c - 0.5 * ({q}) AS j
       FROM fo JOIN cl ON cl.f = fo.fold),
pr AS (SELECT fold, label, arg_max(cls, j) AS prediction FROM jl GROUP BY {', '.join(k)}, fold, label),
pc AS (SELECT fold, label AS actual, prediction AS predicted, count(*) AS cnt FROM pr GROUP BY ALL),
cs AS (SELECT fold, actual AS c FROM pc UNION SELECT fold, predicted FROM pc),
pcl AS (SELECT cs.fold, cs.c, coalesce(sum(cnt) FILTER (WHERE actual = cs.c), 0) AS support,
               coalesce(sum(cnt) FILTER (WHERE actual = cs.c AND predicted = cs.c), 0) AS tp,
               coalesce(sum(cnt) FILTER (WHERE predicted = cs.c), 0) AS n_pred
        FROM cs JOIN pc ON pc.fold = cs.fold GROUP BY cs.fold, cs.c),
pm AS (SELECT *, coalesce(tp / nullif(n_pred, 0), 0.0) AS pr_, coalesce(tp / nullif(support, 0), 0.0) AS rc FROM pcl),
pf AS (SELECT *, coalesce(2 * pr_ * rc / nullif(pr_ + rc, 0), 0.0) AS f1 FROM pm),
sc AS (SELECT fold, sum(f1 * support) / sum(support) AS score FROM pf GROUP BY fold)
SELECT CAST(fold AS INTEGER) AS fold, round(score, 6) AS score, round(avg(score) OVER (), 4) AS mean_score,
       round(stddev_pop(score) OVER (), 4) AS std_score FROM sc"""


@query("l4_cv_naive_bayes", sql=_cv_nb_sql())
def l4_cv_naive_bayes(spark, sf_dir):
    d, feats = _binary_split(spark, sf_dir)
    trf = split.assign_folds(d.where(~F.col("is_test")).drop("is_test"), LINEITEM_KEY, "label")
    res = cv.fold_scores(trf, feats, "classification", "f1_weighted", [("Naive Bayes", {})], n_classes=2)
    scores = [s for _, _, s in res]
    mean = sum(scores) / len(scores)
    std = cv.population_std(scores)
    rows = [(int(f), float(s), float(mean), float(std)) for _, f, s in res]
    df = spark.createDataFrame(rows, "fold int, score double, mean_score double, std_score double")
    return df.select("fold", F.round("score", 6).alias("score"), F.round("mean_score", 4).alias("mean_score"),
                     F.round("std_score", 4).alias("std_score"))


_NB_GRID = tuning.combinations(tuning.CLASSIFICATION_GRIDS["Naive Bayes"][1])


@query("l8_grid_naive_bayes", sql=union_all([
    f"SELECT 'Naive Bayes' AS model, CAST({i} AS INTEGER) AS candidate, {lit(str(p))} AS params, any_value(mean_score) AS mean_score "
    f"FROM ({_cv_nb_sql(smoothing=p['var_smoothing'])})" for i, p in enumerate(_NB_GRID)]))
def l8_grid_naive_bayes(spark, sf_dir):
    """Every candidate of the grid over the same folds, from one table of moments."""
    d, feats = _binary_split(spark, sf_dir)
    trf = split.assign_folds(d.where(~F.col("is_test")).drop("is_test"), LINEITEM_KEY, "label")
    _, _, table = tuning.tune_model("Naive Bayes", trf, feats, "classification", "f1_weighted", key=LINEITEM_KEY, n_classes=2)
    return table
