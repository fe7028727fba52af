"""Queries: column rules, imputation, encoding, selection, split and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, ranks, select, split
from ..operators.schema import detect_column_types
from ..sources.fixtures import LINEITEM_KEY, fixture, fixture_cte
from ..sources.tables import Tables
from .catalog import finish, query, sig, sig_sql
from .sqlgen import lit, union_all

KEY_SQL = ", ".join(LINEITEM_KEY)
BIN_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
             "l_returnflag_N", "l_returnflag_R"]


def encoded(spark, sf_dir, fx: str):
    """Impute + encode a lineitem fixture with the library (fit on all rows)."""
    t = Tables(spark, sf_dir)
    df = fixture(t, fx)
    target = {"fx_binary": "high_value", "fx_regression": "net", "fx_severe": "is_large"}[fx]
    kinds = {c: ("categorical" if c in ("l_returnflag", "l_linestatus") else "numerical") for c in df.columns}
    problem = "regression" if fx == "fx_regression" else "classification"
    feats = [c for c in df.columns if c not in LINEITEM_KEY and c != target]
    df = clean.apply_impute(df, clean.fit_impute(df, kinds, feats))
    enc = clean.fit_encoding(df, kinds, target, problem, feats)
    out = clean.apply_encoding(df, enc, target)
    if problem == "regression":
        out = out.withColumn("label", F.col(target).cast("double"))
    return out, enc.feature_columns(feats), problem


def encoded_sql(fx: str) -> str:
    target = {"fx_binary": "high_value", "fx_regression": "net", "fx_severe": "is_large"}[fx]
    return fixture_cte(fx) + f""", enc AS (SELECT {KEY_SQL}, l_quantity, l_extendedprice, l_discount, l_tax,
  CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS l_linestatus,
  CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R,
  CAST({target} AS DOUBLE) AS label FROM {fx})
"""


# ---- P4 ---------------------------------------------------------------------
_P4_COLS = [("event_id", False), ("ts", True), ("user_id", False), ("value", False)]


@query("p4_drop_useless", sql="WITH e AS (SELECT event_id, ts, user_id, event_type, value FROM events)\n"
       + "SELECT * FROM (" + union_all([
           f"SELECT {i} AS ordinal, {lit(c)} AS column_name, CASE "
           f"WHEN count_if({c} IS NULL) / count(*) * 100 > 70 THEN 'missing' "
           f"WHEN count(DISTINCT {c}) = count(*) THEN 'id' "
           f"WHEN {'true' if dt else 'false'} THEN 'datetime' END AS reason FROM e"
           for i, (c, dt) in enumerate(_P4_COLS)]) + ") WHERE reason IS NOT NULL")
def p4_drop_useless(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type", "value")
    return clean.useless_columns(ev, "event_type", detect_column_types(ev))


# ---- P5 / X6 decisions --------------------------------------------------------
@query("p5_high_cardinality", sql=fixture_cte("fx_missing") + union_all([
    f"SELECT {lit(c)} AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'label' WHEN count(DISTINCT {c}) <= 15 THEN 'onehot' ELSE 'drop' END AS action "
    f"FROM fx_missing" for c in ["lang", "source"]]))
def p5_high_cardinality(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_missing")
    kinds = {"lang": "categorical", "source": "categorical"}
    enc = clean.fit_encoding(df, kinds, "toxic", "regression", ["lang", "source"])
    from ..operators.eda import distinct_counts
    dc = distinct_counts(df, ["lang", "source"])
    act = {**{c: "label" for c in enc.label}, **{c: "onehot" for c in enc.onehot}, **{c: "drop" for c in enc.dropped}}
    m = F.create_map(*[x for c, a in act.items() for x in (F.lit(c), F.lit(a))])
    return dc.select("column_name", "n_distinct", m[F.col("column_name")].alias("action"))


# ---- A12 / A13 / X1 / X2 / J2 ----------------------------------------------
_MED_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("a12_median", sql=fixture_cte("fx_nulls") + union_all([
    f"SELECT {lit(c)} AS column_name, round(CAST(median({c}) AS DOUBLE), 6) AS median FROM fx_nulls" for c in _MED_COLS]))
def a12_median(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_nulls")
    m = ranks.quantiles(df, _MED_COLS, [0.5])
    return finish(spark.createDataFrame([(c, float(m[c][0]) if m[c] else None) for c in _MED_COLS], "column_name string, median double"))


def _mode_sql(src, c):
    return (f"SELECT {lit(c)} AS column_name, (SELECT CAST(v AS VARCHAR) FROM (SELECT {c} AS v, count(*) AS n FROM {src} "
            f"WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY n DESC, v ASC LIMIT 1) AS mode")


@query("a13_mode", sql=fixture_cte("fx_nulls", "fx_missing") + union_all(
    [_mode_sql("fx_nulls", c) for c in ["l_returnflag", "l_linestatus"]] +
    [_mode_sql("fx_missing", c) for c in ["lang", "source"]]))
def a13_mode(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = fixture(t, "fx_nulls").agg(*[F.mode(c, True).alias(c) for c in ["l_returnflag", "l_linestatus"]])
    b = fixture(t, "fx_missing").agg(*[F.mode(c, True).alias(c) for c in ["lang", "source"]])
    la = a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("mode"))
                                     for c in ["l_returnflag", "l_linestatus"]])))
    lb = b.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("mode"))
                                     for c in ["lang", "source"]])))
    return la.unionByName(lb)


@query("x1x2_impute_apply", sql=fixture_cte("fx_nulls") + f"""
SELECT {KEY_SQL}, round(coalesce(l_discount, (SELECT median(l_discount) FROM fx_nulls)), 6) AS l_discount,
  coalesce(l_returnflag, (SELECT v FROM (SELECT l_returnflag AS v, count(*) AS n FROM fx_nulls WHERE l_returnflag IS NOT NULL
     GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS l_returnflag,
  coalesce(l_linestatus, (SELECT v FROM (SELECT l_linestatus AS v, count(*) AS n FROM fx_nulls WHERE l_linestatus IS NOT NULL
     GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS l_linestatus
FROM fx_nulls""", headline=True)
def x1x2_impute_apply(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_nulls")
    kinds = {"l_discount": "numerical", "l_returnflag": "categorical", "l_linestatus": "categorical",
             "l_quantity": "numerical", "l_extendedprice": "numerical"}
    vals = clean.fit_impute(df, kinds, ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                                        "l_linestatus"])
    return finish(clean.apply_impute(df, vals).select(*LINEITEM_KEY, "l_discount", "l_returnflag", "l_linestatus"))


# ---- X3 / X4 / X5 / X6 / P7 ---------------------------------------------------
@query("x3x4_encode", sql=encoded_sql("fx_binary") + f"""
SELECT {KEY_SQL}, l_linestatus, l_returnflag_N, l_returnflag_R FROM enc""")
def x3x4_encode(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_binary")
    return out.select(*LINEITEM_KEY, "l_linestatus", "l_returnflag_N", "l_returnflag_R")


@query("x5_target_encode", sql=fixture_cte("fx_multiclass") + """
SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS DOUBLE) AS label
FROM fx_multiclass""")
def x5_target_encode(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_multiclass")
    enc = clean.fit_encoding(df, {"o_orderstatus": "categorical"}, "o_orderstatus", "classification", [])
    return clean.apply_encoding(df, enc, "o_orderstatus").select("o_orderkey", "label")


@query("x6_encode_table", sql=fixture_cte("fx_missing") + """
SELECT doc_id, n_chars, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es,
       CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM fx_missing""")
def x6_encode_table(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_missing").select("doc_id", "lang", "source", "n_chars")
    kinds = {"doc_id": "numerical", "lang": "categorical", "source": "categorical", "n_chars": "numerical"}
    enc = clean.fit_encoding(df, kinds, "none", "regression", ["lang", "source"])
    return clean.apply_encoding(df, enc).select("doc_id", "n_chars", *[c for c in enc.feature_columns(df.columns)
                                                                         if c.startswith("lang_")])


@query("p7_bool_to_int", sql=f"SELECT {KEY_SQL}, CAST(l_returnflag = 'R' AS INTEGER) AS is_returned FROM lineitem")
def p7_bool_to_int(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return clean.bool_to_int(li.select(*LINEITEM_KEY, (F.col("l_returnflag") == "R").alias("is_returned")))


# ---- A22 / X7 / X8 ------------------------------------------------------------
REG_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag_N",
             "l_returnflag_R"]


@query("x7_variance_filter", sql=encoded_sql("fx_regression") + union_all([
    f"SELECT {i} AS ordinal, {lit(c)} AS feature, {sig_sql(f'var_pop({c})')} AS variance, "
    f"coalesce(var_pop({c}) > 0.01, false) AS keep FROM enc" for i, c in enumerate(REG_FEATS)]))
def x7_variance_filter(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_regression")
    v = select.variance_table(out, feats)
    return v.withColumn("variance", sig(F.col("variance")))


_X8_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "label"]


@query("x8_corr_filter", sql=encoded_sql("fx_regression") + "SELECT ordinal, feature, min(i) AS first_partner FROM (" + union_all([
    f"SELECT {i} AS i, {j} AS ordinal, {lit(b)} AS feature, abs(corr({a}, {b})) AS r FROM enc"
    for i, a in enumerate(_X8_FEATS) for j, b in enumerate(_X8_FEATS) if i < j]) + ") WHERE r > 0.9 GROUP BY ordinal, feature")
def x8_corr_filter(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_regression")
    return select.correlated_drops(out, _X8_FEATS)


# ---- A23 / A24 / T5 / X8c ---------------------------------------------------
def _anova_sql(feats):
    parts = []
    for i, c in enumerate(feats):
        parts.append(f"""SELECT {i} AS ordinal, {lit(c)} AS feature, round(((b - s * s / n) / (k - 1)) / (((q - s * s / n) - (b - s * s / n)) / (n - k)), 6) AS score
FROM (SELECT sum(cn) AS n, count(*) AS k, sum(cs) AS s, sum(cq) AS q, sum(cs * cs / cn) AS b
      FROM (SELECT label, count(*) AS cn, sum({c}) AS cs, sum({c} * {c}) AS cq FROM enc GROUP BY label))""")
    return union_all(parts)


@query("a23_anova_f", sql=encoded_sql("fx_binary") + _anova_sql(BIN_FEATS))
def a23_anova_f(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_binary")
    return finish(select.anova_f(out, feats, "label"))


def _regf_sql(feats):
    return union_all([
        f"SELECT {i} AS ordinal, {lit(c)} AS feature, " + sig_sql(f"CASE WHEN stddev_pop({c}) = 0 OR stddev_pop(label) = 0 THEN 0.0 "
        f"ELSE pow(covar_pop({c}, label) / (stddev_pop({c}) * stddev_pop(label)), 2) / "
        f"(1 - pow(covar_pop({c}, label) / (stddev_pop({c}) * stddev_pop(label)), 2)) * (count(*) - 2) END", 8) + " AS score FROM enc"
        for i, c in enumerate(feats)])


@query("a24_regression_f", sql=encoded_sql("fx_regression") + _regf_sql(REG_FEATS))
def a24_regression_f(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_regression")
    r = select.regression_f(out, feats, "label")
    return r.withColumn("score", sig(F.col("score"), 8))


@query("t5_top3_features", sql=encoded_sql("fx_binary") + f"""
, s AS ({_anova_sql(BIN_FEATS)})
SELECT ordinal, feature, score, rank FROM (
  SELECT ordinal, feature, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, ordinal DESC) AS INTEGER) AS rank FROM s)
WHERE rank <= 3""")
def t5_top3_features(spark, sf_dir):
    out, feats, _ = encoded(spark, sf_dir, "fx_binary")
    r = select.top_k(select.anova_f(out, feats, "label"), 3)
    return finish(r.where("selected").select("ordinal", "feature", "score", F.col("rank").cast("int")))


@query("x8c_select_features")
def x8c_select_features(spark, sf_dir):
    out, feats, problem = encoded(spark, sf_dir, "fx_binary")
    sel = select.select_features(out, feats, "label", problem)
    return spark.createDataFrame([(i, c) for i, c in enumerate(sel.selected)], "position int, feature string")


# ---- X9 / L1 / A25 ------------------------------------------------------------
@query("x9_split_stratified", sql=fixture_cte("fx_binary") + f"""
SELECT {KEY_SQL}, high_value, is_test FROM {split.split_sql('fx_binary', LINEITEM_KEY, 'high_value')}""",
       headline=True)
def x9_split_stratified(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_binary").select(*LINEITEM_KEY, "high_value")
    return split.split(df, LINEITEM_KEY, "high_value")


@query("x9_split_regression", sql=fixture_cte("fx_regression") + f"""
SELECT o_key.* FROM (SELECT {KEY_SQL}, is_test FROM {split.split_sql('fx_regression', LINEITEM_KEY, None)}) o_key""")
def x9_split_regression(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_regression").select(*LINEITEM_KEY)
    return split.split(df, LINEITEM_KEY, None)


@query("l1_folds", sql=fixture_cte("fx_binary") + f"""
, tr AS (SELECT * FROM {split.split_sql('fx_binary', LINEITEM_KEY, 'high_value')} WHERE NOT is_test)
SELECT {KEY_SQL}, high_value, fold FROM {split.folds_sql('tr', LINEITEM_KEY, 'high_value')}""", headline=True)
def l1_folds(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_binary").select(*LINEITEM_KEY, "high_value")
    tr = split.split(df, LINEITEM_KEY, "high_value").where(~F.col("is_test")).drop("is_test")
    return split.assign_folds(tr, LINEITEM_KEY, "high_value")


@query("a25_train_class_share", sql=fixture_cte("fx_severe") + f"""
, tr AS (SELECT * FROM {split.split_sql('fx_severe', LINEITEM_KEY, 'is_large')} WHERE NOT is_test)
SELECT is_large, count(*) AS count, round(count(*) / (SELECT count(*) FROM tr) * 100.0, 6) AS pct FROM tr GROUP BY is_large""")
def a25_train_class_share(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_severe").select(*LINEITEM_KEY, "is_large")
    tr = split.split(df, LINEITEM_KEY, "is_large").where(~F.col("is_test"))
    return finish(split.class_shares(tr, "is_large"))
