"""Queries: exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda
from ..operators import quality as qual
from ..sources.fixtures import fixture, fixture_cte
from ..sources.tables import Tables
from .catalog import finish, query, r6
from .sqlgen import duplicates_sql, lit, q, union_all
from .q_profile import MISSING_COLS, NULLS_COLS, _QK

REG_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]


def _reg(spark, sf_dir):
    return fixture(Tables(spark, sf_dir), "fx_regression")


# ---- A2 ---------------------------------------------------------------------
@query("a2_distinct_counts", sql=fixture_cte("fx_missing") + union_all([
    f"SELECT {i} AS ordinal, {lit(c)} AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM fx_missing"
    for i, c in enumerate(MISSING_COLS)]))
def a2_distinct_counts(spark, sf_dir):
    return eda.distinct_counts(fixture(Tables(spark, sf_dir), "fx_missing"))


# ---- A10 ----------------------------------------------------------------------
def _a10_sql():
    m = " + ".join(f"count_if({c} IS NULL)" for c in MISSING_COLS)
    fr = " + ".join(f"count_if({c} IS NULL) / count(*)" for c in MISSING_COLS)
    n_num = sum(1 for k in _QK.values() if k == "numerical")
    return fixture_cte("fx_missing") + f""",
du AS {duplicates_sql('fx_missing', MISSING_COLS)}
SELECT CAST(count(*) AS BIGINT) AS total_rows, {len(MISSING_COLS)} AS total_columns,
       {n_num} AS numerical_columns, {len(MISSING_COLS) - n_num} AS categorical_columns,
       CAST({m} AS BIGINT) AS total_missing_values,
       round(round_even(({fr}) / {len(MISSING_COLS)} * 100.0, 2), 6) AS missing_percentage,
       'toxic' AS target_column, CAST(count(DISTINCT toxic) AS BIGINT) AS target_unique_values,
       (SELECT duplicate_rows FROM du) AS duplicate_rows
FROM fx_missing"""


@query("a10_eda_stats", sql=_a10_sql())
def a10_eda_stats(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_missing")
    return finish(eda.eda_stats(df, _QK, "toxic"))


# ---- A11 ----------------------------------------------------------------------
@query("a11_skewness", sql=fixture_cte("fx_regression") + union_all([
    f"SELECT {i} AS ordinal, {lit(c)} AS column_name, "
    f"round(round_even(CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END, 2), 6) "
    f"AS skewness FROM fx_regression" for i, c in enumerate(REG_NUM)]))
def a11_skewness(spark, sf_dir):
    return finish(eda.skewness_table(_reg(spark, sf_dir), REG_NUM))


# ---- A14 / A19 --------------------------------------------------------------
def _corr_sql(src, cols, digits=6, rnd="round"):
    sel = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                e = f"CASE WHEN var_pop({a}) > 0 THEN 1.0 END"
            else:
                e = (f"CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 AND "
                     f"stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 THEN corr({a}, {b}) END")
            sel.append(f"SELECT {i} AS i, {lit(a)} AS col_a, {j} AS j, {lit(b)} AS col_b, "
                       f"round({rnd}(CAST({e} AS DOUBLE), {digits}), 6) AS corr FROM {src}")
    return union_all(sel)


@query("a14_correlation", sql=fixture_cte("fx_regression") + _corr_sql("fx_regression", REG_NUM))
def a14_correlation(spark, sf_dir):
    return finish(eda.correlation_long(_reg(spark, sf_dir), REG_NUM))


_HEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "high_value"]


@query("a19_corr_heatmap", sql=fixture_cte("fx_binary") + _corr_sql("fx_binary", _HEAT, 2, "round_even"))
def a19_corr_heatmap(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_binary")
    c = eda.correlation_long(df, _HEAT)
    return finish(c.withColumn("corr", F.bround("corr", 2)))


# ---- A15 --------------------------------------------------------------------
def _hist_sql(src, cols, bins=30):
    rng = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols))
    binned = union_all([
        f"SELECT {i} AS ordinal, CAST(least(floor(({c} - lo{i}) * ({bins} / (hi{i} - lo{i}))), {bins - 1}) AS INTEGER) AS bin "
        f"FROM {src}, r WHERE {c} IS NOT NULL" for i, c in enumerate(cols)])
    grid = union_all([
        f"SELECT {i} AS ordinal, {lit(c)} AS column_name, CAST(b AS INTEGER) AS bin, lo{i} + b * (hi{i} - lo{i}) / {bins} AS bin_lo, "
        f"lo{i} + (b + 1) * (hi{i} - lo{i}) / {bins} AS bin_hi FROM r, range(0, {bins}) t(b)" for i, c in enumerate(cols)])
    return f""", r AS (SELECT {rng} FROM {src}),
b AS ({binned}),
c AS (SELECT ordinal, bin, count(*) AS cnt FROM b GROUP BY ALL),
g AS ({grid})
SELECT g.ordinal, g.column_name, g.bin, round(g.bin_lo, 6) AS bin_lo, round(g.bin_hi, 6) AS bin_hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.ordinal = c.ordinal AND g.bin = c.bin"""


@query("a15_histogram", sql=fixture_cte("fx_regression") + _hist_sql("fx_regression", REG_NUM),
       headline=True)
def a15_histogram(spark, sf_dir):
    return finish(eda.histogram(_reg(spark, sf_dir), REG_NUM))


# ---- A16 ----------------------------------------------------------------------
@query("a16_target_kde", sql=fixture_cte("fx_regression") + """,
s AS (SELECT count(net) AS n, stddev_samp(net) AS sd, min(net) AS lo, max(net) AS hi FROM fx_regression),
p AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS bw FROM s),
g AS (SELECT CAST(k AS INTEGER) AS grid_index, lo + k * (hi - lo) / 199 AS x, bw, n, lo, hi FROM p, range(0, 200) t(k))
SELECT grid_index, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - net) / bw, 2))) / (n * bw * sqrt(2 * pi())) * n * (hi - lo) / 30, 6) AS bin_count_scale
FROM g, fx_regression WHERE net IS NOT NULL GROUP BY grid_index, x, bw, n, lo, hi""")
def a16_target_kde(spark, sf_dir):
    k = eda.kde(_reg(spark, sf_dir), "net")
    return finish(k.select("grid_index", "x", "bin_count_scale"))


# ---- A17 / A18 --------------------------------------------------------------
@query("a17_missing_bars", sql=fixture_cte("fx_nulls") + union_all([
    f"SELECT {i} AS ordinal, {lit(c)} AS column_name, round(count_if({c} IS NULL) / count(*) * 100, 6) AS missing_pct "
    f"FROM fx_nulls HAVING count_if({c} IS NULL) > 0" for i, c in enumerate(NULLS_COLS)]))
def a17_missing_bars(spark, sf_dir):
    return finish(eda.missing_bars(fixture(Tables(spark, sf_dir), "fx_nulls")))


@query("a18_class_bars", sql=fixture_cte("fx_imbalanced") + """
SELECT toxic, count(*) AS count FROM fx_imbalanced WHERE toxic IS NOT NULL GROUP BY toxic""")
def a18_class_bars(spark, sf_dir):
    return qual.class_counts(fixture(Tables(spark, sf_dir), "fx_imbalanced"), "toxic")


# ---- A20 ----------------------------------------------------------------------
def _box_sql(src, cols):
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""SELECT {i} AS ordinal, {lit(c)} AS column_name, round(q1, 6) AS q1, round(med, 6) AS median,
  round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  round((SELECT min({c}) FROM {src} WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round((SELECT max({c}) FROM {src} WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  (SELECT CAST(count(*) AS BIGINT) FROM {src} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM {src})""")
    return union_all(parts)


@query("a20_box_stats", sql=fixture_cte("fx_regression") + _box_sql("fx_regression", REG_NUM))
def a20_box_stats(spark, sf_dir):
    return finish(eda.box_stats(_reg(spark, sf_dir), REG_NUM))


def _fliers_sql(src, cols):
    return union_all([f"""SELECT {i} AS ordinal, {lit(c)} AS column_name, round(CAST({c} AS DOUBLE), 6) AS value, count(*) AS n
FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src})
WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) GROUP BY {c}""" for i, c in enumerate(cols)])


_FLIER_COLS = ["user_id", "value"]


@query("a20_box_fliers", sql=_fliers_sql("events", _FLIER_COLS))
def a20_box_fliers(spark, sf_dir):
    return finish(eda.box_fliers(Tables(spark, sf_dir).events.select(*_FLIER_COLS), _FLIER_COLS))


# ---- A21: EDA driver (all tables, long form) --------------------------------
@query("a21_eda_tables")
def a21_eda_tables(spark, sf_dir):
    from ..plans.drivers import run_eda
    df = fixture(Tables(spark, sf_dir), "fx_regression").drop("l_orderkey", "l_partkey", "l_suppkey",
                                                                 "l_linenumber")
    kinds = {c: ("categorical" if c in ("l_returnflag", "l_linestatus") else "numerical") for c in df.columns}
    t = run_eda(df, kinds, "net", "regression")
    out = None
    for name, d in t.items():
        r = d.select(F.lit(name).alias("table"), F.to_json(F.struct(*d.columns)).alias("row"))
        out = r if out is None else out.unionByName(r)
    return out
