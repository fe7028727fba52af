"""Queries: scan, schema detection, validation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qual
from ..operators import schema
from ..sources.fixtures import FIXTURES, fixture, fixture_cte
from ..sources.tables import Tables
from .catalog import finish, query, r6
from .sqlgen import (duplicates_sql, imbalance_sql, lit, missing_findings_sql, outliers_sql, q,
                     union_all)

MISSING_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
NULLS_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity",
              "l_discount", "l_returnflag", "l_linestatus"]


# ---- S2: Parquet scan with projection and pushed filter -------------------
@query("s2_parquet_scan", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(l_discount, 6) AS l_discount
FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'
""")
def s2_parquet_scan(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return finish(li.where((F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R"))
                    .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                            "l_discount"))


# ---- P1: logical column types ----------------------------------------------
_P1_FIXED = [("event_id", "numerical"), ("ts", "datetime"), ("user_id", "numerical"),
             (None, None), ("value", "numerical"), (None, None), (None, None)]
_P1_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props", "k"]


def _p1_sql():
    strings = [c for c, (n, _) in zip(_P1_COLS, _P1_FIXED) if n is None]
    aggs = ", ".join(
        f"count({c}) AS n_{c}, count_if({c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL) AS b_{c}, "
        f"count_if({c} IS NOT NULL AND try_cast({c} AS TIMESTAMP) IS NULL) AS t_{c}" for c in strings)
    sel = []
    for i, (c, (n, k)) in enumerate(zip(_P1_COLS, _P1_FIXED)):
        if n is not None:
            sel.append(f"SELECT {i} AS ordinal, {lit(c)} AS column_name, {lit(k)} AS kind")
        else:
            sel.append(f"SELECT {i}, {lit(c)}, CASE WHEN n_{c} = 0 OR b_{c} = 0 THEN 'numerical' "
                       f"WHEN t_{c} = 0 THEN 'datetime' ELSE 'categorical' END FROM a")
    return (f"WITH e AS (SELECT event_id, ts, user_id, event_type, value, props, "
            f"json_extract_string(props, '$.k') AS k FROM events), a AS (SELECT {aggs} FROM e)\n"
            + union_all(sel))


@query("p1_column_types", sql=_p1_sql())
def p1_column_types(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    df = ev.select("event_id", "ts", "user_id", "event_type", "value", "props",
                   F.get_json_object("props", "$.k").alias("k"))
    return schema.column_types_frame(spark, schema.detect_column_types(df))


# ---- P2: problem type ------------------------------------------------------
_P2_CASES = [("fx_binary", "high_value"), ("fx_regression", "net"), ("fx_multiclass", "o_orderstatus"),
             ("fx_missing", "toxic"), ("fx_missing", "source"), ("fx_regression", "l_tax")]


def _p2_sql():
    names = sorted({f for f, _ in _P2_CASES})
    sel = []
    for f, t in _P2_CASES:
        num = t not in ("o_orderstatus", "source")
        sel.append(f"SELECT {lit(f)} AS fixture, {lit(t)} AS target, CAST(count(DISTINCT {t}) AS BIGINT) AS n_distinct, "
                   f"CASE WHEN count(DISTINCT {t}) <= 10 THEN 'classification' "
                   f"WHEN {'true' if num else 'false'} THEN 'regression' ELSE 'classification' END AS problem_type "
                   f"FROM {f}")
    return fixture_cte(*names) + union_all(sel)


@query("p2_problem_type", sql=_p2_sql())
def p2_problem_type(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for f, tgt in _P2_CASES:
        r = schema.problem_type_frame(fixture(t, f), tgt).select(F.lit(f).alias("fixture"), "*")
        out = r if out is None else out.unionByName(r)
    return out


# ---- P3: validation --------------------------------------------------------
def _p3_sql():
    empties = " || ".join(f"CASE WHEN count({q(c)}) = 0 THEN ',{c}' ELSE '' END" for c in MISSING_COLS)
    return fixture_cte("fx_missing") + f"""
, a AS (SELECT count(*) AS n, ltrim({empties}, ',') AS empties FROM fx_missing)
SELECT 'min_rows' AS "check", n >= 10 AS passed, CAST(n AS VARCHAR) AS detail FROM a
UNION ALL SELECT 'target_present', true, 'toxic' FROM a
UNION ALL SELECT 'no_empty_columns', empties = '', empties FROM a
UNION ALL SELECT 'min_columns', true, '6' FROM a"""


@query("p3_validation", sql=_p3_sql())
def p3_validation(spark, sf_dir):
    return schema.validation_frame(fixture(Tables(spark, sf_dir), "fx_missing"), "toxic")


# ---- A1: missing profile ---------------------------------------------------
@query("a1_missing_profile", sql=fixture_cte("fx_nulls") + f"""
SELECT ordinal, column_name, n_missing, {r6('missing_pct', 'missing_pct')}, penalty, severity
FROM {missing_findings_sql('fx_nulls', NULLS_COLS)}""", headline=True)
def a1_missing_profile(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_nulls")
    return finish(qual.missing_table(df).select("ordinal", "column_name", "n_missing", "missing_pct",
                                                "penalty", "severity"))


# ---- A3: class distribution -------------------------------------------------
@query("a3_class_distribution", sql=fixture_cte("fx_multiclass") + """
SELECT o_orderstatus, count(*) AS count FROM fx_multiclass WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def a3_class_distribution(spark, sf_dir):
    return qual.class_counts(fixture(Tables(spark, sf_dir), "fx_multiclass"), "o_orderstatus")


# ---- A4: class imbalance ---------------------------------------------------
@query("a4_class_imbalance", sql=fixture_cte("fx_severe", "fx_imbalanced", "fx_binary") + union_all([
    f"SELECT {lit(f)} AS fixture, {r6('minority_pct', 'minority_pct')}, n_classes, penalty, severity, message "
    f"FROM {imbalance_sql(f, t)}" for f, t in [("fx_severe", "is_large"), ("fx_imbalanced", "toxic"),
                                              ("fx_binary", "high_value")]]))
def a4_class_imbalance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for f, tgt in [("fx_severe", "is_large"), ("fx_imbalanced", "toxic"), ("fx_binary", "high_value")]:
        r = qual.imbalance_table(fixture(t, f), tgt, "classification").select(F.lit(f).alias("fixture"), "*")
        out = r if out is None else out.unionByName(r)
    return finish(out)


# ---- A5: duplicate rows ----------------------------------------------------
@query("a5_duplicates", sql=fixture_cte("fx_dups") + f"""
SELECT n_rows, duplicate_rows, {r6('duplicate_pct', 'duplicate_pct')}, penalty, severity, message
FROM {duplicates_sql('fx_dups', ['c_nationkey', 'c_mktsegment'])}""")
def a5_duplicates(spark, sf_dir):
    return finish(qual.duplicate_table(fixture(Tables(spark, sf_dir), "fx_dups")))


# ---- A6 / P10 / P11 / F4: z-score outliers ---------------------------------
_A6_COLS = ["event_id", "user_id", "value"]


@query("a6_outliers", sql=f"""
SELECT ordinal, column_name, n_nonnull, outliers, {r6('outlier_pct', 'outlier_pct')}, penalty, severity, message
FROM {outliers_sql('events', _A6_COLS)}""", headline=True)
def a6_outliers(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select(*_A6_COLS)
    return finish(qual.outlier_table(ev, _A6_COLS))


# ---- A7-A9: quality report --------------------------------------------------
_QK = {"doc_id": "numerical", "lang": "categorical", "source": "categorical",
       "n_chars": "numerical", "quality": "numerical", "toxic": "numerical"}
_QNUM = [c for c, k in _QK.items() if k == "numerical"]


def _quality_parts_sql():
    return (fixture_cte("fx_missing") + f""",
mi AS {missing_findings_sql('fx_missing', MISSING_COLS)},
im AS {imbalance_sql('fx_missing', 'toxic')},
du AS {duplicates_sql('fx_missing', MISSING_COLS)},
ou AS {outliers_sql('fx_missing', _QNUM)}
""")


_A9_SQL = _quality_parts_sql() + """
SELECT 100000 + ordinal AS seq, severity, message FROM mi WHERE message IS NOT NULL
UNION ALL SELECT 200000, severity, message FROM im
UNION ALL SELECT 300000, severity, message FROM du
UNION ALL SELECT 400000 + ordinal, severity, message FROM ou WHERE message IS NOT NULL"""

_A7_SQL = _quality_parts_sql() + """,
p AS (SELECT (SELECT coalesce(sum(penalty), 0) FROM mi) AS mp, (SELECT coalesce(sum(penalty), 0) FROM im) AS ip,
             (SELECT coalesce(sum(penalty), 0) FROM du) AS dp, (SELECT coalesce(sum(penalty), 0) FROM ou) AS op,
             (SELECT max(duplicate_rows) FROM du) AS dr)
SELECT CAST(round(greatest(0.0, 100.0 - (mp + ip + dp + op)), 1) AS DOUBLE) AS quality_score,
       CASE WHEN greatest(0.0, 100.0 - (mp + ip + dp + op)) >= 80 THEN 'Good'
            WHEN greatest(0.0, 100.0 - (mp + ip + dp + op)) >= 60 THEN 'Moderate'
            WHEN greatest(0.0, 100.0 - (mp + ip + dp + op)) >= 40 THEN 'Poor' ELSE 'Critical' END AS quality_label,
       CAST(mp AS INTEGER) AS missing_penalty, CAST(ip AS INTEGER) AS imbalance_penalty,
       CAST(dp AS INTEGER) AS duplicate_penalty, CAST(op AS INTEGER) AS outlier_penalty,
       CAST(mp + ip + dp + op AS INTEGER) AS total_penalty, CAST(dr AS BIGINT) AS duplicate_rows
FROM p"""


def _quality(spark, sf_dir):
    df = fixture(Tables(spark, sf_dir), "fx_missing")
    return qual.run_quality_check(df, _QK, "toxic", "classification")


@query("a9_quality_warnings", sql=_A9_SQL, headline=True)
def a9_quality_warnings(spark, sf_dir):
    return _quality(spark, sf_dir).warnings


@query("a7_quality_score", sql=_A7_SQL)
def a7_quality_score(spark, sf_dir):
    return finish(_quality(spark, sf_dir).summary)
