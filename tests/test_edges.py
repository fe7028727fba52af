"""Edge cases: constant and all-null columns, ties, NaN, booleans, negatives, one-row classes."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.operators import clean, eda, quality, schema, select


@pytest.fixture(scope="module")
def edges(spark):
    rows = []
    for i in range(40):
        rows.append((i, 5.0, None, float("nan") if i == 3 else float(i) - 20.0, "a" if i % 2 else "b",
                     i % 2 == 0, "x" if i < 39 else "y", i % 4))
    return spark.createDataFrame(rows, "id long, const double, allnull double, neg double, cat string, "
                                       "flag boolean, rare string, y int")


def test_validation_reports_empty_column(edges):
    with pytest.raises(schema.ValidationError) as e:
        schema.validate(edges, "y")
    assert "allnull" in str(e.value)


def test_types_and_nan_to_null(edges):
    kinds = schema.detect_column_types(edges)
    assert kinds["neg"] == "numerical" and kinds["cat"] == "categorical" and kinds["flag"] == "categorical"
    typed = schema.apply_types(edges, kinds)
    assert typed.where(F.col("neg").isNull()).count() == 1


def test_constant_column_statistics(edges):
    sk = {r["column_name"]: r["skewness"] for r in eda.skewness_table(edges, ["const", "neg"]).collect()}
    assert sk["const"] == 0.0
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in eda.correlation_long(edges, ["const", "id"]).collect()}
    assert corr[("const", "id")] is None
    out = quality.outlier_table(edges, ["const"]).first()
    assert out["outliers"] == 0
    h = eda.histogram(edges, ["const"]).where("count > 0").collect()
    assert len(h) == 1 and h[0]["bin"] == 15 and h[0]["count"] == 40


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert clean.fit_impute(df, {"c": "categorical"}, ["c"]) == {"c": "a"}


def test_one_hot_single_value_vanishes_and_binary_labels(spark, edges):
    enc = clean.fit_encoding(edges, {"cat": "categorical", "rare": "categorical", "flag": "categorical"}, "y",
                             "classification", ["cat", "rare", "flag"])
    assert enc.label["cat"] == ["a", "b"] and enc.label["flag"] == ["false", "true"]
    assert enc.label["rare"] == ["x", "y"]
    single = spark.createDataFrame([("z",)] * 5 + [(None,)], "c string")
    e2 = clean.fit_encoding(single, {"c": "categorical"}, "none", "regression", ["c"])
    assert e2.onehot == {"c": ["z"]} and e2.feature_columns(["c"]) == []


def test_variance_filter_all_constant_raises(spark):
    df = spark.createDataFrame([(1.0, 0.0)] * 10 + [(1.0, 1.0)] * 10, "a double, label double")
    with pytest.raises(ValueError):
        select.select_features(df, ["a"], "label", "classification")


def test_anova_matches_closed_form(spark):
    rows = [(0.0, 1.0), (0.0, 2.0), (0.0, 3.0), (1.0, 5.0), (1.0, 6.0), (1.0, 8.0)]
    df = spark.createDataFrame(rows, "label double, x double")
    f = select.anova_f(df, ["x"], "label").first()["score"]
    g0, g1 = [1, 2, 3], [5, 6, 8]
    m0, m1, m = sum(g0) / 3, sum(g1) / 3, (sum(g0) + sum(g1)) / 6
    ssb = 3 * (m0 - m) ** 2 + 3 * (m1 - m) ** 2
    ssw = sum((x - m0) ** 2 for x in g0) + sum((x - m1) ** 2 for x in g1)
    assert math.isclose(f, (ssb / 1) / (ssw / 4), rel_tol=1e-9)


def test_quality_score_floor(spark):
    df = spark.createDataFrame([(None, None, 1)] * 8 + [(1.0, "a", 1)] * 2, "a double, b string, y int")
    rep = quality.run_quality_check(df, {"a": "numerical", "b": "categorical", "y": "numerical"}, "y",
                                    "classification")
    s = rep.summary.first()
    assert 0 <= s["quality_score"] <= 100
    assert s["missing_penalty"] == 30 and s["duplicate_penalty"] == 10


def test_median_between_integers_is_kept(spark):
    from tabforge.operators import clean
    df = spark.createDataFrame([(2,), (3,), (None,)], "a int")
    v = clean.fit_impute(df, {"a": "numerical"}, ["a"])
    assert sorted(r.a for r in clean.apply_impute(df, v).collect()) == [2.0, 2.5, 3.0]


def test_every_column_gets_a_fill_value_for_later_rows(spark):
    from tabforge.operators import clean
    df = spark.createDataFrame([(1.0, "x"), (3.0, "x")], "a double, b string")
    kinds = {"a": "numerical", "b": "categorical"}
    assert clean.fit_impute(df, kinds, ["a", "b"]) == {}
    assert clean.fit_impute(df, kinds, ["a", "b"], every=True) == {"a": 2.0, "b": "x"}


def test_box_fliers_keep_repeats_and_skip_null_columns(spark):
    from tabforge.operators import eda
    df = spark.createDataFrame([(float(i % 5), None) for i in range(50)] + [(99.0, None), (99.0, None), (None, None)],
                               "a double, b double")
    got = [tuple(r) for r in eda.box_fliers(df, ["a", "b"]).collect()]
    assert got == [(0, "a", 99.0, 2)]
    assert eda.box_fliers(df.where("false"), ["a", "b"]).count() == 0
