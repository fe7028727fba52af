"""Exact order statistics against sorting, with every number of rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import clean, eda, ranks, scale

RNG = np.random.default_rng(11)
N = 3000
COLUMNS = {"plain": RNG.normal(size=N), "tails": np.exp(RNG.normal(size=N) * 60), "ties": RNG.integers(0, 7, N).astype(float),
           "two": (RNG.random(N) < 0.5).astype(float), "one": np.full(N, 3.25), "hot": np.where(RNG.random(N) < 0.4, 1.0, RNG.normal(size=N)),
           "signs": np.where(RNG.random(N) < 0.5, -1e308, 1e308) * RNG.random(N), "whole": RNG.integers(-10 ** 15, 10 ** 15, N).astype(float),
           "inf": np.where(RNG.random(N) < 0.3, np.inf, np.where(RNG.random(N) < 0.5, -np.inf, RNG.normal(size=N)))}
PROBS = [0.0, 0.1, 0.25, 0.5, 0.501, 0.75, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    gaps = RNG.random((N, len(COLUMNS))) < 0.05
    rows = [tuple(None if g else float(v) for v, g in zip(r, gs, strict=True)) for r, gs in zip(zip(*COLUMNS.values(), strict=True), gaps, strict=True)]
    df = spark.createDataFrame([(*r, None, float("nan") if i % 3 == 0 else 1.0 * i) for i, r in enumerate(rows)],
                               ", ".join(f"`{c}` double" for c in [*COLUMNS, "none", "nan"]))
    return df.repartition(4).persist()


def plain(values, p):
    x = sorted(values, key=lambda v: (math.isnan(v), v))
    at = p * (len(x) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return x[lo] if lo == hi or x[lo] == x[hi] else (hi - at) * x[lo] + (at - lo) * x[hi]


@pytest.mark.parametrize(("rows", "accuracy"), [(1 << 14, 2000), (200, 100), (3, 8)])
def test_quantiles_against_sorting(table, monkeypatch, rows, accuracy):
    monkeypatch.setattr(ranks, "SORT_ROWS", rows)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    names = table.columns
    got = ranks.quantiles(table, names, PROBS)
    data = table.toPandas().to_dict("list")
    values = {c: [r[c] for r in table.select(c).where(F.col(c).isNotNull()).collect()] for c in names}
    assert got["none"] is None and len(data) == len(names)
    for c in names:
        for p, v in zip(PROBS, got[c] or [], strict=False):
            want = plain(values[c], p)
            assert v == want or (math.isnan(v) and math.isnan(want)), (c, p, v, want)


def test_callers_take_exact_values_at_any_size(table, monkeypatch):
    """Median imputation, robust scaling and box statistics are the same however many rounds they take."""
    cols = ["plain", "ties", "hot", "none"]

    def all_of_them():
        return (clean.fit_impute(table, dict.fromkeys(cols, "numerical"), cols, every=True), scale.fit_robust(table, cols),
                eda.box_stats(table, cols).collect(), sorted(map(tuple, eda.box_fliers(table, cols).collect())))
    want = all_of_them()
    monkeypatch.setattr(ranks, "SORT_ROWS", 20)
    monkeypatch.setattr(ranks, "ACCURACY", 50)
    assert all_of_them() == want
    assert want[0]["plain"] == plain([r[0] for r in table.select("plain").dropna().collect()], 0.5) and want[0]["none"] is None


def test_no_rows(table):
    assert ranks.quantiles(table.limit(0), ["plain"], [0.5]) == {"plain": None} and ranks.quantiles(table, [], [0.5]) == {}


def test_median_query_keeps_no_table_of_values(spark, monkeypatch):
    """Exact percentiles hold every distinct value in one buffer; the query takes ranks."""
    from conftest import SF_SMALL
    from tabforge.plans import q_prep
    asked, plain = [], ranks.quantiles
    monkeypatch.setattr(ranks, "quantiles", lambda df, cols, probs: (asked.append((cols, probs)), plain(df, cols, probs))[1])
    rows = {r["column_name"]: r["median"] for r in q_prep.a12_median(spark, SF_SMALL).collect()}
    assert asked == [(["l_quantity", "l_extendedprice", "l_discount"], [0.5])] and all(v is not None for v in rows.values())
