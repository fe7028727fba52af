"""The registered support-vector regressor uses every feature of its table, encoded by the library."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabforge.operators import learners
from tabforge.plans import q_run
from tabforge.sources.fixtures import LINE_FEATURES, fixture
from tabforge.sources.tables import Tables


def test_svm_regressor_fits_on_all_features(spark, monkeypatch):
    seen, fit = [], learners.fit
    monkeypatch.setattr(learners, "fit", lambda name, df, features, *a, **k: (seen.append(features), fit(name, df, features, *a, **k))[1])
    rows = q_run.l3g_svm_regressor(spark, SF_SMALL).collect()
    table = fixture(Tables(spark, SF_SMALL), "fx_regression")
    flags = sorted(r[0] for r in table.select("l_returnflag").distinct().collect())
    assert len(flags) == 3 and table.select("l_linestatus").distinct().count() == 2
    numbers = [c for c in LINE_FEATURES if not c.startswith(("l_returnflag", "l_linestatus"))]
    assert seen == [[*numbers, "l_linestatus", *[f"l_returnflag_{v}" for v in flags[1:]]]]
    mean = table.agg(F.mean("net")).first()[0]
    error, spread = (sum((r.label - x(r)) ** 2 for r in rows) for x in (lambda r: r.prediction, lambda r: mean))
    assert error < 0.5 * spread


def test_mapped_rows_are_not_held_beside_the_optimizers_blocks(spark, monkeypatch):
    table = spark.range(200).select(F.col("id").cast("double").alias("a"), F.sin("id").alias("b"), F.lit(2).alias("c"), (F.col("id") * 3 + 1).cast("double").alias("label"))
    widths, persist = [], type(table).persist
    monkeypatch.setattr(type(table), "persist", lambda df, *a, **k: (widths.append(len(df.columns)), persist(df, *a, **k))[1])
    m = learners.fit("SVM", table, ["a", "b", "c"], "regression")
    assert widths and max(widths) <= 4
    rff = m.params["rff"]
    for r in table.select("*", learners.rff_vector(["a", "b", "c"], rff).alias("z")).limit(20).collect():
        for z, w, b in zip(r["z"], rff["w"], rff["b"]):
            assert abs(z - math.sqrt(2 / rff["dim"]) * math.cos(b + w[0] * r["a"] + w[1] * r["b"] + w[2] * r["c"])) < 1e-12
    out = m.transform(table)
    assert out.columns == [*table.columns, "prediction"] and out.count() == 200
