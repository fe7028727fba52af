"""The Huber regression on Fourier features: MLlib's model, without keeping the mapped rows."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabforge.operators import huber, learners
from tabforge.sources.models import load_fitted, save_fitted

FEATURES = ["a", "b", "c"]


def table(spark, n, parts=4):
    rows = spark.range(n, numPartitions=parts).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 1.7).alias("b"), (F.col("id") % 3).cast("int").alias("c"))
    return rows.withColumn("label", 1000 * F.sin(2 * F.col("a")) + 300 * F.col("b") * F.col("c") + F.when(F.col("id") % 17 == 0, 4000).otherwise(7 * (F.col("id") % 11)))


def test_fit_holds_the_rows_and_not_their_maps(spark, monkeypatch):
    stored, collected = [], huber._collected

    def watched(*a):
        out = collected(*a)
        stored.append(sum(x.memSize() + x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
        return out

    spark.catalog.clearCache()
    before = sum(x.memSize() + x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    monkeypatch.setattr(huber, "_collected", watched)
    n = 20_000
    m = learners.fit("SVM", table(spark, n), FEATURES, "regression")
    assert len(stored) > 5 and max(stored) - before < n * 8 * (len(FEATURES) + 2) < n * 8 * m.params["rff"]["dim"] / 10
    assert len(m.params["huber"]["coef"]) == m.params["rff"]["dim"]


@pytest.mark.parametrize("rows", [
    lambda s: table(s, 3000),
    lambda s: table(s, 900, 1).unionAll(table(s, 900, 1)).unionAll(table(s, 900, 1).where("id < 0")),
    lambda s: table(s, 600).withColumn("a", F.lit(2.0)).withColumn("label", F.col("label") * 1e5 + 1e7),
    lambda s: table(s, 40, 9),
], ids=["plain", "repeated rows and an empty partition", "a constant feature and a large label", "few rows"])
def test_model_is_the_librarys(spark, rows):
    d = rows(spark).persist()
    m = learners.fit("SVM", d, FEATURES, "regression", params={"C": 0.5})
    lr = LinearRegression(loss="huber", regParam=1.0 / (0.5 * d.count()), maxIter=100).fit(d.withColumn("features", learners.rff_vector(FEATURES, m.params["rff"])))
    ours, theirs = m.params["huber"], lr.summary.objectiveHistory
    assert len(ours["history"]) == len(theirs) and np.allclose(ours["history"], theirs, rtol=1e-6)
    assert math.isclose(ours["scale"], lr.scale, rel_tol=1e-5)
    found = m.transform(d).select("id", "prediction").orderBy("id").toPandas()["prediction"]
    known = lr.transform(d.withColumn("features", learners.rff_vector(FEATURES, m.params["rff"]))).select("id", "prediction").orderBy("id").toPandas()["prediction"]
    assert np.allclose(found, known, rtol=1e-5, atol=1e-6 * known.abs().max())
    d.unpersist()


def test_constant_label_and_one_point(spark):
    m = learners.fit("SVM", table(spark, 50).withColumn("label", F.lit(5.0)), FEATURES, "regression")
    assert {r[0] for r in m.transform(table(spark, 5)).select("prediction").collect()} == {5.0}
    one = spark.range(30).select("id", F.lit(0.1).alias("a"), F.lit(0.7).alias("b"), F.lit(1).alias("c"), F.col("id").cast("double").alias("label"))
    m = learners.fit("SVM", one, FEATURES, "regression")
    assert not any(m.params["huber"]["coef"]) and abs(m.params["huber"]["intercept"] - 14.5) < 1


@pytest.mark.parametrize("column", ["b", "label"])
@pytest.mark.parametrize("value", [None, math.nan, math.inf])
def test_unknown_values_are_errors(spark, column, value):
    d = table(spark, 20).withColumn(column, F.when(F.col("id") == 7, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(Exception, match=f"null, NaN or infinity in {column}"):
        learners.fit("SVM", d, FEATURES, "regression", n_rows=20)


def test_no_rows_is_an_error(spark):
    none = table(spark, 5).where("id < 0").select("a", "b", F.col("label").alias("y"))
    with pytest.raises(ValueError, match="no rows"):
        huber.fit(none, learners.rff_params(["a", "b"], 1.0), 1.0)


def test_saved_model_predicts_the_same(spark, tmp_path):
    d = table(spark, 300)
    m = learners.fit("SVM", d, FEATURES, "regression")
    save_fitted(m, str(tmp_path / "m"))
    again, _ = load_fitted(str(tmp_path / "m"))
    assert again.transform(d).orderBy("id").collect() == m.transform(d).orderBy("id").collect()


def test_map_is_the_cosine():
    rng = np.random.default_rng(3)
    rff = {"w": rng.normal(size=(64, 5)).tolist(), "b": rng.uniform(0, 2 * math.pi, 64).tolist(), "dim": 64}
    for spread in (1e-3, 1, 50):
        x = rng.normal(size=(huber.SLICE, 5)) * spread
        assert np.abs(huber.Map(rff)(x) - math.sqrt(2 / 64) * np.cos(x @ np.array(rff["w"]).T + np.array(rff["b"]))).max() < 1e-13
