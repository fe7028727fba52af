"""Property tests: exact split, fold balance, SMOTE geometry, neighbours, AUC, importances."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.operators import importance, learners, metrics, neighbors, resample, split

from conftest import SF_SMALL
from tabforge.sources.fixtures import LINEITEM_KEY, fixture
from tabforge.sources.tables import Tables


@pytest.fixture(scope="module")
def binary(spark):
    return fixture(Tables(spark, SF_SMALL), "fx_binary").cache()


def test_split_is_exact_per_class(binary):
    d = split.split(binary, LINEITEM_KEY, "high_value")
    g = {(r["high_value"], r["is_test"]): r["c"] for r in
         d.groupBy("high_value", "is_test").agg(F.count(F.lit(1)).alias("c")).collect()}
    for cls in {k[0] for k in g}:
        n = g.get((cls, True), 0) + g.get((cls, False), 0)
        assert g.get((cls, True), 0) == math.ceil(0.2 * n)
    assert d.count() == binary.count()


def test_split_rejects_single_row_class(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)] + [(99, "b")], "k long, y string")
    with pytest.raises(ValueError):
        split.split(df, ["k"], "y")


def test_split_ignores_partitioning(binary):
    a = split.split(binary, LINEITEM_KEY, "high_value").where("is_test").select(*LINEITEM_KEY)
    b = split.split(binary.repartition(7), LINEITEM_KEY, "high_value").where("is_test").select(*LINEITEM_KEY)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bucketed_rank_equals_window(binary):
    from pyspark.sql import Window
    from tabforge.functions.hashing import hash_hex
    r = split.rank_within(binary, LINEITEM_KEY, "high_value", salt="rank", out="rk")
    w = Window.partitionBy("high_value").orderBy(hash_hex(LINEITEM_KEY, 42, "rank"))
    plain = binary.withColumn("rk", F.row_number().over(w).cast("bigint"))
    cols = LINEITEM_KEY + ["rk"]
    assert r.select(*cols).exceptAll(plain.select(*cols)).count() == 0


def test_folds_balanced(binary):
    f = split.assign_folds(binary, LINEITEM_KEY, "high_value")
    for r in f.groupBy("high_value").agg(F.min("c").alias("mn"), F.max("c").alias("mx")).collect() if False else []:
        pass
    c = f.groupBy("high_value", "fold").agg(F.count(F.lit(1)).alias("c"))
    for r in c.groupBy("high_value").agg(F.min("c").alias("mn"), F.max("c").alias("mx")).collect():
        assert r["mx"] - r["mn"] <= 1
    assert {r["fold"] for r in f.select("fold").distinct().collect()} == {0, 1, 2, 3, 4}


def _brute_knn(rows, k, exclude_self=True, group=True):
    out = {}
    for q in rows:
        cands = []
        for r in rows:
            if exclude_self and r[0] == q[0]:
                continue
            if group and r[1] != q[1]:
                continue
            d = math.sqrt(sum((a - b) ** 2 for a, b in zip(q[2], r[2])))
            cands.append((d, r[0]))
        out[q[0]] = [c[1] for c in sorted(cands)[:k]]
    return out


def test_knn_matches_brute_force(spark):
    v = fixture(Tables(spark, SF_SMALL), "fx_vectors")
    got = neighbors.knn(v, v, ["embedding"], 4, ["vec_id"], ["vec_id"], group="label", exclude_self=True)
    rows = [(r["vec_id"], r["label"], [float(x) for x in r["embedding"]]) for r in v.collect()]
    want = _brute_knn(rows, 4)
    have = {}
    for r in got.orderBy("q_vec_id", "nn_rank").collect():
        have.setdefault(r["q_vec_id"], []).append(r["r_vec_id"])
    assert have == want


def test_knn_scalar_features_with_widening(spark):
    # clustered points force the candidate window to widen
    pts = [(i, 0, float(i % 3) * 1000.0 + i * 0.001, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(pts, "k long, g int, x double, y double")
    got = neighbors.knn(df, df, ["x", "y"], 3, ["k"], ["k"], exclude_self=True)
    rows = [(p[0], 0, [p[2], p[3]]) for p in pts]
    want = _brute_knn(rows, 3)
    have = {}
    for r in got.orderBy("q_k", "nn_rank").collect():
        have.setdefault(r["q_k"], []).append(r["r_k"])
    assert have == want


def test_smote_points_on_segments(spark):
    rows = [(f"k{i}", 1.0 if i < 6 else 0.0, float(i), float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "_key string, label double, a double, b double")
    out = resample.smote(df, ["a", "b"])
    counts = {r["label"]: r["c"] for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert counts[0.0] == counts[1.0] == 24
    syn = out.where("_synthetic").collect()
    minority = [(float(i), float(i * i)) for i in range(6)]
    for s in syn:
        ok = False
        for p in minority:
            for q in minority:
                if p == q:
                    continue
                # on segment p-q: cross product ~0 and within bounds
                cross = (q[0] - p[0]) * (s["b"] - p[1]) - (q[1] - p[1]) * (s["a"] - p[0])
                if abs(cross) < 1e-6 and min(p[0], q[0]) - 1e-9 <= s["a"] <= max(p[0], q[0]) + 1e-9:
                    ok = True
        assert ok


def test_auc_equals_pairwise(spark):
    rows = [(1.0 if i % 3 == 0 else 0.0, round((i * 37 % 101) / 101.0, 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "label double, score double")
    got = metrics.roc_auc(df).first()["roc_auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_forest_importances_sum_to_one(spark, binary):
    d = binary.select("l_quantity", "l_extendedprice", "l_discount", F.col("high_value").cast("double").alias("label"))
    imp = importance.forest_importance(d, ["l_quantity", "l_extendedprice", "l_discount"], "classification",
                                       n_classes=2)
    assert abs(sum(r["importance"] for r in imp.collect()) - 1.0) < 1e-9


def test_naive_bayes_learns_binary_signal(spark, binary):
    d = binary.select(*LINEITEM_KEY, "l_quantity", "l_extendedprice", F.col("high_value").cast("double").alias("label"))
    d = split.split(d, LINEITEM_KEY, "label")
    m = learners.fit("Naive Bayes", d.where(~F.col("is_test")), ["l_quantity", "l_extendedprice"], "classification")
    acc = metrics.classification_metrics(m.transform(d.where("is_test"))).first()["accuracy"]
    assert acc > 0.5


def test_permutation_importance_ranks_signal_first(spark, binary):
    d = binary.select(*LINEITEM_KEY, "l_extendedprice", "l_tax", F.col("high_value").cast("double").alias("label"))
    d = split.split(d, LINEITEM_KEY, "label")
    m = learners.fit("Naive Bayes", d.where(~F.col("is_test")), ["l_extendedprice", "l_tax"], "classification")
    imp = importance.permutation_importance(m, d.where("is_test"), ["l_extendedprice", "l_tax"], LINEITEM_KEY,
                                            "classification").collect()
    assert imp[0]["feature"] == "l_extendedprice" and imp[0]["importance_mean"] > 0.1


def test_knn_hot_duplicate_point(spark):
    # a third of the rows share one feature vector; ties resolve by key
    pts = [(i, i % 2, 1.0, 2.0) for i in range(30)] + [(100 + i, i % 2, float(i % 9), float(i // 9)) for i in range(60)]
    df = spark.createDataFrame(pts, "k long, g int, x double, y double")
    got = neighbors.knn(df, df, ["x", "y"], 5, ["k"], ["k"], group="g", exclude_self=True)
    rows = [(p[0], p[1], [p[2], p[3]]) for p in pts]
    want = _brute_knn(rows, 5)
    have = {}
    for r in got.orderBy("q_k", "nn_rank").collect():
        have.setdefault(r["q_k"], []).append(r["r_k"])
    assert have == want


def test_knn_discrete_features(spark):
    # binary / small-integer features: many distinct points share each coordinate value
    pts = [(i, 0, float(i % 2), float((i // 2) % 2), float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(pts, "k long, g int, a double, b double, c double")
    got = neighbors.knn(df, df, ["a", "b", "c"], 4, ["k"], ["k"], exclude_self=True)
    want = _brute_knn([(p[0], 0, [p[2], p[3], p[4]]) for p in pts], 4)
    have = {}
    for r in got.orderBy("q_k", "nn_rank").collect():
        have.setdefault(r["q_k"], []).append(r["r_k"])
    assert have == want


class _Seen:
    """A model that keeps what it is asked to score."""
    name = "seen"

    def __init__(self):
        self.frames = []

    def transform(self, df):
        self.frames.append(df)
        return df.withColumn("prediction", F.col("label"))


def test_every_feature_and_repeat_has_a_permutation_of_its_own(spark):
    # the same values in two features: a permutation shared by the features would give both the same columns
    df = spark.createDataFrame([(i, float(i), float(i), float(i % 2)) for i in range(97)], "k long, a double, b double, label double")
    m = _Seen()
    importance.permutation_importance(m, df, ["a", "b"], ["k"], "classification", n_repeats=3).collect()
    got = {}
    for r in m.frames[-1].collect():
        got.setdefault((r["_f"], r["_r"]), {})[r["k"]] = (r["a"], r["b"])
    assert set(got) == {(f, r) for f in range(2) for r in range(3)}
    taken = set()
    for (f, _), rows in got.items():
        assert sorted(v[f] for v in rows.values()) == [float(i) for i in range(97)]
        assert all(v[1 - f] == float(k) for k, v in rows.items())
        taken.add(tuple(rows[k][f] for k in sorted(rows)))
    assert len(taken) == 6


def test_permutations_broadcast_no_rows(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(50)], "k long, a double, label double")
    m = _Seen()
    importance.permutation_importance(m, df, ["a"], ["k"], "classification", n_repeats=2).collect()
    plan = m.frames[-1]._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_over_many_cells_and_blocks(spark, monkeypatch, metric):
    # equal numbers of points a cell, several blocks a cell, ties, copies, a null and a NaN that take no part
    monkeypatch.setattr(neighbors, "CELL_POINTS", 16)
    monkeypatch.setattr(neighbors, "REF_BLOCK", 7)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 5)
    pts = [(i, i % 2, float(int(1.05 ** (i % 110))), float(i % 3)) for i in range(240)]
    df = spark.createDataFrame([*pts, (900, 0, None, 1.0), (901, 0, float("nan"), 1.0)], "k long, g int, x double, y double")
    got = neighbors.knn(df, df, ["x", "y"], 4, ["k"], ["k"], group="g", exclude_self=True, metric=metric)
    have = {}
    for r in got.orderBy("q_k", "nn_rank").collect():
        have.setdefault(r["q_k"], []).append((r["dist"], r["r_k"]))
    dist = (lambda a, b: sum(abs(x - y) for x, y in zip(a, b))) if metric == "manhattan" else math.dist
    for k, g, *v in pts:
        assert have.pop(k) == sorted((dist(v, w), j) for j, h, *w in pts if h == g and j != k)[:4]
    assert not have


def test_knn_blocks_give_few_candidates():
    """At most k + 1 candidates of a query leave a block, however many points lie equally near; the smallest keys win."""
    out = neighbors._nearest(3, "euclidean")(*_blocks(50, 400))
    assert out.num_rows == 150 and set(out.column("_pid").to_pylist()) == {0, 1, 2} and set(out.column("dist").to_pylist()) == {1.0}


def _blocks(n_q, n_r):
    import pyarrow as pa
    first = pa.StructArray.from_arrays([pa.array(range(n_r))], ["k"])
    q = pa.table({"_qid": range(n_q), "_v": [[0.0, 0.0]] * n_q, "_R": [float("inf")] * n_q})
    return q, pa.table({"_pid": range(n_r), "_v": [[1.0, 0.0]] * n_r, "_first": first})
