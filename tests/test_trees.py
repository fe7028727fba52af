"""Level-grown trees against a plain recursive version, and the same forest at any partitioning."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tabforge.operators import trees

X = ["a", "b", "c"]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double")


def rows_of(n, kind, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rnd.randrange(6) / 4, round(rnd.gauss(0, 1), 3), float(rnd.randrange(2))
        if kind == "regression":
            y = round(a * 2 - b + rnd.random(), 4)
        else:
            y = float((a > 0.5) + (b > 0.2) * (1 if kind == 3 else 0)) if rnd.random() > 0.1 else float(rnd.randrange(3 if kind == 3 else 2))
        out.append((i, a, b, c, y))
    return out


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def plain(rows, kind, tree, m, max_depth, bootstrap, min_split=2, criterion="gini"):
    """node -> (n, n_rows, feature, threshold, sums), by the definition."""
    steps = trees.poisson_steps()
    lo, hi = min(r[4] for r in rows), max(r[4] for r in rows)
    k = int(hi) + 1
    data = []
    for r in rows:
        u = int(md5(r[0], tree, 42, "bootstrap")[:8], 16) / 2 ** 32
        w = sum(u >= s for s in steps) if bootstrap else 1
        y = math.floor((r[4] - lo) / ((hi - lo) or 1.0) * trees.GRID + 0.5) if kind == "regression" else int(r[4])
        if w:
            data.append((r[1:4], y, w))

    def sums(d):
        if kind == "regression":
            return [sum(w for _, _, w in d), sum(w * y for _, y, w in d)]
        return [sum(w for _, y, w in d if y == c) for c in range(k)]

    def score(s):
        if kind == "regression":
            return float(s[1]) * float(s[1]) / s[0]
        if criterion == "entropy":
            return sum(c * math.log(c) for c in s if c) - sum(s) * math.log(sum(s))
        return sum(float(c) * c for c in s) / sum(s)

    out = {}

    def grow(node, d):
        s = sums(d)
        n = s[0] if kind == "regression" else sum(s)
        vary = [f for f in range(3) if len({x[f] for x, _, _ in d}) > 1]
        if m < 3:
            vary = sorted(vary, key=lambda f: md5(tree, node, f, 42, "features"))[:m]
        best = None
        if len({y for _, y, _ in d}) > 1 and len(d) >= min_split and (max_depth is None or len(node) < max_depth):
            for f in sorted(vary):
                values = sorted({x[f] for x, _, _ in d})
                for p, q in zip(values, values[1:]):
                    t = p / 2 + q / 2
                    t = t if t < q else p
                    sc = score(sums([e for e in d if e[0][f] <= t])) + score(sums([e for e in d if e[0][f] > t]))
                    if best is None or sc > best[0]:
                        best = (sc, f, t)
        out[node] = (n, len(d), best and best[1], best and best[2], s)
        if best:
            grow(node + "0", [e for e in d if e[0][best[1]] <= best[2]])
            grow(node + "1", [e for e in d if e[0][best[1]] > best[2]])

    grow("", data)
    return out


def found(model):
    return {(r["tree"], r["node"]): (r["n"], r["n_rows"], r["feature"], r["threshold"], list(r["value"])) for r in model.nodes.collect()}


@pytest.mark.parametrize("kind, n_trees, m, depth, criterion", [
    (3, 3, 2, None, "gini"), ("regression", 1, 3, 3, "gini"), (2, 2, 1, 3, "entropy")])
def test_equal_to_a_plain_recursive_tree(spark, kind, n_trees, m, depth, criterion):
    rows = rows_of(90, kind)
    model = trees.fit(table(spark, rows), X, ["id"], "regression" if kind == "regression" else "classification", n_trees=n_trees, max_features=m,
                      max_depth=depth, criterion=criterion)
    got = found(model)
    want = {(t, node): v for t in range(n_trees) for node, v in plain(rows, kind, t, m, depth, n_trees > 1, criterion=criterion).items()}
    assert got.keys() == want.keys()
    for at, (n, n_rows, f, t, s) in want.items():
        assert got[at][:4] == (n, n_rows, f, t), at
        if kind != "regression":
            assert got[at][4] == [c / n for c in s]
    assert sum(model.level_nodes) == len(want)


def test_same_forest_at_any_partitioning_and_bucketing(spark, monkeypatch):
    rows, got = rows_of(300, 3), []
    for parts, bucket in [(1, 50_000), (200, 50_000), (8, 40)]:
        monkeypatch.setattr(trees, "BUCKET_ROWS", bucket)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(min(parts, 32)))
        try:
            model = trees.fit(table(spark, rows).repartition(parts), X, ["id"], "classification", n_trees=2, max_features="sqrt", max_depth=3)
            got.append((found(model), sorted((r["id"], r["prediction"], list(r["probability"])) for r in model.transform(table(spark, rows)).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(g == got[0] for g in got[1:])


def test_shuffled_levels_give_the_same_tree(spark, monkeypatch):
    t = table(spark, rows_of(200, 2))
    one = trees.fit(t, X, ["id"], "classification", max_depth=2)
    want = found(one), sorted(one.transform(t).collect())
    monkeypatch.setattr(trees, "BROADCAST_BYTES", 0)
    two = trees.fit(t, X, ["id"], "classification", max_depth=2)
    assert (found(two), sorted(two.transform(t).collect())) == want


def test_full_tree_past_one_walk_predicts_its_rows(spark):
    # each split takes one value off an end, so the tree is deeper than one plan walks
    n = 11
    t = table(spark, [(i, float(i), 0.0, 0.0, float(i % 2)) for i in range(n)])
    model = trees.fit(t, X, ["id"], "classification")
    assert len(model.level_nodes) > trees.WALK_LEVELS
    out = model.transform(t)
    assert out.where("prediction <> label OR score <> label").count() == 0 and out.count() == n
    assert [(r["feature"], r["importance"]) for r in model.importances().orderBy("feature").collect()] == [("a", 1.0), ("b", 0.0), ("c", 0.0)]


def test_three_classes_have_probabilities(spark):
    t = table(spark, rows_of(300, 3))
    model = trees.fit(t, X, ["id"], "classification", n_trees=3, max_features=2, max_depth=3)
    out = model.transform(t)
    bad = (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p) - 1) > 1e-9) | (F.size("probability") != 3)
    assert out.where(bad).count() == 0 and out.count() == 300
    assert out.where("prediction = label").count() > 200


def test_bins_bound_the_grouped_table_and_keep_quality(spark):
    t = table(spark, rows_of(400, "regression"))
    model = trees.fit(t, X, ["id"], "regression", max_depth=3, max_bins=8)
    assert model.nodes.where("feature IS NOT NULL").count() > 2
    e = model.transform(t).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)).alias("e"), F.var_pop("label").alias("v")).first()
    assert e["e"] < 0.5 * e["v"]


def test_edges(spark):
    same = table(spark, [(i, 1.0, 2.0, 3.0, float(i % 2)) for i in range(6)])
    model = trees.fit(same, X, ["id"], "classification")
    assert found(model) == {(0, ""): (6, 6, None, None, [0.5, 0.5])}
    assert {r["prediction"] for r in model.transform(same).collect()} == {0.0}
    pure = table(spark, [(i, float(i), 0.0, 0.0, 2.5) for i in range(5)])
    assert {r["prediction"] for r in trees.fit(pure, X, ["id"], "regression").transform(pure).collect()} == {2.5}
    with pytest.raises(ValueError):
        trees.fit(same.limit(0), X, ["id"], "classification")
    with pytest.raises(ValueError):
        trees.fit(same.withColumn("label", F.lit(None).cast("double")), X, ["id"], "classification")
    with pytest.raises(Exception, match="null or NaN in b"):
        trees.fit(same.withColumn("b", F.when(F.col("id") != 3, 1.0)), X, ["id"], "classification").nodes.collect()
    extra = same.withColumn("node", F.lit("x")).withColumn("value", F.lit(1)).withColumn("x", F.lit(2))
    assert set(extra.columns) < set(model.transform(extra).columns)


def test_place_among_cuts_is_exact(spark):
    values = [float("-inf"), -2.5, -0.0, 0.0, 1.0, 1.5, 7.0, float("inf")]
    edges = [[float("-inf"), -2.5, -0.0, 1.0, 1.5, float("inf")], [], [0.0, 7.0]]
    t = spark.createDataFrame([(v, v, v) for v in values], "a double, b double, c double")
    for r in trees._bucketed(t, X, edges).collect():
        assert list(r["_b"]) == [sum(e < r["a"] for e in es) for es in edges], r


def test_deepest_level_is_counted_and_not_written(spark, monkeypatch):
    rows, paths, written = rows_of(200, 2), [], trees._written
    monkeypatch.setattr(trees, "_written", lambda df, path: (paths.append((path, df.columns)), written(df, path))[1])
    model = trees.fit(table(spark, rows), X, ["id"], "classification", max_depth=2)
    assert len(model.level_nodes) == 3
    levels = [p.split("/rows/")[1] for p, _ in paths if "/rows/" in p]
    assert levels == ["0-0", "0-1"]
    # the table is read once, into what all later passes read
    assert paths[0][0].endswith("/table")
    got = found(model)
    for node, v in plain(rows, 2, 0, 3, 2, False).items():
        assert got[0, node][:4] == v[:4]
