"""Decision trees and random forests grown level by level (L3c, L3d, I1, I2).

A level of all trees is a grouped table: the rows of the nodes that may still be split are counted per (tree, node, feature, value)
with map-side combine, running sums over a feature's values give both sides of every split, and the best split of a node is a
maximum over its candidates.  Rows then carry their new node.  Rows, splits and nodes are written under ``spark.checkpoint.dir``
level by level, so a lost executor costs one level at most and plans stay short.  The training rows are read once, into a table of
keys, labels and features; the deepest level a ``max_depth`` allows is only counted, its rows are not written.

* Depth has no ceiling: a node's id is its path from the root (``0`` left, ``1`` right).
* Every midpoint between neighbouring values of a node is tried.  ``max_bins`` groups a feature's values by exact quantiles first;
  the grouped table then holds at most nodes x features x bins rows whatever the table's size.
* Bootstrap weights are Poisson(1) draws from md5 of (row key, tree), a node's features are drawn from md5 of (tree, node,
  feature) among those that vary in it, counts and label sums are exact integers, and ties go to the first feature, then the
  smallest threshold: the forest does not depend on partitions, task order or the number of executors.
* Regression labels are taken on a grid of 2^-30 of their range, so that their sums are exact.

Splits are broadcast only where their counted bytes are under ``BROADCAST_BYTES``; larger levels are shuffled to the rows, where
adaptive execution splits a node that holds many of them.

Edge cases: a null or NaN feature, label or key is an error, and so is an empty table; equal rows with different labels end in one leaf;
repeated keys draw the same weights; a forest's predictions need the key to be unique.  A tree that drew no row is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import SEED, hash_hex, hash_unit
from ..session import scratch_path
from . import ranks

GRID = 1 << 30
#: Largest splits or leaves, in bytes, that are sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Bytes of a partition of rows, at every size.
PARTITION_BYTES = 32 << 20
#: Values of a feature that one window task sorts, about.
BUCKET_ROWS = 50_000
#: Trees whose rows are held in the scratch tables at a time.
TREES_AT_ONCE = 16
#: Levels walked by one plan when predicting.
WALK_LEVELS = 8
AT = ["tree", "node"]
SPLIT = ["feature", "threshold", "score"]


def poisson_steps() -> list[float]:
    """P(X <= k) of Poisson(1) for k = 0, 1, ... until nothing of 32 bits is left above."""
    steps, term, total = [], math.exp(-1.0), 0.0
    while not steps or 1.0 - total > 2.0 ** -32:
        total += term
        steps.append(total)
        term /= len(steps)
    return steps


def bootstrap_weight(key: list[str], seed: int = SEED) -> Column:
    """How often the row is in its ``tree``'s sample."""
    u = hash_unit(hash_hex([*key, "tree"], seed, "bootstrap"))
    return sum((F.when(u >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0)).cast("long")


@dataclass(frozen=True)
class _Impurity:
    """Sums a node keeps and the score (larger is purer) of a set of rows that has them."""
    criterion: str                     # "gini" | "entropy" | "squared_error"
    n_classes: int = 0

    @property
    def names(self) -> list[str]:
        return [f"s{c}" for c in range(self.n_classes)] if self.n_classes else ["s0", "s1"]

    def sums(self) -> list[Column]:
        if self.n_classes:
            return [F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0)).alias(f"s{c}") for c in range(self.n_classes)]
        w, y = F.col("w").cast("decimal(9,0)"), F.col("y").cast("decimal(12,0)")
        return [F.sum("w").alias("s0"), F.sum(w * y).cast("decimal(38,0)").alias("s1")]

    def weight(self, s: list[Column]) -> Column:
        return s[0] if not self.n_classes else sum(s[1:], s[0])

    def score(self, s: list[Column]) -> Column:
        n, d = self.weight(s).cast("double"), [c.cast("double") for c in s]
        if not self.n_classes:
            return d[1] * d[1] / n
        if self.criterion == "entropy":
            parts = [F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in d]
            return sum(parts[1:], parts[0]) - n * F.log(n)
        parts = [c * c for c in d]
        return sum(parts[1:], parts[0]) / n


def _named(names: list[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in names]


def _small(n_rows: int, row_bytes: int) -> bool:
    return n_rows * row_bytes <= BROADCAST_BYTES


def _part(c: int):
    return lambda v: v["value"][c]


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@dataclass
class LevelForest:
    """Nodes (tree, node, n, n_rows, feature, threshold, gain, value) of all trees; leaves have no feature.

    ``n`` counts rows with their weight, ``n_rows`` without; ``value`` holds class shares or the mean label.
    """
    features: list[str]
    problem_type: str
    key: list[str]
    n_trees: int
    nodes: DataFrame
    level_nodes: list[int] = field(default_factory=list)     # nodes per depth
    n_classes: int = 0

    def importances(self) -> DataFrame:
        """feature, importance: impurity taken away by a feature's splits, as a share of its tree's, averaged over trees that split."""
        per = (self.nodes.where("feature IS NOT NULL").groupBy("tree", "feature")
               .agg(F.aggregate(F.array_sort(F.collect_list(F.struct("node", "gain"))), F.lit(0.0), lambda a, g: a + g["gain"]).alias("gain")))
        share = F.try_divide(F.col("gain"), F.sum("gain").over(Window.partitionBy("tree")))
        trees = per.select("tree").distinct().count()
        names = F.array(*[F.lit(f) for f in self.features])
        mean = per.withColumn("share", share).groupBy("feature").agg((F.sum("share") / F.lit(float(max(trees, 1)))).alias("importance"))
        every = self.nodes.sparkSession.range(len(self.features)).select(F.col("id").cast("int").alias("feature"))
        return every.join(mean, "feature", "left").select(F.element_at(names, F.col("feature") + 1).alias("feature"),
                                                          F.coalesce("importance", F.lit(0.0)).alias("importance"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction``, and for classes ``probability`` and ``score`` (two classes), beside the columns of ``df``."""
        spark = df.sparkSession
        present = [r["tree"] for r in self.nodes.select("tree").distinct().collect()]     # one number a tree
        x = F.array(*[_checked(f) for f in self.features])
        rows = df.select(F.struct(*df.columns).alias("_row"), x.alias("x"), F.explode(F.array(*[F.lit(t) for t in sorted(present)])).alias("tree"),
                         F.lit("").alias("node"))
        for depth, n in enumerate(self.level_nodes[:-1]):
            at = self.nodes.where((F.length("node") == depth) & F.col("feature").isNotNull()).select(*AT, "feature", "threshold")
            at = F.broadcast(at) if _small(n, 64 + depth) else at
            side = F.when(F.element_at("x", F.col("feature") + 1) <= F.col("threshold"), "0").otherwise("1")
            rows = rows.join(at, AT, "left").select("_row", "x", "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.concat("node", side)).alias("node"))
            if (depth + 1) % WALK_LEVELS == 0 and depth + 2 < len(self.level_nodes):
                rows = _written(rows, scratch_path(spark, "walk"))
        leaves = self.nodes.where("feature IS NULL").select(*AT, "value")
        width = 64 + len(self.level_nodes) + 8 * max(self.n_classes, 1)
        rows = rows.join(F.broadcast(leaves) if _small(sum(self.level_nodes), width) else leaves, AT)
        if len(present) > 1:
            keys = [F.col(f"_row.{k}").alias(f"_k{i}") for i, k in enumerate(self.key)]
            rows = rows.groupBy(*keys).agg(F.any_value("_row").alias("_row"), F.array_sort(F.collect_list(F.struct("tree", "value"))).alias("_v"))
            mean = [F.aggregate(F.transform("_v", _part(c)), F.lit(0.0), lambda a, v: a + v) / len(present) for c in range(max(self.n_classes, 1))]
            rows = rows.select("_row", F.array(*mean).alias("value"))
        out = rows.select("_row.*", F.col("value").alias("_value"))
        if self.problem_type != "classification":
            return out.withColumn("prediction", F.col("_value")[0]).drop("_value")
        out = out.withColumn("prediction", (F.array_position("_value", F.array_max("_value")) - 1).cast("double"))
        score = F.col("_value")[1] if self.n_classes == 2 else F.lit(None).cast("double")
        return out.withColumn("score", score).withColumnRenamed("_value", "probability")


def _checked(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"null or NaN in {name}"))).otherwise(v)


def fit(train: DataFrame, features: list[str], key: list[str], problem_type: str, label: str = "label", *, n_trees: int = 1, bootstrap: bool | None = None,
        max_features: str | int | None = None, max_depth: int | None = None, min_samples_split: int = 2, criterion: str = "gini",
        max_bins: int | None = None, n_classes: int | None = None, seed: int = SEED) -> LevelForest:
    """Grow ``n_trees`` trees on ``train``; ``bootstrap`` is on for more than one tree unless said otherwise.

    ``max_features``: a number, "sqrt", or None for all.  Labels of classes are 0, 1, ... as numbers.
    """
    spark, base = train.sparkSession, scratch_path(train.sparkSession, "trees")
    cls = problem_type == "classification"
    names = [f"_x{i}" for i in range(len(features))]
    table = _written(train.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(label).cast("double").alias("y"),
                                  *[_checked(f).alias(x) for f, x in zip(features, names)]), f"{base}/table")
    a = table.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.isnan("y"), None).otherwise(F.col("y"))).alias("labelled"), F.min("y").alias("lo"),
                  F.max("y").alias("hi"), *[F.count(f"k{i}").alias(f"k{i}") for i in range(len(key))]).first()
    if not a["n"]:
        raise ValueError("no rows to grow a tree on")
    if a["labelled"] < a["n"] or any(a[f"k{i}"] < a["n"] for i in range(len(key))):
        raise ValueError("null label or key")
    lo, span = a["lo"], a["hi"] - a["lo"]
    imp = _Impurity(criterion, max(n_classes or 0, int(a["hi"]) + 1)) if cls else _Impurity("squared_error")
    y = F.col("y").cast("int") if cls else F.round((F.col("y") - lo) / (span or 1.0) * GRID).cast("long")
    m = max(1, int(math.sqrt(len(features)))) if max_features == "sqrt" else int(max_features or len(features))
    edges = _edges(table, names, a["n"], max_bins)
    grow = _Grower(spark, base, len(features), imp, m, max_depth, min_samples_split, seed, max_bins, any(edges))
    bootstrap = n_trees > 1 if bootstrap is None else bootstrap
    placed = table.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], y.alias("_y"), *names)
    placed = _bucketed(placed, names, edges).select(*key, F.col("_y").alias("y"), F.array(*names).alias("x"), "_b")
    n_levels: list[int] = []
    for first in range(0, n_trees, TREES_AT_ONCE):
        trees = F.array(*[F.lit(t) for t in range(first, min(first + TREES_AT_ONCE, n_trees))])
        rows = placed.withColumn("tree", F.explode(trees))
        rows = rows.coalesce(max(1, math.ceil(a["n"] * min(n_trees, TREES_AT_ONCE) * (len(features) + 4) * 8 / PARTITION_BYTES)))
        rows = rows.withColumn("w", bootstrap_weight(key, seed) if bootstrap else F.lit(1).cast("long")).where("w > 0")
        for depth, n in enumerate(grow.run(rows.select("tree", F.lit("").alias("node"), "w", "y", "x", "_b"), first)):
            n_levels[depth:depth + 1] = [(n_levels[depth] if depth < len(n_levels) else 0) + n]
    nodes = _written(grow.nodes(), f"{base}/nodes")
    s = _named(imp.names)
    n = imp.weight(s)
    value = F.array(*[c.cast("double") / n.cast("double") for c in s]) if cls else F.array(s[1].cast("double") / s[0].cast("double") / GRID * span + lo)
    nodes = nodes.select(*AT, n.alias("n"), "n_rows", "feature", "threshold", (F.col("score") - imp.score(s)).alias("gain"), value.alias("value"))
    return LevelForest(list(features), problem_type, list(key), n_trees, nodes, n_levels, imp.n_classes if cls else 0)


def _edges(train: DataFrame, features: list[str], n: int, max_bins: int | None) -> list[list[float]]:
    """Cuts of each feature.  Without ``max_bins`` they only say which task sorts a value, so a sketch does."""
    if max_bins:
        q = ranks.quantiles(train, features, [i / max_bins for i in range(1, max_bins)])
        return [sorted(set(q[f] or [])) for f in features]
    parts = math.ceil(n / BUCKET_ROWS)
    if parts == 1:
        return [[] for _ in features]
    parts = min(parts, 1000)
    found = train.approxQuantile(list(features), [i / parts for i in range(1, parts)], 0.25 / parts)
    return [sorted(set(q)) for q in found]


def _bucketed(df: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """Adds ``_b``: of each feature, how many of its cuts lie below the value.  A binary search a value, whatever the number of cuts."""
    finite = [[e for e in es if not math.isinf(e)] for es in edges]
    cut = [i for i, es in enumerate(finite) if es]
    if cut:
        # buckets hold their lower end, so the turned value's bucket counts the cuts at or above the value; 0.0 - 0.0 has no sign
        df = df.withColumns({f"_t{i}": F.lit(0.0) - F.col(features[i]) for i in cut})
        df = Bucketizer(splitsArray=[[-math.inf, *sorted(0.0 - e for e in finite[i]), math.inf] for i in cut], inputCols=[f"_t{i}" for i in cut],
                        outputCols=[f"_b{i}" for i in cut]).transform(df)
    below = [F.lit(len(finite[i])) - F.col(f"_b{i}").cast("int") if i in cut else F.lit(0) for i in range(len(features))]
    lowest = [F.when(F.col(f) > -math.inf, 1).otherwise(0) if -math.inf in es else F.lit(0) for f, es in zip(features, edges)]
    return df.withColumn("_b", F.array(*[(n + o).cast("int") for n, o in zip(below, lowest)]))


@dataclass
class _Grower:
    spark: SparkSession
    base: str
    n_features: int
    imp: _Impurity
    m: int
    max_depth: int | None
    min_samples_split: int
    seed: int
    max_bins: int | None
    cut: bool                          # whether a feature's values lie in more than one bucket
    stats_schema: object = None
    split_once: bool = False

    def run(self, rows: DataFrame, batch: int) -> list[int]:
        """Write the batch's nodes; the number of them per depth."""
        counts: list[int] = []
        keep = [*AT, "n_rows", *self.imp.names]
        path = f"{self.base}/rows/{batch}-0"
        if self.max_depth is None or self.max_depth > 0:
            rows = _written(rows, path)
        while True:
            depth = len(counts)
            at = f"{batch}-{depth}"
            stats = _written(self.stats(rows), f"{self.base}/stats/{at}")
            seen = stats.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(self.may_split(), 1)).alias("active")).first()
            counts.append(seen["n"])
            self.stats_schema = stats.select(*keep).schema
            if not seen["active"] or (self.max_depth is not None and depth >= self.max_depth):
                _remove(self.spark, path)
                return counts
            splits = _written(self.splits(rows, stats.where(self.may_split()), seen["active"], depth), f"{self.base}/splits/{at}")
            side = F.when(F.element_at("x", F.col("feature") + 1) <= F.col("threshold"), "0").otherwise("1")
            self.split_once = True
            where = F.broadcast(splits) if _small(seen["active"], 64 + depth) else splits
            rows = rows.join(where, AT).select("tree", F.concat("node", side).alias("node"), "w", "y", "x", "_b")
            if depth + 1 == self.max_depth:
                continue                   # no split below: these rows are read once, for their nodes' sums
            after = f"{self.base}/rows/{batch}-{depth + 1}"
            rows = _written(rows, after)
            _remove(self.spark, path)
            path = after

    def nodes(self) -> DataFrame:
        """The nodes of all levels with their splits."""
        # folder names above the part-files add no column
        read = self.spark.read.option("recursiveFileLookup", "true")
        stats = read.schema(self.stats_schema).parquet(f"{self.base}/stats")
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(SPLIT, ["int", "double", "double"])]
        if not self.split_once:
            return stats.select("*", *none)
        splits = read.schema("tree int, node string, feature int, threshold double, score double").parquet(f"{self.base}/splits")
        return stats.join(splits, AT, "left")

    def stats(self, rows: DataFrame) -> DataFrame:
        """One row a node: its sums, and the features that vary in it."""
        ends = []
        for i in range(self.n_features):
            v = F.element_at("x", i + 1)
            ends += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        g = rows.groupBy(*AT).agg(F.count(F.lit(1)).alias("n_rows"), *self.imp.sums(), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"), *ends)
        vary = F.array_compact(F.array(*[F.when(F.col(f"lo{i}") < F.col(f"hi{i}"), F.lit(i)) for i in range(self.n_features)]))
        return g.select(*AT, "n_rows", *self.imp.names, "y_lo", "y_hi", vary.alias("vary"))

    def may_split(self) -> Column:
        return (F.col("y_lo") < F.col("y_hi")) & (F.size("vary") > 0) & (F.col("n_rows") >= self.min_samples_split)

    def drawn(self) -> Column:
        """The features a node looks at."""
        if self.m >= self.n_features:
            return F.col("vary")
        order = F.array_sort(F.transform("vary", lambda f: F.struct(hash_hex([*AT, f], self.seed, "features").alias("h"), f.alias("f"))))
        return F.transform(F.slice(order, 1, self.m), lambda o: o["f"])

    def splits(self, rows: DataFrame, active: DataFrame, n_nodes: int, depth: int) -> DataFrame:
        """The best split of every active node: feature, threshold, score."""
        s, totals = self.imp.names, [f"t{i}" for i in range(len(self.imp.names))]
        small = _small(n_nodes, 64 + depth + 4 * self.m + 16 * len(s))
        nodes = active.select(*AT, self.drawn().alias("drawn"))
        sums = active.select(*AT, *[F.col(c).alias(t) for c, t in zip(s, totals)])
        nodes, sums = (F.broadcast(nodes), F.broadcast(sums)) if small else (nodes, sums)
        long = rows.join(nodes, AT).select(*AT, "w", "y", "x", "_b", F.explode("drawn").alias("feature"))
        at = F.col("feature") + 1
        long = long.select(*AT, "w", "y", "feature", F.element_at("x", at).alias("v"), F.element_at("_b", at).alias("b"))
        cut, by = self.cut, [*AT, "feature", "b"]
        if self.max_bins:
            h = long.groupBy(*by).agg(*self.imp.sums(), F.min("v").alias("lo"), F.max("v").alias("hi"))
            cut = False
        else:
            h = long.groupBy(*by, "v").agg(*self.imp.sums()).withColumns({"lo": F.col("v"), "hi": F.col("v")})
        group = [*AT, "feature"]
        w = Window.partitionBy(*group, *(["b"] if cut else [])).orderBy("lo")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = h.select(*by, "hi", *[F.sum(c).over(upto).alias(c) for c in s], F.lead("lo").over(w).alias("next"))
        if cut:
            # what lies in the buckets before, and the first value of the one after
            of = h.groupBy(*group, "b").agg(*[F.sum(c).alias(c) for c in s], F.min("lo").alias("lo"))
            ob = Window.partitionBy(*group).orderBy("b")
            before = ob.rowsBetween(Window.unboundedPreceding, -1)
            of = of.select(*group, "b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o_{c}") for c in s], F.lead("lo").over(ob).alias("after"))
            left = left.join(of, [*group, "b"]).select(*AT, "feature", "hi", F.coalesce("next", "after").alias("next"),
                                                       *[(F.col(c) + F.col(f"o_{c}")).alias(c) for c in s])
        mid = F.col("hi") / 2 + F.col("next") / 2
        threshold = F.when(mid < F.col("next"), mid).otherwise(F.col("hi"))
        right = [F.col(t) - F.col(c) for c, t in zip(s, totals)]
        score = self.imp.score(_named(s)) + self.imp.score(right)
        best = (left.where("next IS NOT NULL").join(sums, AT).select(*AT, score.alias("score"), (-F.col("feature")).alias("f"), (-threshold).alias("th"))
                .groupBy(*AT).agg(F.max(F.struct("score", "f", "th")).alias("best")))
        return best.select(*AT, (-F.col("best.f")).alias("feature"), (-F.col("best.th")).alias("threshold"), F.col("best.score").alias("score"))
