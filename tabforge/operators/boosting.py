"""Boosted trees of many candidates and folds, grown together (L3e within L4, L8-L11).

MLlib fits one boosted model at a time, with a Spark job or more for each level of each of its trees.  Here the models grow in step: one
job counts a level of the current trees of all models over all folds.  Every task sums its own rows per (model, node, feature, bin); sums
of a fold with several partitions meet by key, and only the best split of each node returns to the driver.  Between rounds the rows keep
their margins in persisted partitions, checkpointed every ``CHECKPOINT`` rounds, so a job's cost does not grow with the trees before it.

A model is the one ``GBTClassifier`` (two classes) or ``GBTRegressor`` fits to the same rows in the same partitions, up to the order of
sums: the same bins (at most 32 a feature, from at most about 10,000 rows), the same rows drawn in a round (``rand`` with the round's seed),
variance gain, the first of equal splits, leaves at the mean residual.

Null, NaN or infinite features, null labels and an empty training set are errors.  Constant features are never split; a round that draws
no row adds a tree that predicts 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import _remove

SEED = 42
MAX_BINS = 32
#: Rows that bins are taken from, about; MLlib's figure.
BIN_ROWS = 10_000
CHECKPOINT = 20
EPS = 2.0 ** -52


@dataclass(frozen=True)
class Spec:
    """What one model is grown by."""
    rounds: int
    depth: int
    step: float
    share: float

    @staticmethod
    def of(params: dict, rounds: int) -> Spec:
        return Spec(rounds, int(params.get("max_depth", 3)), float(params.get("learning_rate", 0.1)), float(params.get("subsample", 1.0)))


class Tree:
    """Nodes in arrays: the split feature (-1: leaf), its last bin to the left, the left child (the right one follows it), the value."""

    def __init__(self):
        self.feature, self.at, self.left, self.value = [-1], [0], [0], [0.0]
        self.active, self.sums = [0], [None]           # nodes still to be looked at, and what is known of their sums

    def grow(self, best: dict, last: bool) -> None:
        """Split the active nodes; ``last``: the children are leaves, whatever they hold."""
        active, self.active, self.sums = self.active, [], []
        for k, node in enumerate(active):
            if node == 0:
                self.value[0] = _mean(best["own"][k])
            if not best["gain"][k] > 0:
                continue
            self.feature[node], self.at[node], self.left[node] = int(best["feature"][k]), int(best["at"][k]), len(self.feature)
            for side in ("lo", "hi"):
                s = best[side][k]
                if not last and abs(_impurity(s)) >= EPS:
                    self.active.append(len(self.feature))
                    self.sums.append(s)
                for values, v in ((self.feature, -1), (self.at, 0), (self.left, 0), (self.value, _mean(s))):
                    values.append(v)

    def frozen(self) -> tuple:
        return (np.array(self.feature, np.int16), np.array(self.at, np.int16), np.array(self.left, np.int32), np.array(self.value))


def _mean(s) -> float:
    return float(s[1] / s[0]) if s[0] else 0.0


def _impurity(s):
    """Variance of sums (count, sum, sum of squares) along the last axis."""
    s = np.asarray(s)
    return (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0]


def _nodes(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node each row is in so far."""
    feature, at, left, _ = tree
    node, row = np.zeros(bins.shape[1], np.int32), np.arange(bins.shape[1])
    while True:
        f = feature[node]
        if (f < 0).all():
            return node
        node = np.where(f < 0, node, left[node] + (bins[f, row] > at[node]))


def _finite(name: str, what: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"null, NaN or infinity in {what}"))).otherwise(v)


def points(rows: DataFrame, features: list[str], label: str, *more: str) -> DataFrame:
    """The rows as numbers: x0, x1, ... and y, with the columns ``more``."""
    return rows.select(*more, *[_finite(f, f).alias(f"x{i}") for i, f in enumerate(features)], _finite(label, label).alias("y"))


def cuts(rows: DataFrame, n: int, n_features: int) -> list[np.ndarray]:
    """The upper ends of each feature's bins but the last, from a bounded sample of the rows."""
    share, spark = min(1.0, max(MAX_BINS ** 2, BIN_ROWS) / n), rows.sparkSession
    if share < 1.0:
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(SEED).nextInt()
        taken = rows._jdf.javaRDD().sample(False, share, seed)
        rows = DataFrame(spark._jsparkSession.createDataFrame(taken, rows._jdf.schema()), spark)
    table = rows.toArrow()                       # about BIN_ROWS rows
    return [_cuts_of(table.column(f"x{i}").to_numpy(), share * n, min(MAX_BINS, n) - 1) for i in range(n_features)]


def _cuts_of(values: np.ndarray, total: float, n_cuts: int) -> np.ndarray:
    """Midpoints of neighbouring values: all of them, or those next to multiples of the stride.  Zeros are what the sample lacks of the expected total."""
    values = values[values != 0.0]
    if not len(values):
        return np.empty(0)
    value, count = np.unique(values, return_counts=True)
    count = count.astype(np.float64)
    if total - len(values) > EPS * len(values) * 100:
        at = int(np.searchsorted(value, 0.0))
        value, count = np.insert(value, at, 0.0), np.insert(count, at, total - len(values))
    middle = (value[:-1] + value[1:]) / 2.0
    if len(middle) <= n_cuts:
        return middle
    stride = total / (n_cuts + 1)
    target, below, found = stride, np.cumsum(count), []
    for i in range(len(middle)):
        if abs(below[i] - target) < abs(below[i + 1] - target):
            found.append(middle[i])
            target += stride
    return np.array(found)


def _binned(table: pa.Table | pa.RecordBatch, ends: list[np.ndarray]) -> np.ndarray:
    return np.array([np.searchsorted(e, table.column(f"x{i}").to_numpy(), "left") for i, e in enumerate(ends)], np.uint8).reshape(len(ends), table.num_rows)


def _packed(fold: int, ends: list[np.ndarray], shares: list[float], rounds: int, signs: bool):
    """A partition's rows as arrays: fold, bins, label, the rows drawn in each round by share."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, ys, drawn = [], [], {s: [] for s in shares}
        for b in batches:
            bins.append(_binned(b, ends))
            ys.append(b.column("y").to_numpy())
            if shares:
                u = b.column("u").flatten().to_numpy().reshape(b.num_rows, rounds).T
                for s in shares:
                    drawn[s].append(u < s)
        if not bins:
            return
        y = np.concatenate(ys)
        y = 2.0 * y - 1.0 if signs else y
        bits = {s: np.packbits(np.concatenate(d, axis=1), axis=1) for s, d in drawn.items()}
        data = pickle.dumps((fold, np.concatenate(bins, axis=1), y, bits), protocol=5)
        yield pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})
    return of


def _unpacked(n_models: int):
    """The arrays and, of each model, the rows' margins."""
    def of(row) -> tuple:
        fold, bins, y, bits = pickle.loads(row["data"])
        return fold, bins, y, bits, np.zeros((n_models, len(y)))
    return of


def _residual(y: np.ndarray, margin: np.ndarray, signs: bool) -> np.ndarray:
    if not signs:
        return 2.0 * (y - margin)
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def _counted(specs: list[Spec], trees: dict, n_bins: int, round_: int, signs: bool):
    """Sums (node, feature, bin, [count, sum, sum of squares]) of every model's active nodes over one partition's rows."""
    def of(part) -> Iterator[tuple]:
        for fold, bins, y, bits, margins in part:
            for i, (tree, active) in trees[fold].items():
                share = specs[i].share
                take = slice(None) if share >= 1.0 else np.flatnonzero(np.unpackbits(bits[share][round_], count=len(y)))
                x = bins[:, take]
                r = y[take] if round_ == 0 else _residual(y[take], margins[i][take], signs)
                slot = np.full(len(tree[0]), -1, np.int64)
                slot[active] = np.arange(len(active))
                at = slot[_nodes(tree, x)]
                if len(tree[0]) > 1:
                    on = np.flatnonzero(at >= 0)
                    x, r, at = x[:, on], r[on], at[on]
                at, squared, size = at * n_bins, r * r, len(active) * n_bins
                sums = np.empty((len(bins), size, 3))
                for f in range(len(bins)):
                    cell = at + x[f]
                    for j, w in enumerate((None, r, squared)):
                        sums[f, :, j] = np.bincount(cell, w, size)
                yield (fold, i), sums.reshape(len(bins), len(active), n_bins, 3).transpose(1, 0, 2, 3)
    return of


def _best(known: dict, ends: dict):
    """The best split of each node: the first of the largest gain, by feature and then by bin."""
    def of(item: tuple) -> tuple:
        (fold, i), sums = item
        n_cuts = np.array([len(e) for e in ends[fold]])
        upto = np.cumsum(sums, axis=2)
        lo, total = upto[:, :, :-1], upto[:, :, -1:]
        hi = total - lo
        first = int(np.argmax(n_cuts > 0))
        own = np.array([(lo[k, first, 0] + hi[k, first, 0] if n_cuts[first] else total[k, 0, 0]) if s is None else s for k, s in enumerate(known[fold, i])])
        with np.errstate(invalid="ignore", divide="ignore"):
            n = lo[..., 0] + hi[..., 0]
            gain = _impurity(own)[:, None, None] - lo[..., 0] / n * _impurity(lo) - hi[..., 0] / n * _impurity(hi)
            valid = (lo[..., 0] >= 1) & (hi[..., 0] >= 1) & (np.arange(lo.shape[2]) < n_cuts[:, None]) & (gain >= 0)
        gain = np.where(valid, gain, -np.inf).reshape(len(own), -1)
        if not gain.shape[1]:
            return (fold, i), {"own": own, "gain": np.zeros(len(own))}
        best, node = gain.argmax(axis=1), np.arange(len(own))
        f, b = np.divmod(best, lo.shape[2])
        return (fold, i), {"own": own, "gain": gain[node, best], "feature": f, "at": b, "lo": lo[node, f, b], "hi": hi[node, f, b]}
    return of


def _moved(specs: list[Spec], trees: dict, round_: int):
    """The rows with the round's trees added to their margins."""
    def of(part) -> Iterator[tuple]:
        for fold, bins, y, bits, margins in part:
            margins = margins.copy()
            for i, tree in trees[fold].items():
                margins[i] += tree[3][_nodes(tree, bins)] * (specs[i].step if round_ else 1.0)
            yield fold, bins, y, bits, margins
    return of


def fit(train: dict[int, DataFrame], n_train: dict[int, int], ends: dict[int, list[np.ndarray]], problem_type: str, specs: list[Spec]) -> dict[tuple[int, int], list[tuple]]:
    """The trees of every (fold, number of the model); ``train`` holds ``points``, persisted, so that their order stands."""
    spark = next(iter(train.values())).sparkSession
    sc, signs, rounds = spark.sparkContext, problem_type == "classification", max(s.rounds for s in specs)
    if not all(n_train.values()):
        raise ValueError("no rows to boost on")
    shares = sorted({s.share for s in specs if s.share < 1.0})
    packed = []
    for f, rows in train.items():
        if shares:
            rows = rows.withColumn("u", F.array(*[F.rand(SEED + m + 1) for m in range(rounds)]))
        packed.append(rows.mapInArrow(_packed(f, ends[f], shares, rounds, signs), "data binary").rdd)
    merge = any(p.getNumPartitions() > 1 for p in packed)
    state = sc.union(packed).map(_unpacked(len(specs))).persist(StorageLevel.MEMORY_AND_DISK)
    n_bins = 1 + max((len(e) for es in ends.values() for e in es), default=0)
    models = {(f, i): [] for f in train for i in range(len(specs))}
    before, saved = None, None
    try:
        for m in range(rounds):
            growing = {(f, i): Tree() for f in train for i, s in enumerate(specs) if m < s.rounds}
            if m and m % CHECKPOINT == 0:
                state.checkpoint()
            depth = 0
            while True:
                live = {fi: t for fi, t in growing.items() if t.active and depth < specs[fi[1]].depth}
                if not live:
                    break
                now = {f: {i: (t.frozen(), t.active) for (g, i), t in live.items() if g == f} for f in train}
                sums = state.mapPartitions(_counted(specs, now, n_bins, m, signs))
                if merge:
                    sums = sums.reduceByKey(np.add, min(len(live), sc.defaultParallelism))
                for fi, best in sums.map(_best({fi: t.sums for fi, t in live.items()}, ends)).collect():
                    growing[fi].grow(best, depth + 1 == specs[fi[1]].depth)
                depth += 1
                if before is not None:           # the first job of a round has made its margins
                    before.unpersist()
                    before = None
            if m and m % CHECKPOINT == 0:
                if saved:
                    _remove(spark, saved)
                saved = state.getCheckpointFile()
            done = {fi: t.frozen() for fi, t in growing.items()}
            for fi, tree in done.items():
                models[fi].append(tree)
            if m + 1 < rounds:
                going = {f: {i: t for (g, i), t in done.items() if g == f and m + 1 < specs[i].rounds} for f in train}
                before, state = state, state.mapPartitions(_moved(specs, going, m)).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        state.unpersist()
        if before is not None:
            before.unpersist()
        if saved:
            _remove(spark, saved)
    return models


def predictions(rows: DataFrame, label: str, ends: dict[int, list[np.ndarray]], problem_type: str, models: dict[int, dict[int, tuple[float, list[tuple], int]]]) -> DataFrame:
    """candidate, fold, label, prediction.  ``rows``: fold and ``points``; ``models``: by fold and candidate the step, trees and how many of them count."""
    sent = rows.sparkSession.sparkContext.broadcast(models)   # nodes of all trees, which the driver has grown

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds = b.column("fold").to_numpy()
            for f in np.unique(folds):
                mine = b.filter(pa.array(folds == f))
                bins = _binned(mine, ends[f])
                margins = {}
                for candidate, (step, trees, n) in sent.value[f].items():
                    # candidates that differ in rounds only share their trees
                    upto, margin = margins.get(id(trees), (0, np.zeros(mine.num_rows)))
                    if upto > n:
                        upto, margin = 0, np.zeros(mine.num_rows)
                    for k in range(upto, n):
                        margin = margin + trees[k][3][_nodes(trees[k], bins)] * (step if k else 1.0)
                    margins[id(trees)] = n, margin
                    p = (margin > 0).astype(np.float64) if problem_type == "classification" else margin
                    yield pa.RecordBatch.from_pydict({"candidate": pa.array([candidate] * len(p), pa.int32()), "fold": mine.column("fold"),
                                                      label: mine.column("y"), "prediction": pa.array(p)})

    return rows.mapInArrow(of, f"candidate int, fold int, `{label}` double, prediction double")
