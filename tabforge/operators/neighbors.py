"""Exact k-nearest-neighbour join (J4) and the KNN learner (L3h).

Points are placed in cells of about equal numbers of points along one unit
direction u that mixes all coordinates; |u.(x - y)| <= ||x - y|| bounds the
search.  Pairs of points are never rows: blocks of query points meet blocks
of reference points in a cogroup, distances are computed in strips of bounded
size and only the nearest points of each block leave it.

1. Radius: each query meets a block of its own cell.  The distance R_q of the
   (k+1)-th nearest point there is an upper bound of the true one.
2. Exact pass: the query meets every block of the cells that touch
   [p_q - R_q, p_q + R_q] and the nearest points of all blocks are merged by
   (distance, reference key).

Where the direction cannot tell points apart (many dimensions) all blocks of
a group meet: the work is then all pairs, memory stays that of two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Reference points of a cell and of a block, query points of a block.
CELL_POINTS, REF_BLOCK, QUERY_BLOCK = 4096, 8192, 4096
#: Cells of one group at most; beyond it cells grow, and are cut into more blocks.
MAX_CELLS = 4000
#: Distances held at once by a task.
STRIP = 1 << 21
TILE = 1 << 17
#: Tasks of one pass at most.
MAX_TASKS = 4000


def _projection(ref: DataFrame) -> list[float]:
    """A unit direction mixing every coordinate of ``_v``, weighted by its spread.

    Weights are sd_j * (1 + jitter_j) with a fixed hash-derived jitter, so
    distinct discrete points (one-hot or binary features) rarely share a
    projection value and cells stay small.  For a unit u,
    |u.(x - y)| <= ||x - y||_2 <= ||x - y||_1, which keeps the band exact.
    """
    import hashlib
    rows = (ref.select(F.posexplode("_v").alias("pos", "x")).groupBy("pos")
               .agg(F.stddev_pop(F.when(~F.isnan("x"), F.col("x"))).alias("s")).collect())       # one row per dimension
    sd = [0.0] * (max((r["pos"] for r in rows), default=-1) + 1)
    for r in rows:
        sd[r["pos"]] = float(r["s"] or 0.0)
    w = []
    for j, v in enumerate(sd):
        jit = int(hashlib.md5(f"{j}|proj".encode()).hexdigest()[:8], 16) / 4294967296.0
        w.append((v + 1e-12) * (1.0 + 0.5 * jit))
    norm = sum(x * x for x in w) ** 0.5 or 1.0
    return [x / norm for x in w]


def _cell_of(cuts: dict):
    """Column function: the cell of a projection value in its group."""
    @F.pandas_udf("int")
    def cell(g: pd.Series, p: pd.Series) -> pd.Series:
        gs, ps, out = g.to_numpy(), p.to_numpy(), np.zeros(len(g), np.int32)
        for i in np.unique(gs):
            at = gs == i
            out[at] = np.searchsorted(cuts[int(i)], ps[at], side="right")
        return pd.Series(out)
    return cell


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a block, one column per row (all of one length)."""
    v = table.column("_v").combine_chunks()
    return np.ascontiguousarray(np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1).T)


def _strips(q: np.ndarray, r: np.ndarray, metric: str):
    """Distances of some query columns to all reference columns at a time, summed feature by feature as Spark and SQL sum them."""
    step = max(1, STRIP // max(1, r.shape[1]))
    wide = max(1, TILE // step)
    for lo in range(0, q.shape[1], step):
        part = q[:, lo:lo + step]
        out = np.zeros((part.shape[1], r.shape[1]))
        for at in range(0, r.shape[1], wide):
            acc = out[:, at:at + wide]
            for x, y in zip(part, r[:, at:at + wide]):
                d = x[:, None] - y[None, :]
                if metric == "manhattan":
                    np.abs(d, out=d)
                else:
                    d *= d
                acc += d
        yield lo, out if metric == "manhattan" else np.sqrt(out, out=out)


def _kth(d: np.ndarray, n: int) -> np.ndarray:
    return np.partition(d, n - 1, axis=1)[:, n - 1] if d.shape[1] >= n else np.full(len(d), np.inf)


def _radius(n: int, metric: str):
    """Per query of a block the distance of its n-th nearest point in one reference block (infinite with fewer)."""
    def of(q: pa.Table, r: pa.Table) -> pa.Table:
        radius = np.full(q.num_rows, np.inf)
        if q.num_rows and r.num_rows:
            for lo, d in _strips(_matrix(q), _matrix(r), metric):
                radius[lo:lo + len(d)] = _kth(d, n)
        return pa.table({"_qid": q.column("_qid"), "_R": pa.array(radius)})
    return of


def _nearest(n: int, metric: str):
    """Per query of a block its n nearest points of one reference block, ties to the smaller first key."""
    def of(q: pa.Table, r: pa.Table) -> pa.Table:
        qi, ri, ds = [], [], []
        if q.num_rows and r.num_rows:
            first = r.column("_first").combine_chunks()
            keys = pa.table(first.flatten(), names=[f"k{i}" for i in range(first.type.num_fields)])
            r = r.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start"))
            most = q.column("_R").to_numpy()
            for lo, d in _strips(_matrix(q), _matrix(r), metric):
                a, b = np.nonzero(d <= np.minimum(_kth(d, n), most[lo:lo + len(d)])[:, None])
                x = d[a, b]
                order = np.lexsort((b, x, a))
                a, b, x = a[order], b[order], x[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < n
                qi.append(a[keep] + lo), ri.append(b[keep]), ds.append(x[keep])
        at = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"_qid": q.column("_qid").take(pa.array(at(qi))), "_pid": r.column("_pid").take(pa.array(at(ri))),
                         "dist": pa.array(at(ds).astype(np.float64))})
    return of


def knn(query: DataFrame, ref: DataFrame, features: list[str], k: int, qkey: list[str], rkey: list[str],
        group: str | None = None, exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """For every query row, its k nearest reference rows, ties broken by reference key.

    Returns (q_<qkey>..., [group], nn_rank, r_<rkey>..., dist).  ``group``
    restricts neighbours to the same group value (e.g. the class for SMOTE);
    ``exclude_self`` (query rows drawn from ``ref``) drops each row itself.
    Vectors that are null or hold a null or NaN take no part, nor does a null group.

    The search runs over distinct points: identical feature vectors collapse
    into one point with its k+1 smallest keys (a salted two-level window, so a
    point shared by a third of the rows never sits in one task).  The k+1
    nearest points by (distance, smallest key) hold the k nearest rows; rows
    are expanded again only for the final ranking.
    """
    spark = ref.sparkSession
    path = scratch_path(spark, "knn")
    vector = len(features) == 1 and ref.schema[features[0]].dataType.typeName() == "array"
    g = F.col(group) if group else F.lit(0)
    top = k + 1

    def vec(df: DataFrame) -> Column:
        if not vector:
            return F.array(*[F.col(f).cast("double") for f in features])
        x = F.col(features[0])
        return x if df.schema[features[0]].dataType.elementType.typeName() == "float" else x.cast("array<double>")

    def usable(df: DataFrame) -> DataFrame:
        return df.where(F.col("_g").isNotNull() & F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))

    R0 = usable(ref.select(g.alias("_g"), F.struct(*[F.col(c) for c in rkey]).alias("_rk"), vec(ref).alias("_v")))
    Q0 = usable(query.select(g.alias("_g"), F.struct(*[F.col(c) for c in qkey]).alias("_qk"), vec(query).alias("_v")))

    # distinct reference points: the k+1 smallest keys
    salts = int(min(4096, max(1, R0.count() // 200_000)))
    w1 = Window.partitionBy("_g", "_v", "_salt").orderBy("_rk")
    s1 = R0.withColumn("_salt", F.abs(F.xxhash64("_rk")) % salts).withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= top)
    RP = s1.groupBy("_g", "_v").agg(F.slice(F.array_sort(F.collect_list("_rk")), 1, top).alias("_keys"))
    # written once: ids stay what they are
    RP.withColumn("_pid", F.monotonically_increasing_id()).write.parquet(f"{path}/points")
    Q0.select("_g", "_v").distinct().withColumn("_qid", F.monotonically_increasing_id()).write.parquet(f"{path}/queries")
    RP, QP = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/queries")
    u = _projection(RP)
    proj = F.aggregate(F.zip_with("_v", F.slice(F.array(*[F.lit(x) for x in u]) if u else F.array(F.lit(0.0)), F.lit(1), F.greatest(F.size("_v"), F.lit(1))),
                                  lambda a, b: F.coalesce(a.cast("double") * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)

    # groups (classes or folds, and lengths of vectors: bounded) and the cuts between their cells
    sizes = RP.groupBy("_g", F.size("_v").alias("_len")).agg(F.count(F.lit(1)).alias("_n")).collect()
    gids = {(r["_g"], r["_len"]): i for i, r in enumerate(sizes)}
    named = spark.createDataFrame([(*key, i) for key, i in gids.items()], RP.select("_g", F.lit(0).alias("_len"), F.lit(0).alias("_gid")).schema)

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("_len", F.size("_v")).join(F.broadcast(named), ["_g", "_len"]).drop("_len")

    RP, QP = numbered(RP).withColumn("_p", proj), numbered(QP).withColumn("_p", proj)
    n_cells = min(MAX_CELLS, max((math.ceil(r["_n"] / CELL_POINTS) for r in sizes), default=1))
    cuts = {i: np.zeros(0) for i in gids.values()}
    if n_cells > 1:
        marks = F.percentile_approx("_p", F.array(*[F.lit(c / n_cells) for c in range(1, n_cells)]), F.lit(20 * n_cells))
        cells = {i: min(MAX_CELLS, math.ceil(r["_n"] / CELL_POINTS)) for i, r in enumerate(sizes)}
        for r in RP.groupBy("_gid").agg(marks.alias("c")).collect():
            own = cells[r["_gid"]]
            cuts[r["_gid"]] = np.unique([r["c"][round(j * n_cells / own) - 1] for j in range(1, own)])
    cell = _cell_of(cuts)
    RP, QP = RP.withColumn("_cell", cell("_gid", "_p")), QP.withColumn("_cell", cell("_gid", "_p"))

    def blocks(df: DataFrame, ident: str, size: int, out: str) -> tuple[DataFrame, DataFrame]:
        """Rows with the number of their block in their cell, and the blocks of each cell."""
        n = df.groupBy("_gid", "_cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))
        return df.join(n, ["_gid", "_cell"]).withColumn(out, F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int")).drop("_blocks"), n

    RB, r_blocks = blocks(RP.select("_pid", "_gid", "_cell", "_v", F.col("_keys")[0].alias("_first")), "_pid", REF_BLOCK, "_rb")
    QB, q_blocks = blocks(QP.select("_qid", "_gid", "_cell", "_v", "_p"), "_qid", QUERY_BLOCK, "_qb")
    RB.write.parquet(f"{path}/ref-blocks")
    QB.write.parquet(f"{path}/query-blocks")
    RB, QB = spark.read.parquet(f"{path}/ref-blocks"), spark.read.parquet(f"{path}/query-blocks")

    # 1. an upper bound of the distance of the k+1-th nearest point, from a block of the query's own cell
    if n_cells > 1:
        own = RB.where(F.col("_rb") == 0).join(q_blocks, ["_gid", "_cell"]).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        by, n = ["_gid", "_cell", "_qb"], min(MAX_TASKS, max(1, len(gids) * n_cells))
        (QB.repartition(n, *by).groupBy(*by).cogroup(own.drop("_blocks").repartition(n, *by).groupBy(*by))
         .applyInArrow(_radius(top, metric), "_qid bigint, _R double").write.parquet(f"{path}/radius"))
        QB = QB.join(spark.read.parquet(f"{path}/radius"), "_qid")
    else:
        QB = QB.withColumn("_R", F.lit(float("inf")))

    # 2. exact pass over the cells that meet [p - R, p + R]; a margin covers the rounding of p
    reach = F.col("_R") + (F.abs("_p") + F.col("_R")) * 1e-9
    units = (QB.withColumnRenamed("_cell", "_qc").withColumn("_lo", cell("_gid", F.col("_p") - reach)).withColumn("_hi", cell("_gid", F.col("_p") + reach))
             .withColumn("_cell", F.explode(F.sequence("_lo", "_hi"))).join(r_blocks, ["_gid", "_cell"])
             .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("_qid", "_v", "_R", "_gid", "_qc", "_qb", "_cell", "_rb"))
    by = ["_gid", "_qc", "_qb", "_cell", "_rb"]
    met = units.select(*by).distinct()
    met.write.parquet(f"{path}/units")
    met = spark.read.parquet(f"{path}/units")
    n = min(MAX_TASKS, max(1, met.count()))
    refs = RB.join(met, ["_gid", "_cell", "_rb"])
    cand = (units.repartition(n, *by).groupBy(*by).cogroup(refs.select(*by, "_pid", "_v", "_first").repartition(n, *by).groupBy(*by))
            .applyInArrow(_nearest(top, metric), "_qid bigint, _pid bigint, dist double"))

    # rows of the k+1 nearest points
    wp = Window.partitionBy("_qid").orderBy("dist", F.col("_keys")[0])
    found = (cand.join(RP.select("_pid", "_keys"), "_pid").withColumn("_rn", F.row_number().over(wp)).where(F.col("_rn") <= top)
             .select("_qid", "dist", F.explode("_keys").alias("_rk")))
    if not exclude_self:
        found = found.withColumn("_rn", F.row_number().over(Window.partitionBy("_qid").orderBy("dist", "_rk"))).where(F.col("_rn") <= k).drop("_rn")
    rows = Q0.join(QP.select(F.col("_g"), "_v", "_qid"), ["_g", "_v"]).join(found, "_qid")
    if exclude_self:
        rows = rows.where(F.to_json("_qk") != F.to_json("_rk"))
    wr = Window.partitionBy("_qk").orderBy("dist", "_rk")
    topk = rows.withColumn("nn_rank", F.row_number().over(wr)).where(F.col("nn_rank") <= k)
    return topk.select(*[F.col("_qk")[c].alias("q_" + c) for c in qkey],
                       *([F.col("_g").alias(group)] if group else []),
                       F.col("nn_rank").cast("int"),
                       *[F.col("_rk")[c].alias("r_" + c) for c in rkey], "dist")


# ---- KNN learner (L3h) -----------------------------------------------------------
def knn_fit(train: DataFrame, features, label, problem_type, params, n_classes):
    from .learners import Fitted
    key = params.get("key")
    if not key:
        raise ValueError("KNN needs the row key columns in params['key']")
    p = {"k": int(params.get("n_neighbors", 5)), "weights": params.get("weights", "uniform"),
         "metric": params.get("metric", "euclidean"), "key": list(key), "label": label}
    m = Fitted("KNN", problem_type, list(features), "knn", params=p, n_classes=n_classes)
    m.model = train.select(*key, *[f for f in features if f not in key], F.col(label).alias("_y"))
    return m


def knn_predict(df: DataFrame, m) -> DataFrame:
    """Vote (classification) or mean (regression) over the k nearest training rows."""
    p = m.params
    key, k = p["key"], p["k"]
    qkey = key + [c for c in ("_f", "_r", "_s") if c in df.columns]
    ref = m.model
    nn = knn(df, ref, m.features, k, qkey, key, metric=p["metric"])
    lab = ref.select(*[F.col(c).alias("r_" + c) for c in key], "_y")
    nn = nn.join(lab, ["r_" + c for c in key])
    wgt = (F.lit(1.0) if p["weights"] == "uniform"
           else F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("dist")))
    nn = nn.withColumn("_wt", wgt)
    qk = ["q_" + c for c in qkey]
    if m.problem_type == "classification":
        votes = nn.groupBy(*qk).agg(*[F.sum(F.when(F.col("_y") == j, F.col("_wt")).otherwise(0.0)).alias(f"v{j}")
                                      for j in range(m.n_classes)], F.sum("_wt").alias("_tw"))
        arr = F.array(*[F.col(f"v{j}") for j in range(m.n_classes)])
        votes = votes.withColumn("_v", arr)
        pred = (F.array_position(F.col("_v"), F.array_max("_v")) - 1).cast("double")
        votes = votes.select(*qk, pred.alias("prediction"),
                             F.transform("_v", lambda x: x / F.col("_tw")).alias("probability"))
    else:
        votes = nn.groupBy(*qk).agg((F.sum(F.col("_y") * F.col("_wt")) / F.sum("_wt")).alias("prediction"))
    out = df.join(votes.select(*[F.col("q_" + c).alias(c) for c in qkey], *[c for c in votes.columns
                                                                              if not c.startswith("q_")]), qkey, "left")
    if m.problem_type == "classification":
        from .learners import _finish_cls
        out = _finish_cls(out, m.n_classes)
    return out
