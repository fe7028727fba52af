"""Approximate nearest neighbours by an inverted multi-index (operator 5); nearness is the inner product.

Vectors are cut in two halves, each quantised by its own codebook, so a vector's cell is a pair of
centroids.  Per query, centroid pairs are visited in the order of their summed inner products with a
heap until the visited cells hold a given share of all entries; entries of visited cells are then ranked by
the exact product in double precision.

Codebooks are fitted on at most ``SAMPLE`` vectors (smallest hash).  The share to visit is read off the
same sample: the least at which ``RECALL_GOAL`` of its true neighbours lie in visited cells.  Every vector is
indexed.  Equal vectors are one entry with their ``k + 1`` smallest ids (ties go to smaller ids, so no further
copy can be among the k nearest); cells are packed in blocks of about ``BLOCK`` entries and larger
cells are split by hash, and queries meet a block in groups of ``QUERIES``, so neither a common vector nor
a crowded cell lands in one task.

Vectors that are null, zero, of another length than most, or that hold nulls or non-finite components
take no part; null ids neither.  Repeated (id, vector) rows count once.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.session import scratch_path

SAMPLE = 10_000
CENTROIDS = 128
RECALL_GOAL = 0.96
BLOCK = 8192
QUERIES = 4096
_SALTS = 64


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col("vec")
    kept = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"  # nothing is rounded
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kept).alias("vec"))
    fine = (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    src = src.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    lengths = sorted(((r["count"], r["d"]) for r in src.groupBy(F.size(v).alias("d")).count().collect()), reverse=True)
    return src.where(F.size(v) == (lengths[0][1] if lengths else 0)).dropDuplicates()


def entries(vectors: DataFrame, k: int, is_query) -> DataFrame:
    """One row per distinct vector: its smallest id, its k + 1 smallest ids, whether any of its ids is a query."""
    salted = Window.partitionBy("vec", "salt").orderBy("vec_id")
    whole = Window.partitionBy("vec").orderBy("vec_id")
    asked = vectors.groupBy("vec").agg(F.max(is_query(F.col("vec_id")).cast("int")).alias("asked"))
    first = (vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)))
             .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
             .withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
             .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    return first.join(asked, "vec").select(F.col("ids")[0].alias("entry"), "ids", "vec", "asked")


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c ** 2).sum(1), 1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """Two codebooks, the entries per cell, and where each cell is kept."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        n = int(np.clip(round(len(sample) ** 0.5), 1, CENTROIDS))
        self.half = half
        self.books = [_kmeans(sample[:, :half], n), _kmeans(sample[:, half:], n)]
        self.n = n
        self.share = self._calibrate(sample, k)
        self.counts = np.zeros(n * n, np.int64)

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = (np.argmax(x @ c.T - 0.5 * (c ** 2).sum(1), 1) for x, c in zip((v[:, :self.half], v[:, self.half:]), self.books, strict=True))
        return a * self.n + b

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, :self.half] @ self.books[0].T, q[:, self.half:] @ self.books[1].T

    def _calibrate(self, sample: np.ndarray, k: int) -> float:
        """Share of entries visited before the cell of a true neighbour, at the wanted quantile."""
        q = np.arange(0, len(sample), max(1, len(sample) // 200))
        s = sample[q] @ sample.T
        s[np.arange(len(q)), q] = -np.inf
        top = np.argsort(-s, axis=1)[:, :min(k, len(sample) - 1)]
        if not top.size:
            return 1.0
        cell = self.cells(sample)
        a, b = self.halves(sample[q])
        u = a[:, cell // self.n] + b[:, cell % self.n]  # score of every entry's cell
        order = np.argsort(-u, axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(sample))[None].repeat(len(q), 0), 1)
        need = np.take_along_axis(place, top, 1) / len(sample)
        return float(min(1.0, np.quantile(need, RECALL_GOAL) + 0.01))

    def set_counts(self, counts: dict[int, int]) -> None:
        for c, m in counts.items():
            self.counts[c] = m
        total = np.cumsum(self.counts)
        self.splits = np.maximum(1, -(-self.counts // BLOCK))
        start = (total - self.counts) // BLOCK  # cells packed in order
        big = self.splits > 1
        # a large cell gets blocks of its own after all others
        first_own = int(start.max(initial=0)) + 1
        self.block = np.where(big, first_own + np.cumsum(np.where(big, self.splits, 0)) - np.where(big, self.splits, 0), start)

    def blocks(self, cell: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return self.block[cell] + spread % self.splits[cell]

    def visit(self, a: np.ndarray, b: np.ndarray, goal: float) -> tuple[float, list[int]]:
        """Multi-sequence traversal: pairs of centroids by falling summed product until ``goal`` entries were met.

        Returns the last score and the cells that hold entries."""
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        sa, sb, la, lb = a[oa].tolist(), b[ob].tolist(), oa.tolist(), ob.tolist()
        counts, n = self.counts, self.n
        heap, met, found, last = [(-(sa[0] + sb[0]), 0, 0)], 0, [], 0.0
        while heap and met < goal:
            neg, i, j = heapq.heappop(heap)
            last = -neg
            cell = la[i] * n + lb[j]
            if counts[cell]:
                met += int(counts[cell])
                found.append(cell)
            if j + 1 < n:
                heapq.heappush(heap, (-(sa[i] + sb[j + 1]), i, j + 1))
            if j == 0 and i + 1 < n:
                heapq.heappush(heap, (-(sa[i + 1] + sb[0]), i + 1, 0))
        return last, found


def _matrix(col, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind).reshape(len(col), -1).astype(np.float64)


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query(id column)`` holds."""
    spark = df.sparkSession
    vectors = valid_vectors(df, id_col, vec_col)
    kind = np.float32 if vectors.schema["vec"].dataType.simpleString() == "array<float>" else np.float64
    path = scratch_path(spark, "ann")
    entries(vectors, k, is_query).write.parquet(f"{path}/entries")
    kept = spark.read.parquet(f"{path}/entries")
    sample = kept.select("vec").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).toPandas()["vec"]  # a documented bound
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    index = MultiIndex(np.stack(sample.to_numpy()).astype(np.float64), k)
    first = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)
                raw = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("ids"), b.column("asked"), pa.array(raw, pa.binary()),
                                                  pa.array(first.value.cells(v.astype(np.float64)), pa.int32())],
                                                 ["entry", "ids", "asked", "raw", "cell"])

    kept.mapInArrow(assign, "entry long, ids array<long>, asked int, raw binary, cell int").write.parquet(f"{path}/cells")
    placed = spark.read.parquet(f"{path}/cells")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most CENTROIDS squared rows
    index.set_counts(counts)
    n = sum(counts.values())
    goal = max(index.share * n, 10.0 * k)
    shared = spark.sparkContext.broadcast(index)
    n_queries = placed.where("asked = 1").count()
    groups = max(1, -(-n_queries // QUERIES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column("raw").to_pylist()
            a, c = ix.halves(_matrix(raw, kind))
            for i, e in enumerate(b.column("entry").to_pylist()):
                last, cells = ix.visit(a[i], c[i], goal)
                cells = np.array(cells, np.int64)
                to = np.unique(np.concatenate([ix.block[cells] + s for s in range(int(ix.splits[cells].max()))]
                                              if len(cells) and (ix.splits[cells] > 1).any() else [ix.block[cells]]))
                m = len(to)
                yield pa.RecordBatch.from_pydict({"block": pa.array(to, pa.int64()), "part": pa.array([e % groups] * m, pa.int64()),
                                                  "entry": pa.array([e] * m, pa.int64()), "raw": pa.array([raw[i]] * m, pa.binary()),
                                                  "last": pa.array([last] * m, pa.float64())})

    routed = placed.where("asked = 1").select("entry", "raw").mapInArrow(route, "block long, part long, entry long, raw binary, last double")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("entry").to_numpy()
            blocks = shared.value.blocks(b.column("cell").to_numpy(), e // 7)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *b.columns], ["block", *b.schema.names])

    stored = (placed.select("entry", "ids", "raw", "cell").mapInArrow(spread, "block long, entry long, ids array<long>, raw binary, cell int")
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.col("part").cast("long")))

    def rank(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ix, out = shared.value, []
        if len(own) and len(asked):
            own = own.sort_values("entry")
            v, cell, q = _matrix(own["raw"], kind), own["cell"].to_numpy(), _matrix(asked["raw"], kind)
            a, c = ix.halves(q)
            ids = own["ids"].to_numpy()
            for lo in range(0, len(q), 256):
                hi = min(lo + 256, len(q))
                seen = a[lo:hi][:, cell // ix.n] + c[lo:hi][:, cell % ix.n] >= asked["last"].to_numpy()[lo:hi, None] - 1e-9
                score = np.where(seen, q[lo:hi] @ v.T, -np.inf)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
                for i in range(hi - lo):
                    for j in top[i]:
                        if score[i, j] > -np.inf:
                            out.append((asked["entry"].iat[lo + i], ids[j], score[i, j]))
        return pd.DataFrame(out, columns=["entry", "ids", "score"])

    near = routed.groupBy("block", "part").cogroup(stored.groupBy("block", "part")).applyInPandas(
        lambda asked, own: rank(own, asked), "entry long, ids array<long>, score double")
    best = Window.partitionBy("entry").orderBy(F.col("score").desc(), "vec_id")
    merged = (near.select("entry", "score", F.explode("ids").alias("vec_id"))
              .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    queries = (vectors.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec")
               .join(kept.where("asked = 1").select("entry", "vec"), "vec").select("query_id", "entry"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (queries.join(merged, "entry").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 20 == 0)
