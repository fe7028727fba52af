"""Exact stratified split, folds and ranks by stable hash.

A row's place is its rank by ``md5(key|seed|salt)`` within its class.  The
rank semantics equal ``row_number() OVER (PARTITION BY class ORDER BY h)``
but never put a whole class in one task:

* the split only needs the k-th smallest hash per class.  Bucket counts on
  the leading hex digits locate the boundary bucket; only that bucket's rows
  are ranked, and the result is a per-class threshold (one row per class).
* folds need every rank.  Bucket counts give each (class, bucket) a running
  offset; rows are numbered within (class, bucket) and shifted by it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import SEED, hash_hex, hash_int

TEST_SIZE = 0.2
N_FOLDS = 5
# rows per hash bucket we aim for when choosing how many hex digits to use
_BUCKET_ROWS = 50_000
# per-class tables at most this long are broadcast; longer ones shuffle-join
_BROADCAST_ROWS = 200_000


def bucket_digits(n_rows: int) -> int:
    return int(min(6, max(1, math.ceil(math.log(max(n_rows, 1) / _BUCKET_ROWS, 16)))))


def _with_hash(df: DataFrame, key: list[str], seed, salt) -> DataFrame:
    return df.withColumn("_h", hash_hex(key, seed, salt))


def _group_col(strata: str | None):
    return F.col(strata) if strata else F.lit(0)


def split(df: DataFrame, key: list[str], strata: str | None, test_size: float = TEST_SIZE,
          seed=SEED, n_rows: int | None = None) -> DataFrame:
    """Adds ``is_test``; per class the ceil(test_size * n_c) smallest hashes are test.

    A class of one row raises (it cannot be split), as a stratified split must.
    """
    d = _with_hash(df, key, seed, "split").withColumn("_g", _group_col(strata))
    n_rows = n_rows if n_rows is not None else d.count()
    dig = bucket_digits(n_rows)
    d = d.withColumn("_b", hash_int(F.col("_h"), dig))
    cnt = d.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy("_g").orderBy("_b")
    cum = (cnt.withColumn("_cum", F.sum("_c").over(wc.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_ng", F.sum("_c").over(Window.partitionBy("_g"))))
    cum = cum.withColumn("_k", F.ceil(F.col("_ng") * F.lit(test_size)).cast("bigint"))
    # boundary bucket: first bucket whose running count reaches k
    bnd = (cum.where(F.col("_cum") >= F.col("_k"))
              .groupBy("_g").agg(F.min(F.struct("_b", "_cum", "_c", "_k", "_ng")).alias("s"))
              .select("_g", F.col("s._b").alias("_bb"),
                      (F.col("s._k") - (F.col("s._cum") - F.col("s._c"))).alias("_r"), F.col("s._ng").alias("_ng")))
    spark = df.sparkSession
    bnd_rows = bnd.collect()                                   # one row per class
    if strata and any(r["_ng"] < 2 for r in bnd_rows):
        raise ValueError("The least populated class has only 1 member; a stratified split needs 2.")
    bnd = spark.createDataFrame(bnd_rows, bnd.schema).drop("_ng")
    # rank only the boundary bucket of each class (about n / 16^digits rows)
    inb = d.join(F.broadcast(bnd), ["_g"], "inner").where(F.col("_b") == F.col("_bb"))
    w = Window.partitionBy("_g").orderBy("_h")
    thr_rows = (inb.select("_g", "_bb", "_r", "_h").withColumn("_rn", F.row_number().over(w))
                   .where(F.col("_rn") == F.col("_r")).select("_g", "_bb", F.col("_h").alias("_hh")).collect())
    g_type = d.schema["_g"].dataType.simpleString()
    thr = spark.createDataFrame(thr_rows, f"_g {g_type}, _bb bigint, _hh string")
    out = d.join(F.broadcast(thr), "_g", "left")  # one row per class: bounded
    is_test = (F.col("_b") < F.col("_bb")) | ((F.col("_b") == F.col("_bb")) & (F.col("_h") <= F.col("_hh")))
    return out.withColumn("is_test", F.coalesce(is_test, F.lit(False))).drop("_h", "_g", "_b", "_bb", "_hh")


def rank_within(df: DataFrame, key: list[str], strata: str | None, seed=SEED, salt="rank",
                n_rows: int | None = None, out: str = "rank") -> DataFrame:
    """Exact 1-based rank by hash within each class, without one-task windows."""
    d = _with_hash(df, key, seed, salt).withColumn("_g", _group_col(strata))
    n_rows = n_rows if n_rows is not None else d.count()
    dig = bucket_digits(n_rows)
    d = d.withColumn("_b", hash_int(F.col("_h"), dig))
    cnt = d.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(wc), F.lit(0))).drop("_c")
    n_buckets = 16 ** dig
    if n_buckets <= _BROADCAST_ROWS:
        off = F.broadcast(off)
    j = d.join(off, ["_g", "_b"], "inner")
    w = Window.partitionBy("_g", "_b").orderBy("_h")
    return (j.withColumn(out, (F.row_number().over(w) + F.col("_off")).cast("bigint"))
             .drop("_h", "_g", "_b", "_off"))


def assign_folds(df: DataFrame, key: list[str], strata: str | None, k: int = N_FOLDS, seed=SEED,
                 n_rows: int | None = None, out: str = "fold") -> DataFrame:
    """L1: fold = (rank - 1) mod k within class, so fold sizes differ by at most one."""
    r = rank_within(df, key, strata, seed, "fold", n_rows, "_rank")
    return r.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """Class counts and percentage of rows."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = g.agg(F.sum("count").alias("t")).first()["t"]
    return g.withColumn("pct", F.col("count") / F.lit(float(tot)) * 100.0)


# SQL twins (DuckDB) ---------------------------------------------------------
def split_sql(src: str, key: list[str], strata: str | None, test_size: float = TEST_SIZE, seed=SEED) -> str:
    from ..functions.hashing import hash_hex_sql
    h = hash_hex_sql(key, seed, "split")
    part = f"PARTITION BY {strata}" if strata else ""
    return (f"(SELECT *, row_number() OVER ({part} ORDER BY {h}) <= "
            f"ceil(count(*) OVER ({part}) * {test_size}) AS is_test FROM {src})")


def folds_sql(src: str, key: list[str], strata: str | None, k: int = N_FOLDS, seed=SEED) -> str:
    from ..functions.hashing import hash_hex_sql
    h = hash_hex_sql(key, seed, "fold")
    part = f"PARTITION BY {strata}" if strata else ""
    return f"(SELECT *, CAST((row_number() OVER ({part} ORDER BY {h}) - 1) % {k} AS INTEGER) AS fold FROM {src})"
