"""SMOTE oversampling (X11).

Every class below the majority count is raised to it.  Synthetic rows are
spread round-robin over the class's rows (rank by hash), each picks one of
its base row's k nearest same-class neighbours and a gap u in [0, 1) from
md5 of (base key, j): x_new = x + u * (neighbour - x).  Generation is a
two-level explode (chunks first, then rows within a chunk), so a tiny
class that must grow a lot never emits all its rows from one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED, hash_hex, hash_int, hash_unit
from .neighbors import knn
from .split import rank_within

K_NEIGHBORS = 5
CHUNK = 10_000
SMOTE_MINORITY_PCT = 20.0


def needs_smote(train: DataFrame, label: str = "label") -> bool:
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    a = g.agg(F.min("c").alias("mn"), F.sum("c").alias("n")).first()
    return a["n"] > 0 and a["mn"] / a["n"] * 100 < SMOTE_MINORITY_PCT


def smote(train: DataFrame, features: list[str], key: str = "_key", label: str = "label",
          k: int = K_NEIGHBORS, seed=SEED) -> DataFrame:
    """Returns ``train`` plus synthetic rows (``_synthetic`` marks them)."""
    counts = {r[label]: r["c"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()}
    if len(counts) < 2:
        return train.withColumn("_synthetic", F.lit(False))
    n_max = max(counts.values())
    need = {c: n_max - n for c, n in counts.items() if n < n_max}
    base_cols = [key, label] + features
    base = train.select(*base_cols)
    out = train.withColumn("_synthetic", F.lit(False))
    if not need:
        return out
    minority = base.where(F.col(label).isin(list(need)))
    n_min = sum(counts[c] for c in need)
    ranked = rank_within(minority, [key], label, seed, "smote-base", n_min, "_r")
    spark = train.sparkSession
    alloc = spark.createDataFrame([(float(c), int(n), int(counts[c])) for c, n in need.items()],
                                  f"{label} double, _need bigint, _nc bigint")
    # one row per class: bounded
    ranked = ranked.join(F.broadcast(alloc), label)
    q = (F.floor(F.col("_need") / F.col("_nc")) +
         F.when(F.col("_r") <= F.col("_need") % F.col("_nc"), 1).otherwise(0)).cast("bigint")
    ranked = ranked.withColumn("_q", q).where(F.col("_q") > 0)
    nchunks = F.ceil(F.col("_q") / F.lit(CHUNK)).cast("bigint")
    chunks = ranked.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), nchunks - 1)))
    chunks = chunks.repartition(key, "_chunk")
    gen = chunks.withColumn("_j", F.explode(F.sequence(F.col("_chunk") * CHUNK,
                                                       F.least((F.col("_chunk") + 1) * CHUNK, F.col("_q")) - 1)))
    # neighbours within the class (a class of one row has none: its copies are exact duplicates)
    keff = {c: min(k, counts[c] - 1) for c in need}
    kmax = max(keff.values())
    keff_map = F.create_map(*[v for c, kk in keff.items() for v in (F.lit(float(c)), F.lit(kk))])
    gen = gen.withColumn("_k", keff_map[F.col(label).cast("double")])
    hj = hash_hex([F.col(key), F.col("_j")], seed, "smote")
    gen = (gen.withColumn("_h", hj)
              .withColumn("_nn", F.when(F.col("_k") > 0, (hash_int(F.col("_h"), 8) % F.col("_k")) + 1))
              .withColumn("_u", hash_unit(hash_hex([F.col(key), F.col("_j")], seed, "gap"))))
    if kmax > 0:
        nn = knn(minority, minority, features, kmax, [key], [key], group=label, exclude_self=True)
        nn = nn.select(F.col("q_" + key).alias(key), F.col("nn_rank").alias("_nn"), F.col("r_" + key).alias("_nk"))
        nbr = minority.select(F.col(key).alias("_nk"), *[F.col(f).alias("_n_" + f) for f in features])
        gen = gen.join(nn, [key, "_nn"], "left").join(nbr, "_nk", "left")
    else:
        gen = gen.withColumn("_nk", F.lit(None).cast("string")).withColumns(
            {"_n_" + f: F.lit(None).cast("double") for f in features})
    syn = gen.select(
        F.concat(F.col(key).cast("string"), F.lit("|smote|"), F.col("_j").cast("string")).alias(key),
        F.col(label),
        *[F.when(F.col("_nk").isNull(), F.col(f).cast("double"))
           .otherwise(F.col(f).cast("double") + F.col("_u") * (F.col("_n_" + f).cast("double") - F.col(f).cast("double")))
           .alias(f) for f in features],
        F.lit(True).alias("_synthetic"))
    return out.select(*[c for c in out.columns if c in syn.columns]).unionByName(
        syn.select(*[c for c in out.columns if c in syn.columns]))
