"""Connected components of an edge table, every step a written table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge table (a, b): label is the least node that can be reached.

    Labels take the least label among neighbours and then the label of their label, until nothing changes."""
    spark = edges.sparkSession
    path = scratch_path(spark, "components")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both.write.parquet(f"{path}/edges")
    both = spark.read.parquet(f"{path}/edges")
    both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")).write.parquet(f"{path}/0")
    step = 0
    while True:
        now = spark.read.parquet(f"{path}/{step}")
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = now.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step += 1
        (better.join(far, "label", "left").select("node", "old", F.least("label", "far").alias("label")).write.parquet(f"{path}/{step}"))
        done = spark.read.parquet(f"{path}/{step}")
        if done.where("old <> label").isEmpty():
            return done.select("node", "label")
