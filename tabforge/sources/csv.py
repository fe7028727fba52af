"""CSV scan with pandas-like missing tokens and type inference.

Columns are read as strings; the NA tokens become NULL; one aggregation
counts, per column, values that fail each candidate type; the narrowest
type every non-null value fits is cast.  (Spark's own ``inferSchema``
turns a double column holding ``nan`` into a string column.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default missing-value tokens of pandas' CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOL_TOKENS = ["true", "false", "True", "False", "TRUE", "FALSE"]


def _exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that Spark would read from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError("Only CSV files are supported.")
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                .option("inferSchema", False).csv(path))
    cols = raw.columns
    norm = raw.select(*[F.when(F.col(c).isin(NA_TOKENS), None).otherwise(F.col(c)).alias(c) for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        nn = x.isNotNull()
        aggs += [F.count_if(nn & x.try_cast("bigint").isNull()).alias(f"l{i}"),
                 F.count_if(nn & x.try_cast("double").isNull()).alias(f"d{i}"),
                 F.count_if(nn & ~x.isin(BOOL_TOKENS)).alias(f"b{i}"),
                 F.count_if(nn & F.try_to_timestamp(x).isNull()).alias(f"t{i}"),
                 F.count(x).alias(f"n{i}")]
    a = norm.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        x = F.col(c)
        if a[f"n{i}"] == 0:
            out.append(x.cast("double").alias(c))
        elif a[f"l{i}"] == 0:
            out.append(x.try_cast("bigint").alias(c))
        elif a[f"d{i}"] == 0:
            out.append(x.try_cast("double").alias(c))
        elif a[f"b{i}"] == 0:
            out.append((F.lower(x) == "true").alias(c))
        elif a[f"t{i}"] == 0:
            out.append(F.try_to_timestamp(x).alias(c))
        else:
            out.append(x.alias(c))
    return norm.select(*out)
