"""Model sink and source.

A saved model is a folder: ``metadata.json`` (model name, kind, features,
problem type, fitted preprocessing: imputation values, encodings, class
labels) plus the MLlib ``PipelineModel`` (``mllib/``) or, for KNN, the
reference rows as Parquet (``reference/``).  A Huber regressor is all metadata.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file through Hadoop's filesystem (works on any shared store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        raise FileNotFoundError(f"Model not found: {path}")
    stream = fs.open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    lines = []
    line = reader.readLine()
    while line is not None:
        lines.append(line)
        line = reader.readLine()
    reader.close()
    return "\n".join(lines)


def save_fitted(m, path: str, prep: dict | None = None) -> None:
    """Overwrite ``path`` with the model and its preprocessing metadata."""
    spark = SparkSession.getActiveSession()
    meta = {"model_name": m.name, "kind": m.kind, "features": m.features, "problem_type": m.problem_type,
            "params": m.params, "n_classes": m.n_classes, "prep": prep or {}}
    if m.kind == "mllib":
        m.model.write().overwrite().save(os.path.join(path, "mllib"))
    elif m.kind == "knn":
        m.model.write.mode("overwrite").parquet(os.path.join(path, "reference"))
    _write_text(spark, os.path.join(path, "metadata.json"), json.dumps(meta, default=str))


def load_fitted(path: str):
    """Returns (Fitted, prep metadata); a missing folder raises FileNotFoundError."""
    from ..operators.learners import Fitted
    spark = SparkSession.getActiveSession()
    meta = json.loads(_read_text(spark, os.path.join(path, "metadata.json")))
    m = Fitted(meta["model_name"], meta["problem_type"], meta["features"], meta["kind"],
               params=meta["params"], n_classes=meta["n_classes"])
    if m.kind == "mllib":
        m.model = PipelineModel.load(os.path.join(path, "mllib"))
    elif m.kind == "knn":
        m.model = spark.read.parquet(os.path.join(path, "reference"))
    return m, meta["prep"]
