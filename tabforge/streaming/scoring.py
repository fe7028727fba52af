"""Stream scoring (ST1): files arriving in a folder are scored by a saved model.

Stateless: ``readStream`` -> the saved preprocessing projection and model
transform -> ``writeStream``.  The checkpoint folder makes the query
restartable after failures (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.scoring import predict
from ..sources.models import load_fitted


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, model_dir: str, sink_dir: str,
                 checkpoint: str, available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    model, prep = load_fitted(model_dir)
    if model.kind == "knn":
        raise ValueError("KNN models rank a stream row against the training table; score them in batch.")
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    scored = predict(stream, model, prep)
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
               .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
