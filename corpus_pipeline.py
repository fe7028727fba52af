"""The corpus pipeline: toxicity, quality rules, line dedup, n-gram Jaccard join, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  ``run`` writes each stage's result to the shared folder and reads it again for the next.
Null texts are empty and leave at the quality stage; an empty table passes through to an empty result.  Rows that repeat an id and
text are one document to line dedup and near copies to the join, so one of them stays; ties go to smaller ids.  Very long texts
are scored, cut and packed whole.  Further columns of documents, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import jaccard, line_dedup, packing, quality, toxicity
from tabforge.session import scratch_path


def _recounted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model learnt from the documents this stage gets."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, model, "text", "__score").where(F.col("__score") < 0.5).drop("__score")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their removed lines."""
    return _recounted(quality.filter_documents(docs))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs; a document of which nothing is left goes."""
    cut = line_dedup.dedup(docs)
    left = cut.where((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_words")))
    return _recounted(left.select(*docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their place in a training sequence."""
    import public_tokenizers as vocab
    return packing.pack_documents(docs, vocab.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", apply_quality_rules), ("line_dedup", cut_repeated_lines),
          ("jaccard_join", one_of_each_group), ("best_fit_packing", pack_sequences)]

#: Learnt scores and library tokenizers cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
