"""Toxicity by multiple-instance learning (operator 6).

A document is a bag of sentences.  A sentence's evidence s is the sum of the weights of its words (features: the word and
its first 4 and 5 letters); its score is logistic above the score of a sentence that says nothing,
``p = max(0, (f(BIAS + s) - f(BIAS)) / (1 - f(BIAS)))``, and less than FLOOR counts as nothing.  The document's score is the
noisy-or ``1 - prod(1 - p)``: neutral sentences add nothing however many there are, only document labels are needed
for training (where LEAK stands for labels without such a sentence), and the sentences that carry the score can be pointed at afterwards.

Training reads the labelled documents with the smallest hash of the id, at most ``TRAIN_PER_CLASS`` of a class and at most
``TRAIN_BYTES`` of text (a document that would pass that bound is left out; documented bounds).  Sentences are turned into
feature numbers in the executors, features of few documents go there too, and the driver gets 32-bit numbers
of what is left.  BIAS, FLOOR and SHRINK were chosen by log-loss in three folds of the training rows of sf0.1, held-out rows unseen.  Scoring is one pass over whole texts with one look-up per distinct word of an Arrow batch.

Null and empty texts have no sentence and score 0; they teach nothing.  Labels that are null or repeated: nulls teach nothing,
of repeated ones the largest counts.  With labels of one class only, or none, every document gets that class's
share (0 if none).  Repeated rows score alike and teach once; other columns pass through ``with_scores`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import scratch_path

from .common import SMALL_SLICE_BYTES, documents, keyed_text, slices

TRAIN_PER_CLASS = 2000
#: Bytes of training text of a class.
TRAIN_BYTES = 16 << 20
PREFIXES = (4, 5)
#: Logit of a sentence without evidence, least score of a sentence that counts, share of toxic labels without a toxic sentence.
BIAS, FLOOR, LEAK = -7.0, 0.05, 0.01
#: Adam steps, their size, and what each takes off a weight (chance words stay at zero).
ROUNDS, RATE, SHRINK = 200, 0.3, 0.004
#: Features of fewer training documents than this are not used.
MIN_DOCUMENTS = 4
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_MARKS = frozenset(".!?\n")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_features(words: list[str]) -> np.ndarray:
    """One row of features (64-bit hashes, 0 for none) per word; a prefix as long as the word repeats nothing."""
    parts = [words] + [[w[:k] + "-" if len(w) > k else "" for w in words] for k in PREFIXES]
    out = np.stack([pd.util.hash_array(np.array(p, object), categorize=False) for p in parts], axis=1)
    for i, p in enumerate(parts[1:], 1):
        out[[not x for x in p], i] = 0
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(word code per token, distinct words, sentence per token, document per sentence)."""
    code, seen, sentence, doc = [], {}, [], []
    for d, text in enumerate(texts):
        doc.append(d)
        for t in _TOKEN.findall(text.lower()):
            if t in _MARKS:
                doc.append(d)
            else:
                code.append(seen.setdefault(t, len(seen)))
                sentence.append(len(doc) - 1)
    return np.array(code, np.int64), list(seen), np.array(sentence, np.int64), np.array(doc, np.int64)


def evidence(texts: list[str], keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights and document of each sentence that has a feature with a weight; ``keys`` are those features, sorted."""
    code, words, sentence, doc = tokens(texts)
    if not words or not len(keys):
        return np.zeros(0), np.zeros(0, np.int64)
    feats = word_features(words)
    at = np.minimum(np.searchsorted(keys, feats), len(keys) - 1)
    at[keys[at] != feats] = -1
    pair = (sentence[:, None] * np.int64(len(keys)) + at[code])[at[code] >= 0]
    pair = np.unique(pair)  # a feature counts once in a sentence, as in training
    found, row = np.unique(pair // len(keys), return_inverse=True)
    return np.bincount(row, weights=weights[pair % len(keys)], minlength=len(found)), doc[found]


def _log_clean(s: np.ndarray) -> np.ndarray:
    """log(1 - p) of a sentence with evidence s."""
    return np.logaddexp(0.0, BIAS) - np.logaddexp(0.0, BIAS + np.maximum(s, 0))


def sentence_scores(s: np.ndarray) -> np.ndarray:
    p = -np.expm1(_log_clean(s))
    return np.where(p >= FLOOR, p, 0.0)


def noisy_or(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(scores, 1 - 1e-15)), minlength=n))


def objective(w: np.ndarray, sent: np.ndarray, feat: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the document labels, classes weighted alike, and its gradient.

    ``sent`` and ``feat`` are the pairs of sentence and feature, ``doc`` the document of each sentence."""
    s = np.bincount(sent, weights=w[feat], minlength=len(doc))
    log_none = np.log1p(-LEAK) + np.bincount(doc, weights=_log_clean(s), minlength=len(y))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    some = -np.expm1(log_none)
    loss = -(weight * np.where(y > 0, np.log(some), log_none)).sum()
    # d loss / d log(1 - P): -1 for negatives, (1 - P) / P for positives; d log(1 - p) / d s = -f(BIAS + s) where s counts
    slope = weight * np.where(y > 0, np.exp(log_none) / some, -1.0)
    by_sentence = -slope[doc] * np.where(s >= 0, 1 / (1 + np.exp(-(BIAS + s))), 0.0)
    return float(loss), np.bincount(feat, weights=by_sentence[sent], minlength=len(w))


def fit(n: int, sent: np.ndarray, feat: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of n features, by Adam with shrinkage."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for step in range(1, ROUNDS + 1):
        g = objective(w, sent, feat, doc, y)[1] + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 3e-3)
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK, 0)
    return w


class Model:
    """Features and weights, or a constant score where the labels hold fewer than two classes."""

    def __init__(self, keys: np.ndarray | None, weights: np.ndarray | None, constant: float = 0.0):
        self.keys, self.weights, self.constant = keys, weights, constant

    def score(self, texts: list[str]) -> np.ndarray:
        if self.keys is None:
            return np.full(len(texts), self.constant)
        s, doc = evidence(texts, self.keys, self.weights)
        return noisy_or(sentence_scores(s), doc, len(texts))


def _chosen(docs: DataFrame, labels: DataFrame, per_class: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, list[int]]:
    """text, label of the training documents, and how many there are of either class."""
    truth = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")))
    src = keyed_text(docs, id_col, text_col).where(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
    sizes = src.select("doc_id", "h", F.octet_length("text").alias("size")).join(truth, "doc_id").groupBy("doc_id", "h", "label").agg(F.max("size").alias("size"))
    picked, counts = [], [0, 0]
    for k in (0, 1):  # at most per_class rows of numbers
        room = max_bytes
        for r in sizes.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(per_class).collect():
            if r.size <= room:
                room -= r.size
                counts[k] += 1
                picked.append((r.doc_id, r.h, k))
    kind = src.schema["doc_id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame(picked, f"doc_id {kind}, h long, label int")
    return src.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label")), counts


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as pairs of sentence and feature."""
    for b in slices(batches):
        out = []
        for text in b.column("text").to_pylist():
            code, words, sentence, _ = tokens([text])
            feats = word_features(words)[code] if words else np.zeros((0, 1 + len(PREFIXES)), np.uint64)
            pairs = np.unique(np.column_stack([np.repeat(sentence, feats.shape[1]).astype(np.uint64), feats.ravel()])[feats.ravel() != 0], axis=0)
            out.append(pairs)
        ends = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
        flat = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(ends, pa.array(flat[:, 0].astype(np.int32))),
                                          pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat[:, 1]).view(np.int64)))], ["label", "sent", "feat"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, max_bytes: int = TRAIN_BYTES, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the rows that are not held out; ``per_class`` and ``max_bytes`` bound what comes to the driver."""
    spark = docs.sparkSession
    rows, counts = _chosen(docs, labels, per_class, max_bytes, id_col, text_col, label_col)
    if not all(counts):
        return Model(None, None, 1.0 if counts[1] else 0.0)
    path = scratch_path(spark, "toxicity-features")
    rows.select("text", "label").mapInArrow(_numbered, "label int, sent array<int>, feat array<long>").write.parquet(path)
    rows = spark.read.parquet(path)
    used = (rows.select(F.explode(F.array_distinct("feat")).alias("feat")).groupBy("feat").agg(F.count("*").alias("n"))
            .where(F.col("n") >= MIN_DOCUMENTS).select("feat").toArrow().column("feat").to_numpy())
    keys = np.sort(used.view(np.uint64))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("feat")
            feat, sent = lists.flatten().to_numpy().view(np.uint64), b.column("sent").flatten().to_numpy()
            at = np.searchsorted(keys, feat)
            keep = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == feat) if len(keys) else np.zeros(len(feat), bool)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ends = pa.array(np.concatenate([[0], np.cumsum(keep)])[offsets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.ListArray.from_arrays(ends, pa.array(x[keep].astype(np.int32))) for x in (sent, at))],
                                             ["label", "sent", "at"])

    table = rows.mapInArrow(known, "label int, sent array<int>, at array<int>").toArrow().combine_chunks()
    sent, feat = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("sent", "at"))
    counts = np.diff(table.column("at").combine_chunks().offsets.to_numpy())
    y = table.column("label").to_numpy().astype(float)
    # sentences without a known feature say nothing, so only the others are numbered
    of, place = np.unique(np.repeat(np.arange(len(y), dtype=np.int64), counts) << 32 | sent, return_inverse=True)
    order = np.lexsort((feat, place))  # the same sums in whatever order the rows came
    w = fit(len(keys), place[order].astype(np.int32), feat[order], (of >> 32).astype(np.int32), y)
    return Model(keys[w != 0], w[w != 0])


def with_scores(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The table with a score per row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the weights of the bounded training sample
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SMALL_SLICE_BYTES):
            scores = shared.value.score([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, score_col])

    return df.mapInArrow(run, f"{fields}, `{score_col}` double")


def offending(df: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence, score of every sentence whose own score reaches the threshold."""
    src = keyed_text(df, id_col, text_col)
    shared = src.sparkSession.sparkContext.broadcast(model)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, parts = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                found = [x.strip() for x in re.split(r"(?<=[.!?])|\n", t or "") if x.strip()]
                ids += [i] * len(found)
                parts += found
            scores = shared.value.score(parts)  # a sentence alone is a document of one
            keep = np.flatnonzero(scores >= threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(np.array(ids, np.int64)[keep], pa.int64())),
                 pa.array([parts[i] for i in keep], pa.string()), pa.array(scores[keep], pa.float64())], ["doc_id", "sentence", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, sentence string, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_scores(keyed_text(docs, "doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
