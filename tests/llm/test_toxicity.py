"""Toxicity: plain noisy-or, the gradient by differences, very long clean texts, the bounds of the training sample."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.fixtures import SF
from tabforge.llm import toxicity

BAD = ["you are a worthless wretch", "what a worthless fool", "such a wretched worthless thing"]
GOOD = ["the river runs past the mill", "she reads a book by the window", "rain fell on the old town", "a letter came in the morning"]


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        sentences = [GOOD[k] for k in rng.integers(0, 4, 6)]
        if i % 4 == 0:
            sentences[rng.integers(0, 6)] = BAD[rng.integers(0, 3)]
        rows.append((i, ". ".join(sentences) + ".", int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(df, df)


def plain(model, text):
    """One sentence after the other, one word after the other."""
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    base, clean = 1 / (1 + math.exp(-toxicity.BIAS)), 1.0
    for sentence in re.split(r"[.!?\n]", text.lower()):
        found = set()
        for word in re.findall(r"[^\W\d_]+", sentence):
            found |= set(toxicity.word_features([word])[0].tolist()) - {0}
        s = sum(weight.get(f, 0.0) for f in found)
        p = max(0.0, (1 / (1 + math.exp(-toxicity.BIAS - s)) - base) / (1 - base))
        clean *= 1 - (p if p >= toxicity.FLOOR else 0.0)
    return 1 - clean


def test_scores_against_plain_noisy_or(spark, sf_texts, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = [t or "" for t in list(sf_texts.values())[:60]] + [". ".join(BAD + GOOD), "", "Worthless! WORTHLESS?\nworthless"]
    for m in (model, toxicity.train(docs, labels)):
        assert np.allclose(m.score(texts), [plain(m, t) for t in texts], atol=1e-9)
    assert model.score([". ".join(GOOD), BAD[0], ". ".join([*GOOD, BAD[1]])]).round().tolist() == [0, 1, 1]


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    sent, feat = rng.integers(0, 40, 200), rng.integers(0, 15, 200)
    doc, y = np.sort(rng.integers(0, 12, 40)), rng.integers(0, 2, 12).astype(float)
    w = rng.normal(0.5, 1.5, 15)
    _, g = toxicity.objective(w, sent, feat, doc, y)
    for k in range(15):
        step = np.zeros(15)
        step[k] = 1e-6
        d = (toxicity.objective(w + step, sent, feat, doc, y)[0] - toxicity.objective(w - step, sent, feat, doc, y)[0]) / 2e-6
        assert abs(d - g[k]) < 1e-5


def test_length_is_no_evidence(model):
    """Many clean sentences score as few do; one toxic sentence is found among them."""
    clean = ". ".join(GOOD * 5000)
    assert model.score([clean])[0] == model.score([". ".join(GOOD)])[0] == 0
    assert model.score([clean + ". " + BAD[0]])[0] > 0.5


def test_training_bounds(spark):
    """At most so many documents and bytes of a class; a longer document is left out, repeated rows count once."""
    rows = [(i, "word " * 10) for i in range(50)] + [(100, "word " * 10_000), (3, "word " * 10), (60, None), (61, "")]
    df = spark.createDataFrame([*rows, *rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i, _ in rows], "doc_id long, toxic int")
    free = labels.where(~toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") < 50)).distinct().groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in free}

    def chosen(per_class, max_bytes):
        got, counts = toxicity._chosen(df, labels, per_class, max_bytes, "doc_id", "text", "toxic")
        assert got.count() == sum(counts)
        return counts
    assert chosen(1000, 10_000) == [n[0], n[1]]
    assert chosen(4, 10_000) == [4, 4]
    assert chosen(1000, 160) == [3, 3]
