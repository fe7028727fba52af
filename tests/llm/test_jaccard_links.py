"""Operator 8's number of links and its pairs against all pairs."""

import numpy as np

from tabforge.llm import jaccard

from llm.test_texts import sets_of


def test_links_and_their_number_against_all_pairs(spark, sf_texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)  # several blocks per group
    rng = np.random.default_rng(5)
    base, near = [f"t{k}" for k in rng.integers(0, 1000, 60)], []
    for i in range(25):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 5)):
            w[k] = f"edit{i}x{k}"
        near.append((100000 + i, " ".join(w)))
    texts = [*sf_texts.items(), *near, (200000, near[0][1].upper()), (200001, near[3][1]), (200002, near[3][1]), (200003, "all alone here"), (200004, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = sets_of(texts)
    pairs = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    want = dict.fromkeys(sets, 0)
    for a, b in pairs:
        want[a] += 1
        want[b] += 1
    rows = jaccard.cluster(df).collect()
    assert {r.doc_id: r.n_links for r in rows} == want and max(want.values()) > 2
    # every pair of distinct texts, each once
    text_of, id_of = dict(texts), {}
    for r in rows:
        id_of.setdefault(r.h, r.doc_id)
    distinct = df.where("text is not null").selectExpr("xxhash64(text) as h", "text").groupBy("h").count().withColumnRenamed("count", "copies")
    found = jaccard.links(jaccard.token_sets(df.selectExpr("xxhash64(text) as h", "text").dropDuplicates(["h"]).join(distinct, "h")), every=True).collect()
    got = sorted(tuple(sorted((text_of[id_of[r.a]], text_of[id_of[r.b]]))) for r in found)
    assert got == sorted({tuple(sorted((text_of[a], text_of[b]))) for a, b in pairs if text_of[a] != text_of[b]})
