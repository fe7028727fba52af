"""Operators 1, 5, 6, 7, 8, 9 and the pipeline against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import compare, duck
from tabforge.llm import ann, jaccard, licenses, line_dedup, quality, queries, toxicity

from llm.fixtures import PASSAGE, SF, TEXTS


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_agrees(spark, name):
    assert not compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name])[0]


def test_line_dedup_cuts_exactly_later_repeats(spark, edge_docs, no_docs):
    rows = {(r.doc_id, r.text): r for r in line_dedup.dedup(edge_docs).collect()}
    by = {i: r for (i, _), r in rows.items()}
    assert PASSAGE.split()[3] in by[2].text and by[2]["__n_removed"] == 0
    assert by[3]["__n_removed"] == 60 and "shared" not in by[3].text and by[3].lang is None and by[3].words == "u"
    assert by[4].text == "" and by[1]["__n_removed"] == 0  # the copy with the larger id goes
    assert by[5].text is None and by[6].text == "" and by[7].text == "one two" and by[9]["__n_removed"] == 0
    assert by[13]["__n_removed"] > 120
    assert line_dedup.dedup(no_docs).count() == 0


def test_line_dedup_against_all_windows(spark, sf_texts):
    rows = sorted(line_dedup.op1_line_dedup(spark, SF).collect(), key=lambda r: r.doc_id)
    seen = {40: set(), 50: set()}
    must = cut = 0
    for r in rows:
        words, covered = sf_texts[r.doc_id].split(), {}
        for k in (40, 50):
            covered[k] = set()
            for i in range(len(words) - k + 1):
                w = tuple(words[i:i + k])
                if w in seen[k]:
                    covered[k].update(range(i, i + k))
                seen[k].add(w)
        assert len((r.text or "").split()) == r.n_words - r.n_removed_words
        assert r.n_removed_words <= len(covered[40])  # nothing but repeats goes
        must += len(covered[50])
        cut += min(r.n_removed_words, len(covered[50]))
    assert must and cut >= 0.98 * must


def test_nearest_recall_ties_and_invalid_vectors(spark):
    base = [float(x) for x in range(1, 9)]
    rows = [(i, [x + (i % 13) * (k + 1) / 9 for k, x in enumerate(base)]) for i in range(0, 400)]
    rows += [(1000 + i, base) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [1.0]), (None, base), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.search(df, lambda c: c % 20 == 0, k=5).collect()
    valid = [(i, np.array(v, np.float32).astype(float)) for i, v in dict(rows[:460]).items()]
    hits = total = 0
    for q, v in valid:
        if q % 20 == 0:
            want = sorted(((-float(v @ w), i) for i, w in valid if i != q))[:5]
            have = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
            assert [h[0] for h in have] == [1, 2, 3, 4, 5]
            hits += len({h[1] for h in have} & {i for _, i in want})
            total += 5
    assert hits >= 0.9 * total and {r.query_id for r in got} == {q for q, _ in valid if q % 20 == 0}
    assert ann.search(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_nearest_recall_on_the_table(spark):
    got = ann.op5_nearest(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        s[i] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        have = {r.vec_id for r in got if r.query_id == ids[i]}
        hits, total = hits + len(want & have), total + len(want)
    assert hits >= 0.9 * total


def test_toxicity_learns_held_out_documents_and_points_at_sentences(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = (toxicity.with_scores(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect())
    pos, neg = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and np.mean([(r.score >= 0.5) == r.toxic for r in rows]) > 0.9
    worst = toxicity.offending(docs, model).orderBy(F.desc("score")).first()
    assert worst.score > 0.5 and worst.sentence


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (7, 1), (7, 0), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.with_scores(edge_docs, toxicity.train(edge_docs, labels), score_col="p").collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.p <= 1 for r in rows) and all(r.p == 0 for r in rows if not (r.text or "").strip())
    alone = toxicity.train(edge_docs, labels.where("toxic = 1"))
    assert alone.score(["x"]) == [1.0] and toxicity.train(no_docs, labels).score(["x"]) == [0.0]


def test_quality_rules_edges_and_lines(spark, edge_docs, no_docs):
    rows = {r.doc_id: r for r in quality.measured(edge_docs, prefix="q_").collect()}
    assert rows[5].q_n_words == 0 and rows[5].q_base_failed and not rows[5].q_kept and rows[1].q_kept and rows[9].q_kept
    assert rows[13].q_n_dup_lines == 59 and rows[13].q_base_failed
    good = "This is a clean sentence that says something about a subject, at length.\n" + TEXTS[1][1]
    nav = "Home | About | Contact | Help | Imprint"
    df = spark.createDataFrame([(1, f"{nav}\n{good}"), (2, f"{nav}\n" * 3 + "short line."), (3, "word*** " * 40)], "doc_id long, text string")
    kept = quality.filter_documents(df).collect()
    assert [r.doc_id for r in kept] == [1] and kept[0].text == good
    assert quality.filter_documents(no_docs).count() == 0


def test_quality_sql_on_planted_lines(spark, tmp_path):
    """Separators side by side, at line ends and between other white space; the SQL counts them as the operator does."""
    import duckdb
    lines = ["| | a b c d e f g h", "a | | b c d e f g", "| a b c d e f g h i", "a b |", "|", "| |", "- / -", "a\t|\x0b| b c d e f g h", "a || b c d",
             "x > y · z • w", "a |\r", "", " ", "one two three four five six seven eight nine ten eleven twelve thirteen", "A!! B!! c d e"]
    rng = np.random.default_rng(9)
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in range(300)] + [(300 + i, x) for i, x in enumerate(lines)] + [(900, None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert not compare(quality.op7_quality_rules(spark, str(tmp_path)), con, quality.OP7_SQL)[0]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeat_words_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40), p=[.8, .1, .1])) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measured(df).collect():
        w = texts[r.doc_id].split()
        count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if count[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert r.n_repeat_words == len(inside)


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    ids = sorted(sets)
    label = {i: i for i in ids}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard_components_against_all_pairs(spark, sf_texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)  # several blocks per group
    rng = np.random.default_rng(4)
    base = [f"t{k}" for k in rng.integers(0, 1000, 60)]
    near = []
    for i in range(25):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"edit{i}x{k}"
        near.append((100000 + i, " ".join(w)))
    texts = [*sf_texts.items(), *near, (200000, near[0][1].upper())]
    rows = jaccard.cluster(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sets = sets_of(texts)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(sets)


def test_jaccard_edges_and_keep_one(edge_docs, no_docs):
    rows = jaccard.cluster(edge_docs).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[4] == got[1] == got[10] == 1 and got[8] == 7 and got[5] == 5 and got[6] == 6 and got[None] is None
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard.keep_one(edge_docs).select("doc_id", "shard").collect())
    assert [i for _, i in kept] == [1, 2, 3, 5, 6, 7, 9, 12, 13, 14, 15, 16, 0]
    assert jaccard.keep_one(no_docs).count() == 0


def test_licence_scan(spark, edge_docs, no_docs):
    texts = [(1, "x " * 9 + "Licensed under the Apache License, Version 2.0. y"), (2, "the apache tribe, a license to fish, version 2.0 of it"),
             (3, "CC BY? cc-by! All Rights Reserved"), (4, "This work is licensed under the GNU General Public License, version 3.\nAll rights\nreserved"),
             (5, None), (6, "This work is licensed under the GNU Lesser General Public License"), (7, "Licensed, under the Apche Apache License Version 2.0")]
    df = spark.createDataFrame(texts + [(10 + i, "the work is under a version of it by the") for i in range(30)], "doc_id long, text string")
    r = {x.doc_id: x for x in licenses.scan(df, licenses.Index(licenses.document_frequencies(df))).collect()}
    assert r[1].labels == "apache-2.0" and r[1].n_base == 0 and r[1].first_word is None and r[1].score > 0.9
    assert r[2].labels == "" and r[2].score == 0
    assert (r[3].n_base, r[3].first_word, r[3].last_word, r[3].base_labels) == (3, 0, 4, "cc-by,reserved")
    assert r[4].labels == "gpl,gpl-3.0,reserved" and r[4].n_base == 2 and r[5].n_words == 0 and r[5].labels == ""
    assert "lgpl" in r[6].labels and "gpl-3.0" not in r[6].labels and r[7].labels == "apache-2.0"
    edges = licenses.scan(edge_docs, licenses.Index(licenses.document_frequencies(edge_docs))).collect()
    assert len(edges) == len(TEXTS) and {x.base_labels for x in edges} == {"", "reserved", "cc-by"}
    assert licenses.scan(no_docs, licenses.Index(licenses.document_frequencies(no_docs))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == before.columns and docs.select("doc_id").distinct().count() == docs.count() <= before.count()
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ids and counts[4] > 0.5 * counts[0]
