"""Spelling variants against a brute-force search."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm.fixtures import SCHEMA, SF
from tabforge.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)  # deletions and one-gap patterns of every word
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
            gaps[w[:i], w[i + 1:]].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def run(df):
    rows = variants.group_variants(df).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_corpus(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got, want = run(df), plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert got == want
    assert any(v[3] for v in want.values())


def test_edges(spark, edge_docs):
    assert run(edge_docs) == plain([(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])


def test_chains_and_odd_words(spark):
    """Chains of forms, every kind of edit at every place, repeated letters, Latin-1 letters and very long words."""
    base, long = "colours", "abcdefghij" * 300
    words = [base] * 400 + ["coloura", "xolours"] * 30 + ["colourab"] * 2
    for i in range(len(base) + 1):
        words += [base[:i] + "z" + base[i:]] * 3 + ["aaaaaaa" + "a" * i] * 2
    for i in range(len(base)):
        words += [base[:i] + "q" + base[i + 1:]] * 2
    words += [long] * 50 + [long[:1500] + long[1501:]] * 2 + [long + "é"] * 2 + ["x" + long[1:]] * 2 + ["Éclairées", "éclairées", "Éclairées", "éclairées"]
    docs = [(i, w) for i, w in enumerate(words)]
    df = spark.createDataFrame([(i, t, *"abcdefg") for i, t in docs], SCHEMA)
    got = run(df)
    assert got == plain(docs)
    assert got["colourab"][:2] == ("coloura", "colours")


@pytest.mark.parametrize("texts", [[], [None, "", "short words"], ["onlyword onlyword"]])
def test_few_words(spark, texts):
    docs = list(enumerate(texts))
    assert run(spark.createDataFrame([(i, t, *"abcdefg") for i, t in docs], SCHEMA)) == plain(docs)
