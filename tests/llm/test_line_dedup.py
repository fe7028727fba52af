"""Operator 1 against all windows, place by place, with no tolerance."""

import random

import pytest

from tabforge.llm import line_dedup

from llm.fixtures import SF

RUN = line_dedup.MIN_RUN


def left(texts):
    """{id: words that no window of RUN words seen earlier covers}; texts in order."""
    seen, out = set(), {}
    for i, text in texts:
        words, gone = (text or "").split(), set()
        for k in range(len(words) - RUN + 1):
            w = tuple(words[k:k + RUN])
            if w in seen:
                gone.update(range(k, k + RUN))
            seen.add(w)
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def check(spark, texts):
    rows = line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    want = left(sorted(texts))
    assert {r.doc_id: (r.text or "").split() for r in rows} == want
    assert all(r["__n_words"] - r["__n_removed"] == len(want[r.doc_id]) for r in rows)
    return want


def prose(rnd, n, stops=True):
    return [f"w{rnd.randrange(10 ** 9)}" + ("." if stops and rnd.random() < 0.1 else "") for _ in range(n)]


def join(*parts):
    return " ".join(w for p in parts for w in p)


def planted(rnd, line_in_first, line_before):
    """Pairs of texts that share a passage of 50 to 68 words with one frequent line inside it."""
    line, texts = [*prose(rnd, 9, False), "end."], []
    if line_in_first:
        texts.append((0, join(prose(rnd, 80), line, prose(rnd, 80))))
    for k in range(60):
        side = rnd.randrange(20, 30)
        passage = [*prose(rnd, side), *line, *prose(rnd, rnd.randrange(50, 69) - side - len(line))]
        before = [*prose(rnd, 60), *line] if line_before else []
        texts += [(10 + k, join(before if k % 2 else [], prose(rnd, 70), passage, prose(rnd, 70))),
                  (100 + k, join(before, prose(rnd, 70), passage, prose(rnd, 70)))]
    return texts


def test_passage_with_a_frequent_line_that_another_text_held_first(spark):
    texts = planted(random.Random(1), True, False)
    want = check(spark, texts)
    assert all(len(want[100 + k]) == 140 for k in range(60))


def test_passage_with_a_line_that_the_text_held_before(spark):
    check(spark, planted(random.Random(2), False, True))


def test_runs_pasted_in_mid_sentence_without_sentence_marks(spark):
    rnd, texts = random.Random(3), []
    for k in range(150):
        run = prose(rnd, 50, False)
        texts += [(k, join(prose(rnd, rnd.randrange(60, 90), False), run, prose(rnd, 70, False))),
                  (1000 + k, join(prose(rnd, rnd.randrange(60, 90), False), run, prose(rnd, 70, False)))]
    want = check(spark, texts)
    assert all(len(want[1000 + k]) == len(dict(texts)[1000 + k].split()) - 50 for k in range(150))


def test_windows_of_the_table(spark, sf_texts):
    rows = line_dedup.op1_line_dedup(spark, SF).collect()
    want = left(sorted(sf_texts.items()))
    assert {r.doc_id: (r.text or "").split() for r in rows} == want


@pytest.mark.parametrize("rows", [[(None, "a"), (None, "b")], [(3, "a")] * 3])
def test_copies_of_one_document_and_null_ids(spark, rows):
    body = {c: join(prose(random.Random(c), 60)) for c in "ab"}
    got = line_dedup.dedup(spark.createDataFrame([(i, body[c]) for i, c in rows] + [(9, body["a"])], "doc_id long, text string").repartition(3)).collect()
    assert sorted(len(r.text.split()) for r in got) == [0] + [60] * len(rows)


def test_two_texts_of_one_id_and_one_32_bit_hash(spark):
    """Texts of different length that a short hash takes for one are two documents."""
    run = join(prose(random.Random(8), 60))
    many = spark.range(300_000).selectExpr("id", f"concat('{run}', repeat(' x', id % 9), ' t', id) AS t").selectExpr("id", "t", "hash(t) AS h")
    pairs = many.groupBy("h").agg({"t": "collect_list"}).where("size(`collect_list(t)`) > 1").collect()
    a, b = next((x, y) for x, y, *_ in (r[1] for r in pairs) if len(x.split()) != len(y.split()))
    rows = spark.createDataFrame([(None, a), (None, b), (7, a)], "doc_id long, text string").repartition(3)
    got = line_dedup.dedup(rows).collect()
    assert sorted(r["__n_words"] for r in got) == sorted(len(t.split()) for t in (a, b, a))
    assert sorted(r["__n_removed"] for r in got)[0] == 0 and sum(r["__n_removed"] >= 60 for r in got) == 2
