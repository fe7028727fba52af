"""The pipeline against plain Python versions of its stages on planted documents; model scores are taken as given."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tabforge.llm import packing, quality, toxicity

from llm.test_line_dedup import RUN
from llm.test_texts import brute_components, sets_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentences(rnd, n, extra=()):
    """A text of n words in lines of ten, each a sentence."""
    w = [f"{rnd.choice(['ba', 'de', 'mi', 'so', 'tu'])}{rnd.choice(['rel', 'nat', 'kop'])}{''.join(rnd.choice('aeioulmnrst') for _ in range(6))}" for _ in range(n)]
    for k, x in enumerate(extra):
        w[7 + 10 * k] = x
    return "\n".join(" ".join(w[i:i + 10]) + "." for i in range(0, n, 10))


def planted():
    rnd, docs, toxic = random.Random(7), [], {}

    def add(text, label=None):
        docs.append((len(docs), text, "en", "s", len(text or "")))
        if label is not None:
            toxic[docs[-1][0]] = label

    for k in range(60):
        add(sentences(rnd, 60, ["vilescum", "hatefilth", "loathing"]), 1)
        add(sentences(rnd, 60), 0)
    passage = sentences(rnd, 60)
    for k in range(8):
        add(sentences(rnd, 50) + "\n" + passage + "\n" + sentences(rnd, 40))                       # a passage to cut
        add("Home | About | Contact | Help\n" + sentences(rnd, 70) + "\nWe use a cookie policy here")   # lines to remove
        add(sentences(rnd, 15))                                                                    # too short
        add("\n".join(["the same words over and over again until the end."] * 8))                  # repeats
        base = sentences(rnd, 79).split()
        add(" ".join(base))
        add(" ".join([*base[:39], f"edit{k}.", *base[40:]]))                                       # a near copy without a run of 40
    copy = sentences(rnd, 90)
    for text in (copy, copy, None, "", " \n "):                                                    # a copy goes whole; nothing to keep
        add(text)
    add(sentences(rnd, 6000))                                                                      # several pieces
    return docs, toxic


def clean(text):
    """The text without its bad lines, or None if the document goes."""
    words = WORD.findall(text or "")
    count = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if count[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
        return None
    kept, lost = [], 0
    for line in text.split("\n"):
        n, kinds = len(WORD.findall(line)), [unicodedata.category(c) for c in line]
        bad = n > 0 and (len(re.findall(quality.SEPARATOR, line)) * 5 >= n or len(re.findall(quality.SYMBOLS, line)) * 10 >= len(line)
                         or n >= 5 and (line.count("!!") * 5 >= n or kinds.count("Lu") * 10 >= 6 * sum(k[0] == "L" for k in kinds))
                         or n > quality.HEADING_WORDS and not re.search(quality.SENTENCE_MARK, line) or re.search(quality.BOILERPLATE, line))
        lost += n if bad else 0
        kept += [] if bad else [line]
    return "\n".join(kept) if 100 * lost <= 50 * len(words) else None


def without_repeats(docs):
    """{id: text without the words of windows seen earlier}; documents cut whole go."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        spans, gone = [m.span() for m in WORD.finditer(text)], set()
        words = [text[a:b] for a, b in spans]
        for k in range(len(words) - RUN + 1):
            w = tuple(words[k:k + RUN])
            if w in seen:
                gone.update(range(k, k + RUN))
            seen.add(w)
        if len(gone) < len(words) or not gone:
            left, cut = [k for k in range(len(words)) if k not in gone], ""
            for a, b in zip([None, *left], left):
                gap = "" if a is None else text[spans[a][1]:spans[b][0]]
                cut += (gap if a is None or b == a + 1 else "\n" if "\n" in gap else " ") + words[b]
            out[i] = cut if gone else text
    return out


def test_every_stage_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers as vocab
    docs, toxic = planted()
    sf, ids = str(tmp_path), {d[0]: d[1] for d in docs}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    one = {i: t for i, t in ids.items() if model.score([t or ""])[0] < 0.5}
    assert not {i for i, t in toxic.items() if t} & set(one) and {i for i in ids if toxic.get(i) != 1} == set(one)
    two = {i: c for i, t in one.items() if (c := clean(t)) is not None}
    three = without_repeats(two)
    label = brute_components(sets_of(three.items()))
    four = {i: t for i, t in three.items() if label[i] == i}
    assert len(one) > len(two) > len(three) > len(four) and any(two[i] != one[i] for i in two) and any(three[i] != two[i] for i in three)
    for (name, stage), want in zip(corpus_pipeline.STAGES, [one, two, three, four]):
        stage(spark, table, sf).write.parquet(f"{sf}/{name}")
        table = spark.read.parquet(f"{sf}/{name}")
        rows = table.collect()
        assert len(rows) == len(want) and {r.doc_id: r.text for r in rows} == want, name
        assert all((r.lang, r.source) == ("en", "s") and r.n_chars == len(r.text or "") for r in rows)
    tok, pieces = Tokenizer.from_file(vocab.path("word_bpe_49k.json")), []
    for i, t in four.items():
        x = [*tok.encode(t, add_special_tokens=False).ids, 0]
        pieces += [(i, k, a, len(x[a:a + packing.CAPACITY]), zlib.crc32(np.array(x[a:a + packing.CAPACITY], "<u4").tobytes()))
                   for k, a in enumerate(range(0, len(x), packing.CAPACITY))]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(pieces) and max(p[1] for p in pieces) > 1
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
