"""Cross-tokenizer alignment against plain library calls and loops over every token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as vocab
import pytest

from llm.fixtures import SCHEMA, SF
from tabforge.llm import align, bpe

A, B = vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    back = {c: b for b, c in enumerate(bpe.byte_table())}
    docs, holds = [], Counter()
    for text in texts:
        groups, links = [], Counter()
        ids_a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = sp.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in tok.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((0, 0, groups, links))
            continue
        ends_a = {sum(map(len, bytes_a[:i + 1])): i + 1 for i in range(len(ids_a))} if len(ids_a) < 2000 else _ends(bytes_a)
        ends_b = _ends(bytes_b)
        last_a = last_b = 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append((ids_a[last_a:ends_a[e]], ids_b[last_b:ends_b[e]]))
            last_a, last_b = ends_a[e], ends_b[e]
            links.update((x, y) for x in groups[-1][0] for y in groups[-1][1])
        holds.update(set(links))
        docs.append((len(ids_a), len(ids_b), groups, links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for n_a, n_b, groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if holds[p] == most[p[0]]),
                    sum(n * holds[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out, holds, most


def _ends(parts):
    at, out = 0, {}
    for i, p in enumerate(parts):
        at += len(p)
        out[at] = i + 1
    return out


def check(df, texts):
    """``texts`` by id, in any number of repeats."""
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in align.align_documents(df, A, B).collect())
    want, holds, most = plain([t for _, t in texts])
    assert got == Counter((i, *w) for (i, _), w in zip(texts, want, strict=True))
    return holds, most


def test_corpus(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    holds, most = check(df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    table = {(r.a, r.b): (r["count"], r.is_best) for r in align.translation_table(df, A, B).collect()}
    assert table == {p: (n, n == most[p[0]]) for p, n in holds.items()}


def test_edges(spark, edge_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])


def test_odd_texts(spark):
    """Blanks of every kind, line ends, marks that a vocabulary uses itself, special tokens, bytes inside characters."""
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　", "​", "▁", "a", "the", "Hello", "naïve", "日本語", "🙂🙂", "ﬁ", "①", "é",
            "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "don't", "1234567", "...", "Ж", "\x00", "ab" * 40, "<0x0A>", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    texts += [" ", "\n", "\na", "a ", " a", "a\nb", "a\n\nb", "a \nb", "▁", "x", "xx x", "<|endoftext|>", "a" * 5000, "word " * 3000]
    docs = list(enumerate(texts))
    check(spark.createDataFrame([(i, t, *"abcdefg") for i, t in docs], SCHEMA).repartition(4), docs)


@pytest.mark.parametrize("texts", [[], [None, ""], ["one"]])
def test_few_rows(spark, texts):
    docs = list(enumerate(texts))
    check(spark.createDataFrame([(i, t, *"abcdefg") for i, t in docs], SCHEMA), docs)


def test_long_compare(spark, monkeypatch):
    """Bytes are compared in parts, wherever a part ends."""
    monkeypatch.setattr(align, "COMPARE_TOKENS", 3)
    import pyarrow as pa
    made = align.Aligner(A, B)
    texts = ["one two three four five six seven", "eight ▁nine\nten one two", None, "", "one two three", "a▁b", "last one"]
    r = made.align(pa.array(texts))
    want, _, _ = plain(texts)
    assert list(zip(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], strict=True)) == [(*w[:4], w[6]) for w in want]
