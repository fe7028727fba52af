"""Operators 2, 3, 4 and 10: sharding, byte BPE, packing, wavelet shards."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocab
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tabforge.llm import bpe, byte_bpe, common, packing, sharding, wavelet
from tabforge.session import scratch_path

from llm.fixtures import TEXTS

RANKS, WORDS, BYTES = (vocab.path(x) for x in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_column_encoder_equals_the_libraries_on_odd_text():
    rng = random.Random(3)
    texts = ["", " a", "a ", "a  b\n\nc", "\n", "x\n", "\tq \n y", "don't we'll", "<|endoftext|>", "a \x01 b\x01", "\x01"]
    # letters with marks after them: cut short, cut long, upper case of other lengths, composed and loose accents
    texts += ["Word, WORD. word?! word..... word'. x_y_ ab12, abc<|endoftext|>, <|endoftext|>.", "İstanbul. Жук, Σας. ǰ, J̌. á. é, ŉ. Ǆ, ſo. Å.",
              "it's.'s (foo) foo-bar; naïve; ÀÉ.\nÀÉ.\n."]
    texts += ["".join(rng.choice("ab \n\t'sé1.,日🙂́ AZ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for path, spaces, pattern in ((BYTES, True, None), (WORDS, False, None), (RANKS, True, vocab.PATTERN)):
        ids, at = bpe.encoder(path, spaces, pattern).encode(pa.array([*texts, None]))
        if pattern:
            enc = reference()
            want = [enc.encode_ordinary(t) for t in texts]
        else:
            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [*want, []]


def test_the_library_gets_few_pieces_at_once():
    """What it returns takes far more room than the ids, so it never holds a whole slice's pieces."""
    class Counting:
        sizes = []

        def __init__(self, tok):
            self.tok = tok

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, texts, **how):
            self.sizes.append(len(texts))
            return self.tok.encode_batch_fast(texts, **how)

    path = vocab.path("word_bpe_49k.json")
    text = " ".join(f"{i}x{i}" for i in range(3 * bpe.AT_ONCE))
    counting = Counting(Tokenizer.from_file(path))
    ids, offsets = bpe.ColumnEncoder(counting, spaces=False).encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids and offsets.tolist() == [0, len(ids)]
    assert max(Counting.sizes) <= bpe.AT_ONCE < sum(Counting.sizes)


def test_slices_give_freed_memory_back(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "c", None, "defg", "h"])], ["text"])
    found = [s.column("text").to_pylist() for s in common.slices(iter([batch]), size=3)]
    assert found == [["ab", "c", None], ["defg"], ["h"]] and pool.released == 3


def test_byte_bpe_round_trip_and_offsets(edge_docs, no_docs):
    enc = reference()
    rows = byte_bpe.digests(edge_docs, RANKS, vocab.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = byte_bpe.encode(edge_docs, RANKS, vocab.PATTERN, with_offsets=True)
    back = {r.doc_id: r.text for r in byte_bpe.decode(full, RANKS).collect()}
    texts = {i: t or "" for i, t in TEXTS}
    assert back == texts
    r = full.where("doc_id = 14").first()
    pieces = [texts[14][a:b] for a, b in zip(r.starts, r.ends)]
    assert all(p.encode().find(enc.decode_single_token_bytes(t)) >= 0 for p, t in zip(pieces, r.ids))
    assert byte_bpe.digests(no_docs, RANKS, vocab.PATTERN).count() == 0


def test_sharding_balances_bytes_and_rebalances_by_editing(spark, edge_docs, no_docs):
    records = sharding.sized(edge_docs)
    first = sharding.build_map(spark, sharding.slot_bytes(records), 4)
    rows = sharding.place(records, first).collect()
    assert len(rows) == len(TEXTS)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    path = scratch_path(spark, "maps")
    sharding.save_map(first, path)
    sharding.save_map(sharding.rebalance(spark, first, 5), path)
    old, new = ({r.vslot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, None))
    assert len(new) == sharding.N_SLOTS and set(new.values()) <= set(range(5)) and sum(old[v] != new[v] for v in old) < len(old)
    assert sharding.place(sharding.sized(no_docs), first).count() == 0


def test_sharding_of_the_corpus_is_near_equal(spark):
    from llm.fixtures import SF
    sums = [r["b"] for r in sharding.op2_sharding(spark, SF).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sums) == 16 and max(sums) < 1.3 * min(sums)


def exact_bins(counts, capacity):
    """Least number of bins, by search."""
    items = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(x for x in rooms if x >= items[i])):
            left = list(rooms)
            left.remove(r)
            go(i + 1, [*left, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_bin_and_plan_is_complete():
    rng = random.Random(5)
    for _ in range(60):
        counts = {}
        for _ in range(rng.randint(1, 9)):
            k = rng.randint(1, 20)
            counts[k] = counts.get(k, 0) + 1
        fixed, rest = packing.reduce(counts, 20)
        used = dict(rest)
        for content, copies in fixed:
            assert sum(k * t for k, t in content) <= 20
            for k, t in content:
                used[k] = used.get(k, 0) + t * copies
        assert {k: v for k, v in used.items() if v} == counts
        assert sum(c for _, c in fixed) + exact_bins(rest, 20) == exact_bins(counts, 20)
        rows = packing.plan(counts, 20)
        assert sorted((k, lo) for k, lo, *_ in rows) == sorted(set((k, lo) for k, lo, *_ in rows))
        assert {k: max(r[2] for r in rows if r[0] == k) for k in counts} == counts


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_places_every_piece_once(edge_docs, no_docs, capacity):
    rows = packing.pack_documents(edge_docs, WORDS, capacity).collect()
    tok = Tokenizer.from_file(WORDS)
    want = []
    for i, t in TEXTS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i or -1, p, s, zlib.crc32(ids[s:s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.ids_crc32) for r in rows) == sorted(want)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // capacity) + 1
    assert packing.pack_documents(no_docs, WORDS, capacity).count() == 0


def test_wavelet_matrix_against_plain_arrays():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (63, 5), (1000, 300), (5000, 50257)):
        ids = rng.integers(0, top, n)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert m.decode().tolist() == ids.tolist()
        if n:
            assert m.access(np.arange(n)).tolist() == ids.tolist()
        for t in [0, top - 1, top + 70000, *ids[:5].tolist()]:
            assert m.locate(t).tolist() == np.flatnonzero(ids == t).tolist() and m.count(t) == (ids == t).sum()
            assert all(m.rank(t, k) == (ids[:k] == t).sum() for k in {0, n // 2, n})


def test_token_files_round_trip(spark, edge_docs, no_docs):
    path = scratch_path(spark, "shards")
    wavelet.write_shards(edge_docs, path, BYTES, shard_tokens=3000, partitions=3)
    rows = sorted(wavelet.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(BYTES)
    want = sorted((i if i is not None else -1, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in TEXTS)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in rows) == want
    assert [r.doc_id if r.doc_id is not None else -1 for r in rows] == [i for i, _ in want]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    flat = [t for r in rows for t in r.ids]
    token = flat[len(flat) // 2]
    assert wavelet.count_token(spark, path, token).first().n == flat.count(token)
    assert sorted(r["at"] for r in wavelet.find_token(spark, path, token).collect()) == [i for i, t in enumerate(flat) if t == token]
    empty = scratch_path(spark, "shards")
    wavelet.write_shards(no_docs, empty, BYTES)
    assert wavelet.read_documents(spark, empty).count() == 0
