"""Cross-tokenizer alignment by white-space anchors (operator 12).

Every text is tokenised whole by a byte-level vocabulary (A, which gets a blank before the text) and a
sentence-piece vocabulary (B, which adds that blank itself).  Places where tokens of both end and the next
token of both carries the blank mark are anchors; they cut a document into windows of token ids.  The same
two id tuples always align alike, so each distinct window of a slice of documents is aligned once and looked up
by its tuples after that: its groups (cut wherever both end), its links (all A-B pairs of a group) and its digest text.

How many documents hold a link is counted per block of documents inside the task, then summed by id pair.  The
sums go back to the blocks, not to the documents: a block asks once for each of its distinct pairs, so what
is shuffled grows with blocks times their vocabulary and not with the occurrences.  The blocks are written
to the shared folder between the two passes, so a lost executor never numbers them anew.

Null and empty texts, and texts that a vocabulary does not give back byte for byte (U+2581, for one), have
no tokens: zeros and an empty digest.  Repeated rows and ids are documents of their own.  An empty table gives an
empty table.  Memory of a task grows with its largest text, beyond that it is bounded by the slice size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import scratch_path

from . import bpe
from .common import documents, gather, keyed_text, slices

#: Bytes of text in a block of documents.
BLOCK_BYTES = 2 << 20
#: Tokens whose bytes are compared with the text at once.
COMPARE_TOKENS = 200_000
#: A word before the text makes the byte-level library write the blank of the first word; its one token is dropped.
_BEFORE = "x"


class TokenBytes:
    """The bytes of every id of a vocabulary, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def differences(self, ids: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places where the bytes of the ids differ from ``data``, which is as long as they are."""
        found, at = [np.zeros(0, np.int64)], 0
        for i in range(0, len(ids), COMPARE_TOKENS):
            part = ids[i:i + COMPARE_TOKENS]
            own = self.flat[gather(self.starts[part], self.sizes[part])]
            found.append(np.flatnonzero(own != data[at:at + len(own)]) + at)
            at += len(own)
        return np.concatenate(found)


class ByteLevel:
    """Vocabulary A."""

    def __init__(self, path: str):
        back = {c: b for b, c in enumerate(bpe.byte_table())}
        vocabulary = bpe.encoder(path).tok.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            tokens[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.path, self.bytes = path, TokenBytes(tokens)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row offsets) of a blank and the text; empty texts have none."""
        full = pc.greater(pc.binary_length(texts), 0)
        ids, offsets = bpe.encoder(self.path).encode(pc.if_else(full, pc.binary_join_element_wise(_BEFORE, texts, " "), ""))
        keep = np.ones(len(ids), bool)
        keep[offsets[:-1][np.diff(offsets) > 0]] = False
        return ids[keep], offsets - np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])


class Pieces:
    """Vocabulary B.  No piece holds a blank after its first character or a line end, so texts with single
    blanks only are cut there and each distinct word is encoded once; other texts are encoded whole."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = TokenBytes(tokens)
        pieces = [self.model.id_to_piece(i) for i in range(len(tokens)) if not self.model.is_byte(i)]
        self.cuts = not any("\n" in p or ("▁" in p[1:] and p.strip("▁")) for p in pieces)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and length of each word; a word after a line end keeps the line end and loses the blank put before it."""
        found = self.model.encode(words, num_threads=1) if words else []
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        line = np.fromiter((w[:1] == "\n" for w in words), bool, len(words))
        keep = np.ones(len(ids), bool)
        keep[(np.cumsum(lengths) - lengths)[line]] = False
        return ids[keep], lengths - line

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row offsets)."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        whole[row[pc.equal(flat, "").to_numpy(zero_copy_only=False)]] = True
        if not self.cuts:
            whole[:] = True
        whole &= ~empty
        coded = flat.dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        keep = ~(whole | empty)[row]
        row, code = row[keep], code[keep]
        used = np.zeros(len(words), bool)
        used[code] = True
        ids, lengths = self._words([w for w, u in zip(words, used.tolist(), strict=True) if u])
        code = (np.cumsum(used) - 1)[code]
        if whole.any():
            at = np.flatnonzero(whole)
            found = self.model.encode(texts.take(pa.array(at)).to_pylist(), num_threads=1)
            own = np.fromiter(map(len, found), np.int64, len(found))
            row, code = np.concatenate([row, at]), np.concatenate([code, len(lengths) + np.arange(len(at))])
            ids, lengths = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.uint32, int(own.sum()))]), np.concatenate([lengths, own])
            order = np.argsort(row, kind="stable")
            row, code = row[order], code[order]
        counts = np.bincount(row, weights=lengths[code], minlength=len(texts)).astype(np.int64)
        ids = ids[gather((np.cumsum(lengths) - lengths)[code], lengths[code])] if len(code) else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(counts)])


def _compact(ids: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the ids of the rows to keep; the other rows are empty."""
    counts = np.diff(offsets)
    return ids[np.repeat(keep, counts)], np.concatenate([[0], np.cumsum(np.where(keep, counts, 0))])


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets])


def _tuples(ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A number for each id tuple between neighbouring cuts, equal for equal tuples."""
    data = pa.py_buffer(np.ascontiguousarray(ids, np.uint32))
    found = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts * 4, np.int64)), data])
    return found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(texts: pa.Array, offsets: np.ndarray, mark: str) -> pa.Array:
    """The texts between neighbouring offsets, with a mark between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), mark)


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


class Aligner:
    """Both vocabularies of one Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.shown = pa.array([str(i) for i in range(max(len(self.a.bytes.sizes), len(self.b.bytes.sizes)))], pa.string())

    def tokens(self, texts: pa.Array):
        """Ids and offsets of both vocabularies, and the bytes that they share; rows they do not give back are empty."""
        texts = pc.fill_null(texts, "")
        full = pc.greater(pc.binary_length(texts), 0)
        spaced = pc.if_else(full, pc.binary_join_element_wise("", texts, " "), "")
        data = np.frombuffer("".join(spaced.to_pylist()).encode(), np.uint8)
        sizes = pc.binary_length(spaced).to_numpy().astype(np.int64)
        sides, good = [], full.to_numpy(zero_copy_only=False)
        for side in (self.a, self.b):
            ids, offsets = side.encode(texts)
            size = _row_sums(side.bytes.sizes[ids], offsets)
            good = good & (size == sizes)
            sides.append((ids, offsets))
        for k, side in enumerate((self.a, self.b)):
            ids, offsets = _compact(*sides[k], good)
            wrong = side.bytes.differences(ids, data[np.repeat(good, sizes)])
            if len(wrong):
                rows = np.flatnonzero(good)
                good = good.copy()
                good[rows[np.searchsorted(np.cumsum(sizes[rows]), wrong, side="right")]] = False
        sides = [_compact(*s, good) for s in sides]
        return sides, data[np.repeat(good, sizes)], np.where(good, sizes, 0)

    def align(self, texts: pa.Array) -> dict:
        """Per row: token, group and link counts, digest; per distinct link of each row its occurrences; the distinct links."""
        ((ids_a, off_a), (ids_b, off_b)), data, sizes = self.tokens(texts)
        n, total = len(texts), len(data)
        both = np.zeros(total + 1, np.uint8)
        ends_a, ends_b = np.cumsum(self.a.bytes.sizes[ids_a]), np.cumsum(self.b.bytes.sizes[ids_b])
        both[ends_a] = 1
        both[ends_b] += 2
        cut = both == 3
        shared = np.concatenate([[0], np.flatnonzero(cut)]) if total else np.zeros(1, np.int64)  # group g lies between shared[g] and shared[g + 1]
        cut[:-1] &= data == 0x20
        row_ends = np.cumsum(sizes)
        cut[0] = True
        cut[row_ends] = True
        cuts = np.flatnonzero(cut)
        group_a, group_b = (np.searchsorted(e, shared, side="right") for e in (ends_a, ends_b))  # tokens before each group
        window = np.searchsorted(shared, cuts)  # groups before each window
        code_b = _tuples(ids_b, group_b[window])
        _, at, kind = np.unique(_tuples(ids_a, group_a[window]) * (code_b.max(initial=0) + 1) + code_b, return_index=True, return_inverse=True)
        # the distinct windows, aligned where they stand first
        groups = np.diff(window)[at]
        g = gather(window[at], groups)
        n_a, n_b = np.diff(group_a)[g], np.diff(group_b)[g]
        first_a, first_b, links_of = group_a[g], group_b[g], n_a * n_b
        step = gather(np.zeros(len(g), np.int64), links_of)
        wide = np.repeat(n_b, links_of)
        flat = (ids_a[np.repeat(first_a, links_of) + step // wide].astype(np.int64) << 32) | ids_b[np.repeat(first_b, links_of) + step % wide]
        links = np.diff(_ends(links_of)[_ends(groups)])
        sides = [_joined(self.shown.take(pa.array(ids[gather(f, m)])), _ends(m), ",") for ids, f, m in ((ids_a, first_a, n_a), (ids_b, first_b, n_b))]
        shown = _joined(pc.binary_join_element_wise(*sides, "|"), _ends(groups), ";")
        first = np.concatenate([[0], np.searchsorted(cuts, row_ends)])  # windows before each row
        row, n_kinds = np.repeat(np.arange(n), np.diff(first)), max(len(at), 1)
        sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in _joined(shown.take(pa.array(kind)), first, ";").to_pylist()]
        pairs, place = np.unique(flat, return_inverse=True)
        held, times = np.unique(row * n_kinds + kind, return_counts=True)  # distinct windows of each row
        held_kind, held_row = held % n_kinds, held // n_kinds
        which = place[gather((np.cumsum(links) - links)[held_kind], links[held_kind])] if len(held) else np.zeros(0, np.int64)
        key, inverse = np.unique(np.repeat(held_row, links[held_kind]) * max(len(pairs), 1) + which, return_inverse=True)
        occurs = np.bincount(inverse, weights=np.repeat(times, links[held_kind]), minlength=len(key)).astype(np.int64)
        which = key % max(len(pairs), 1)
        return {"n_a": np.diff(off_a), "n_b": np.diff(off_b), "n_groups": _row_sums(groups[kind], first), "n_links": _row_sums(links[kind], first),
                "groups_sha256": sha, "which": which, "occurs": occurs, "offsets": np.searchsorted(key, np.arange(n + 1) * max(len(pairs), 1)),
                "pairs": pairs, "docs": np.bincount(which, minlength=len(pairs))}


_MADE: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _MADE:
        _MADE[path_a, path_b] = Aligner(path_a, path_b)
    return _MADE[path_a, path_b]


def _blocks(src: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its links as numbers in its block's list, and one row per block with that list."""
    kind = src.schema["doc_id"].dataType.simpleString()
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = ("block long, doc_id " + kind + "".join(f", {c} long" for c in counts) +
              ", groups_sha256 string, which array<int>, occurs array<int>, pairs array<long>, docs array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(path_a, path_b)
        for number, b in enumerate(slices(batches, size=BLOCK_BYTES)):
            block = (TaskContext.get().partitionId() << 32) + number
            r = made.align(b.column("text"))
            n = b.num_rows + 1  # the last row is the block's
            offsets = pa.array(np.append(r["offsets"], r["offsets"][-1]), pa.int32())
            own = pa.array([0] * n + [len(r["pairs"])], pa.int32())
            none = np.append(np.ones(n - 1, bool), False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block), pa.int64()), pa.concat_arrays([b.column("doc_id"), pa.nulls(1, b.column("doc_id").type)]),
                 *[pa.array(np.append(r[c], 0), pa.int64()) for c in counts], pa.array([*r["groups_sha256"], None], pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(r["which"], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(r["occurs"], pa.int32())),
                 pa.ListArray.from_arrays(own, pa.array(r["pairs"], pa.int64()), mask=pa.array(none)),
                 pa.ListArray.from_arrays(own, pa.array(r["docs"], pa.int32()), mask=pa.array(none))],
                ["block", "doc_id", *counts, "groups_sha256", "which", "occurs", "pairs", "docs"])

    return src.mapInArrow(run, schema)


def _shares(blocks: DataFrame) -> DataFrame:
    """block, at, pair, docs: how many documents of the block hold each of its links."""
    return (blocks.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "s"))
            .select("block", "at", F.col("s.pairs").alias("pair"), F.col("s.docs").alias("docs")))


def _counts(shares: DataFrame) -> DataFrame:
    """pair, count, is_best: documents that hold the link, and whether no link of its A id has more."""
    counts = shares.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftrightunsigned("pair", 32))
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def translation_table(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, count, is_best: every linked id pair with the number of documents that hold it."""
    shares = _shares(_blocks(keyed_text(df, id_col, text_col), path_a, path_b))
    return _counts(shares).select(F.shiftrightunsigned("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "count", "is_best")


def _score(documents: pa.Table, shares: pa.Table) -> pa.Table:
    """The documents of one block, with the sums over their links."""
    order = np.argsort(shares.column("at").to_numpy())
    count = shares.column("count").to_numpy()[order]
    best = shares.column("is_best").to_numpy()[order].astype(np.int64)
    lists = documents.column("which").combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    which, occurs = lists.values.to_numpy(), documents.column("occurs").combine_chunks().values.to_numpy().astype(np.int64)
    return (documents.drop_columns(["block", "which", "occurs"])
            .append_column("n_best", pa.array(_row_sums(occurs * best[which], offsets), pa.int64()))
            .append_column("count_sum", pa.array(_row_sums(occurs * count[which], offsets), pa.int64())))


def align_documents(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    spark = df.sparkSession
    blocks = _blocks(keyed_text(df, id_col, text_col), path_a, path_b)
    path = scratch_path(spark, "align-blocks")
    blocks.write.parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    shares = _shares(blocks)
    asked = shares.join(_counts(shares), "pair").select(F.col("block").alias("asked_by"), "at", "count", "is_best")
    rows = blocks.where(F.col("pairs").isNull()).drop("pairs", "docs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("block", "which", "occurs"))
    return rows.groupBy("block").cogroup(asked.groupBy("asked_by")).applyInArrow(_score, schema + ", n_best long, count_sum long")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab
    return align_documents(documents(spark, sf_dir), vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model"))
