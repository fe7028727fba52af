"""Token-id output as one wavelet matrix per shard (operator 10).

Documents are range-partitioned and sorted by id, encoded, closed with an end id, and cut into
shards of whole documents.  A shard is one compressed blob in the file format below and one row of
a Parquet table in the shared folder.  Bits of the ids are stored plane by plane, highest bit first; after each
plane the ids are stably parted by that bit, so access, counting and occurrence lookup need one
rank (or select) per plane and place and nothing else from the file (a frequent token's places are read off whole planes).

File format (little-endian): magic ``WVM1``; uint32 planes; uint64 tokens; then for each plane
uint64 zeros, ``ceil(n/64)`` uint64 words of bits (bit i of word i // 64 is place i) and the rank
directory, a uint64 count of ones before every 8th word.  The whole is compressed with zlib.

Null texts are empty (their end id remains); null ids sort first; rows of the same id stay together in
the order of their text.  An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.session import scratch_path

from . import bpe
from .common import documents, keyed_text, slices

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
#: Bytes of a row group of the shard files, so that a reader holds a few shards at a time.
GROUP_BYTES = 8 << 20
_BLOCK = 8  # words of 64 bits between two counts of the rank directory
#: A token with more than a place in so many is looked up by unpacking planes whole, which is then cheaper than a select a place.
SCAN_FROM = 256


class WaveletMatrix:
    """Planes of bits with rank and select; positions and ids are NumPy arrays or integers."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint32)
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        planes, left = [], ids.astype(kind)
        for level in range(bits - 1, -1, -1):
            bit = (left >> kind(level)).astype(np.uint8) & 1
            words = np.zeros(-(-len(ids) // 64), "<u8")
            words.view(np.uint8)[:(len(ids) + 7) // 8] = np.packbits(bit, bitorder="little")
            bit = bit.view(bool)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)])
            planes.append((len(ids) - int(ones[-1]), words, ones[:-1][::_BLOCK].astype("<u8")))
            left = np.concatenate([np.compress(~bit, left), np.compress(bit, left)])
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<IQ", len(self.planes), self.n)]
        for zeros, words, ranks in self.planes:
            out += [struct.pack("<Q", zeros), words.tobytes(), ranks.tobytes()]
        return zlib.compress(b"".join(out), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        raw = zlib.decompress(data)
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        count, n = struct.unpack_from("<IQ", raw, 4)
        at, planes, n_words = 16, [], -(-n // 64)
        for _ in range(count):
            zeros, = struct.unpack_from("<Q", raw, at)
            words = np.frombuffer(raw, "<u8", n_words, at + 8)
            ranks = np.frombuffer(raw, "<u8", -(-n_words // _BLOCK), at + 8 + 8 * n_words)
            at += 8 + 8 * n_words + 8 * len(ranks)
            planes.append((zeros, words, ranks))
        return cls(n, planes)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a plane."""
        _, words, ranks = self.planes[level]
        at = np.asarray(at, np.int64)
        if not len(words):
            return np.zeros_like(at)
        word, bit = at >> 6, at & 63
        block = np.minimum(word // _BLOCK, len(ranks) - 1)
        out = ranks[block].astype(np.int64)
        for k in range(_BLOCK):
            w = block * _BLOCK + k
            whole = w < word
            out += np.where(whole, np.bitwise_count(words[np.minimum(w, len(words) - 1)]), 0).astype(np.int64)
        inside = words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return out + np.where(bit > 0, np.bitwise_count(inside), 0).astype(np.int64)

    def _select(self, level: int, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero of a plane: a binary search over the rank directory, the words of one
        block, and the bits of one word."""
        _, words, ranks = self.planes[level]
        k = np.asarray(k, np.int64)
        if not len(k):
            return k

        def before(block: np.ndarray) -> np.ndarray:
            return ranks[block].astype(np.int64) if one else block * (64 * _BLOCK) - ranks[block].astype(np.int64)

        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), len(ranks), np.int64)
        for _ in range(len(ranks).bit_length()):  # the last block with at most k before it lies in [lo, hi)
            middle = (lo + hi) >> 1
            low = before(np.minimum(middle, len(ranks) - 1)) <= k
            lo, hi = np.where(low & (middle < hi), middle, lo), np.where(low, hi, middle)
        left, word = k - before(lo), lo * _BLOCK
        inside = np.ones(len(k), bool)
        for _ in range(_BLOCK - 1):
            w = words[np.minimum(word, len(words) - 1)]
            n = np.bitwise_count(w if one else ~w).astype(np.int64)
            inside &= left >= n
            left, word = np.where(inside, left - n, left), np.where(inside, word + 1, word)
        w = words[word] if one else ~words[word]
        bit = np.zeros(len(k), np.int64)
        for size in (32, 16, 8, 4, 2, 1):  # halves of the word
            n = np.bitwise_count(w >> bit.astype(np.uint64) & np.uint64((1 << size) - 1)).astype(np.int64)
            up = left >= n
            left, bit = np.where(up, left - n, left), np.where(up, bit + size, bit)
        return word * 64 + bit

    def access(self, at) -> np.ndarray:
        """The ids at some places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        ids = np.zeros(len(at), np.uint32)
        for level, (zeros, words, _) in enumerate(self.planes):
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._rank(level, at)
            at = np.where(bit, zeros + ones, at - ones)
            ids = ids << np.uint32(1) | bit.astype(np.uint32)
        return ids

    def decode(self) -> np.ndarray:
        """All ids: planes are undone from the last to the first, each a stable merge."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for power, (zeros, words, _) in enumerate(reversed(self.planes)):
            bit = np.unpackbits(words.view(np.uint8), bitorder="little", count=self.n).view(bool)
            ids[zeros:] |= kind(1 << power)
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~bit)], before[np.flatnonzero(bit)] = ids[:zeros], ids[zeros:]
            ids = before
        return ids.astype(np.uint32)

    def rank(self, token: int, at: int) -> int:
        """How often a token occurs before a place."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, at)
        return hi - lo

    def _range(self, token: int, at: int) -> tuple[int, int]:
        lo, hi = 0, at
        for level, (zeros, _, _) in enumerate(self.planes):
            ones = self._rank(level, np.array([lo, hi]))
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = int(zeros + ones[0]), int(zeros + ones[1])
            else:
                lo, hi = int(lo - ones[0]), int(hi - ones[1])
        return lo, hi

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def locate(self, token: int) -> np.ndarray:
        """All places of a token in order: select, plane by plane, from the last to the first."""
        if token >> len(self.planes):
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(token, self.n))
        for level, (zeros, _, _) in reversed(list(enumerate(self.planes))):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            at = at - zeros if one else at
            if len(at) * SCAN_FROM > self.n:
                bit = np.unpackbits(self.planes[level][1].view(np.uint8), bitorder="little", count=self.n).view(bool)
                at = np.flatnonzero(bit if one else ~bit)[at]
            else:
                at = self._select(level, at, one)
        return at


def write_shards(df: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Writes ``path/shards`` (part, seq, start_in_part, n_tokens, doc_ids, lengths, payload) and ``path/parts`` (part, base)."""
    spark = df.sparkSession
    src = keyed_text(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(vocabulary)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            keys = pa.concat_arrays([h[0] for h in held])
            ids, lengths = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            row = [[part], [seq], [start], [len(ids)]]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), x) for x in (keys, pa.array(lengths, pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64()),
                 *lists, pa.array([WaveletMatrix.build(ids).to_bytes()], pa.binary())],
                ["part", "seq", "start_in_part", "n_tokens", "doc_ids", "lengths", "payload"])

        for b in slices(batches):
            ids, offsets = enc.encode(b.column("text"))
            ids = np.insert(ids, offsets[1:], end_id)
            ends = offsets[1:] + np.arange(1, len(offsets))
            done = 0
            while done < b.num_rows:  # whole documents until the shard is full
                base = ends[done - 1] if done else 0
                stop = min(b.num_rows, int(np.searchsorted(ends, base + shard_tokens - size, side="left")) + 1)
                held.append((b.column("doc_id").slice(done, stop - done), ids[base:ends[stop - 1]], np.diff(ends[done:stop], prepend=base)))
                size += int(ends[stop - 1] - base)
                done = stop
                if size >= shard_tokens:
                    yield shard()
                    seq, start, held, size = seq + 1, start + size, [], 0
        if held:
            yield shard()

    (src.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(run, f"part int, seq int, start_in_part long, n_tokens long, doc_ids array<{kind}>, lengths array<long>, payload binary")
        .write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).parquet(f"{path}/shards"))
    # one row per partition, so one task may run over them
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base")).write.parquet(f"{path}/parts"))


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards with the place of their first token in the whole corpus; parts are as many as partitions were."""
    shards, parts = (spark.read.parquet(f"{path}/{x}") for x in ("shards", "parts"))
    return shards.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids] of every document, from the files alone."""
    shards = open_shards(spark, path).select("start", "doc_ids", "lengths", "payload")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = WaveletMatrix.from_bytes(b.column("payload")[i].as_py()).decode().astype("<u4")
                lengths = b.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                bounds = [0, *ends.tolist()]
                crc = [zlib.crc32(ids[f:t].tobytes()) for f, t in zip(bounds, bounds[1:], strict=False)]
                arrays = [b.column("doc_ids")[i].values, pa.array(ends - lengths + b.column("start")[i].as_py(), pa.int64()),
                          pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(arrays)])

    return shards.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def _per_shard(spark: SparkSession, path: str, found, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column("start").to_pylist(), b.column("payload").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"at": pa.array(found(start, WaveletMatrix.from_bytes(payload)), pa.int64())})

    return open_shards(spark, path).select("start", "payload").mapInArrow(run, schema)


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """n: occurrences of a token in the corpus."""
    return _per_shard(spark, path, lambda _, m: [m.count(token)], "at long").agg(F.coalesce(F.sum("at"), F.lit(0)).alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """at: every place of a token in the corpus."""
    return _per_shard(spark, path, lambda start, m: m.locate(token) + start, "at long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab
    path = scratch_path(spark, "wavelet")
    write_shards(documents(spark, sf_dir), path, vocab.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
