"""Best-fit packing of token sequences with Martello-Toth dominance reduction (operator 4).

A packing instance is fully described by how many pieces there are of each length, at most
``capacity`` numbers however large the corpus.  The plan is therefore made on that histogram:
first the reduction fixes bins that provably dominate every alternative (a length with nothing
that fits beside it; two lengths that fill a bin exactly; a length beside which only one more, or
at most two more, can fit and the best choice covers all others), all copies of a bin at once;
then best-fit-decreasing places what is left, again many equal bins at a time.  Pieces find their
place from (length, rank among equal lengths): ranks come from windows over (length, hash bucket)
plus running counts of the buckets, so a length that a third of all pieces share is spread over
many tasks.

A null text is an empty one and packs as the end id alone.  Repeated rows and ids are packed each
on its own; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.session import scratch_path

from . import bpe
from .common import SMALL_SLICE_BYTES, documents, keyed_text, slices

CAPACITY = 2048
PIECES_PER_BUCKET = 200_000


def cut(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
        text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each encoded document (its ids, then the end id): doc_id, piece, start, length, ids_crc32[, ids]."""
    src = keyed_text(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path, spaces=False)
        for b in slices(batches, size=SMALL_SLICE_BYTES):
            ids, offsets = enc.encode(b.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            sizes = np.diff(offsets)
            n_pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(b.num_rows), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            first = offsets[:-1][row] + start
            crc = [zlib.crc32(ids[f:f + n].tobytes()) for f, n in zip(first.tolist(), length.tolist(), strict=True)]
            arrays = [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                # pieces follow one another without gaps, so their bounds are offsets into the ids
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return src.mapInArrow(run, schema)


class Histogram:
    """Counts per length with ordered access to the lengths still present."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            del self.keys[bisect_left(self.keys, length)]

    def largest_upto(self, limit: int, without: dict[int, int]) -> int | None:
        """The largest length <= limit that is left after setting ``without`` aside."""
        i = bisect_left(self.keys, limit + 1) - 1
        while i >= 0:
            if self.n[self.keys[i]] > without.get(self.keys[i], 0):
                return self.keys[i]
            i -= 1
        return None

    def smallest(self, k: int, without: dict[int, int]) -> list[int]:
        out: list[int] = []
        for key in self.keys:
            out += [key] * min(k - len(out), self.n[key] - without.get(key, 0))
            if len(out) == k:
                break
        return out


def dominating(h: Histogram, w: int, capacity: int) -> list[int] | None:
    """A bin with a piece of length ``w`` that dominates every other feasible bin with that piece, if found.

    One bin dominates another if the other's pieces can be split among the pieces of the first so that
    each group is no longer than the piece it is given to."""
    room = capacity - w
    small = h.smallest(3, {w: 1})
    if not small or small[0] > room:
        return [w]
    a = h.largest_upto(room, {w: 1})
    if a == room or len(small) < 2 or small[0] + small[1] > room:
        return [w, a]
    if len(small) == 3 and sum(small) <= room:
        return None  # three more can fit: no small certificate
    # at most two more fit: the best pair (x, y <= x), against a alone
    best, second = 0, 0
    for x in h.keys:
        if x > room:
            break
        if h.n[x] - (x == w) < 1:
            continue
        y = h.largest_upto(min(x, room - x), {w: 1, x: 1} if x != w else {w: 2})
        if y is None:
            continue
        best = max(best, x + y)
        if x + y > a:
            second = max(second, y)
    if best <= a:
        return [w, a]
    b = h.largest_upto(room - a, {w: 1, a: 1} if a != w else {w: 2})
    if b is not None and b >= second:
        return [w, a, b]
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[tuple[int, int]], int]], dict[int, int]]:
    """Bins fixed by dominance as ((length, times) pairs, copies), and the counts that remain."""
    h = Histogram(counts)
    fixed: list[tuple[list[tuple[int, int]], int]] = []
    changed = True
    while changed and h.keys:
        changed = False
        for w in sorted(h.keys, reverse=True):
            while h.n.get(w, 0):
                found = dominating(h, w, capacity)
                if found is None:
                    break
                uses = [(k, len(list(g))) for k, g in groupby(sorted(found, reverse=True))]
                # taking the same bin again keeps its certificate: what is left only gets larger or fewer
                copies = min(h.n[k] // t for k, t in uses)
                for k, t in uses:
                    h.take(k, copies * t)
                fixed.append((uses, copies))
                changed = True
    return fixed, dict(h.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit-decreasing over counts: open bins are kept in groups of equal content, by room left."""
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    closed = []
    for w in sorted(counts, reverse=True):
        left = counts[w]
        for room in sorted(r for r in rooms if r >= w):
            groups = rooms.pop(room)
            while groups and left:
                content, copies = groups.pop()
                times = room // w  # a bin just served is the tightest fit for the next equal piece
                full = min(copies, left // times)
                if full:
                    rooms.setdefault(room - times * w, []).append(([*content, (w, times)], full))
                left -= full * times
                copies -= full
                if copies and left:  # fewer pieces than one more bin can take
                    rooms.setdefault(room - left * w, []).append(([*content, (w, left)], 1))
                    copies, left = copies - 1, 0
                if copies:
                    groups.append((content, copies))
            if groups:
                rooms.setdefault(room, []).extend(groups)
            if not left:
                break
        if left:
            times = capacity // w
            if left // times:
                rooms.setdefault(capacity - times * w, []).append(([(w, times)], left // times))
            if left % times:
                rooms.setdefault(capacity - (left % times) * w, []).append(([(w, left % times)], 1))
        closed += rooms.pop(0, [])
    return closed + [g for groups in rooms.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, one past the last rank, first sequence, pieces per sequence, first offset)."""
    fixed, rest = reduce(counts, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, copies in fixed + best_fit(rest, capacity):
        at = 0
        for length, times in content:
            lo = used.get(length, 0)
            rows.append((length, lo, lo + copies * times, sequence, times, at))
            used[length] = lo + copies * times
            at += length * times
        sequence += copies
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, start, length, ids_crc32 (a written table)."""
    spark = pieces.sparkSession
    totals = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    n = sum(totals.values())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PIECES_PER_BUCKET)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (bucketed.groupBy("length", "bucket").agg(F.count("*").alias("m"))
              .withColumn("before", F.coalesce(F.sum("m").over(running), F.lit(0))).drop("m"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (bucketed.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])
              .select(*pieces.columns, (F.col("rank") + F.col("before")).cast("long").alias("rank")))
    rows = np.array(sorted(plan(totals, capacity)), np.int64).reshape(-1, 6)  # a few rows per length
    key = rows[:, 0] << 40 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = rows[np.searchsorted(key, length << 40 | rank, side="right") - 1] if b.num_rows else rows[:0]
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(at[:, 3] + k // np.maximum(at[:, 4], 1), pa.int64()),
                 pa.array(at[:, 5] + k % np.maximum(at[:, 4], 1) * length, pa.int64())],
                [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes once into a written table, then plans and places."""
    spark = df.sparkSession
    place = scratch_path(spark, "pieces")
    cut(df, path, capacity, 0, id_col, text_col, with_ids).write.parquet(place)
    return pack(spark.read.parquet(place), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab
    return pack_documents(documents(spark, sf_dir), vocab.path("word_bpe_49k.json"))
