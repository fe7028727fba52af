"""Line dedup by winnowing (operator 1).

A run is cut when its ``MIN_RUN`` words (or more) also stand at an earlier place: earlier by id, then text hash, then
position, in the same text or another.  The result is exactly the words of all such windows, in two steps.

1. *Winnowing.*  Of the ``GRAM_WORDS``-word grams of every window of ``MIN_RUN`` words those of least hash are
   fingerprints (all of them if tied).  They are chosen by the words of the window alone, so two copies of a window have
   the same ones, wherever they start and whatever stands around them.  A fingerprint that has no second place cannot
   lie in a repeated window; what is left are the windows near a shared fingerprint.  Whose place it is does not matter here.
2. *Windows.*  The hash of each window left is dealt out by hash in packed blocks, once a block of texts, and meets the
   same window of all other texts; all places but the first are cut.  No place is compared with a chosen partner, so a
   frequent line in a passage cannot hide the passage, and a window repeated a thousand times in a text is sent once.

Window hashes have 64 bits.  Documents are identified by id and a 128-bit digest of the text: rows that repeat both are one document and are treated alike.  Null
and empty texts have no words and stay as they are.  Null ids sort first.  Other columns pass through ``dedup``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import scratch_path

from .common import documents, gather, hash_strings, keyed_text, mix, row_of, slices, split_words

GRAM_WORDS = 8
MIN_RUN = 40
#: Grams of a window.
_GRAMS = MIN_RUN - GRAM_WORDS + 1
#: Windows that make one bucket of the second step, about.
BUCKET_WINDOWS = 1 << 19
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _ranges(code: np.ndarray, words: pa.Array, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the ranges of ``size`` words from every start (default: all there are), whatever text they lie in."""
    n = len(code)
    starts = np.arange(max(0, n - size + 1)) if starts is None else starts
    # sum h * r^i from prefix sums, shifted back by r^-start
    power = np.cumprod(np.full(n, _ODD, np.uint64))
    back = np.cumprod(np.full(n, _ODD_INVERSE, np.uint64))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(hash_strings(words))[code] * power, dtype=np.uint64)])
    return mix((prefix[starts + size] - prefix[starts]) * back[starts])


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best of x[i:i + size] for every full window."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first word) of every fingerprint of each text."""
    code, at, words = split_words(texts)
    if len(code) < MIN_RUN:
        none = np.zeros(0, np.int64)
        return none, none, none
    row, gram = row_of(at), _ranges(code, words, GRAM_WORDS)
    least = _sliding(gram, _GRAMS, np.minimum)
    least[np.arange(len(least)) + MIN_RUN > at[row[:len(least)] + 1]] = 0  # windows over the end of a text
    # a gram is chosen if it is the least of any of the windows that hold it
    edge = np.zeros(_GRAMS - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), _GRAMS, np.maximum)
    chosen = np.flatnonzero((most >= gram) & (most > 0))
    return row[chosen], gram[chosen].view(np.int64), chosen - at[row[chosen]]


def windows(texts: pa.Array, place: np.ndarray, seeds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the text, first word) of the windows that hold a seed gram or adjoin one that does, by place and word."""
    code, at, words = split_words(texts)
    row = row_of(seeds.offsets.to_numpy().astype(np.int64))
    seed = seeds.flatten().to_numpy().astype(np.int64) + at[row]
    near = np.zeros(len(code) + 1, np.int32)
    np.add.at(near, np.maximum(seed - _GRAMS + 1, at[row]), 1)
    np.add.at(near, np.minimum(seed + MIN_RUN, at[row + 1]), -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(near[:-1]) > 0)])
    start = np.arange(max(0, len(code) - MIN_RUN + 1))
    row = row_of(at)[:len(start)]
    start = start[(inside[start + MIN_RUN] - inside[start] == MIN_RUN) & (start + MIN_RUN <= at[row + 1])]
    bounds = np.searchsorted(start, at)
    order = np.argsort(place, kind="stable")
    start = start[gather(bounds[:-1][order], np.diff(bounds)[order])]
    row = row_of(at)[start]
    return _ranges(code, words, MIN_RUN, start), place[row], start - at[row]


def _later(h: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in order of place and word: which have the same hash as an earlier one, and which are the first of their hash."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    first = np.empty(len(h), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else order
    own = np.zeros(len(h), bool)
    own[order[new]] = True
    return (place != place[first]) | (at != at[first]), own


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.diff(x, prepend=0).astype("<i8").tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), "<i8"))


def _identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.md5(F.col(f"`{text_col}`")), F.lit("")).alias("h")).alias("doc"),
                     F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("rest"))


def _seeds(docs: DataFrame, path: str) -> DataFrame:
    """doc, place (a number in the order of documents) and seeds (places of shared fingerprints) of texts that have any."""
    spark = docs.sparkSession
    kind = docs.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, fp, at = fingerprints(b.column("text"))
            order = np.lexsort((at, fp, row))
            row, fp, at = row[order], fp[order], at[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (fp[1:] != fp[:-1])
            # a line repeated a thousand times in a text is one row
            first = np.flatnonzero(new)
            ats = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row[first])), pa.array(fp[first], pa.int64()), ats], ["doc", "fp", "ats"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(np.arange(at, at + b.num_rows)), b.column("seeds")], ["doc", "place", "seeds"])
            at += b.num_rows

    docs.select("doc", "text").mapInArrow(find, f"doc {kind}, fp long, ats array<int>").write.parquet(f"{path}/prints")
    prints = spark.read.parquet(f"{path}/prints")
    shared = prints.groupBy("fp").agg(F.sum(F.size("ats")).alias("n")).where("n > 1").select("fp")
    (prints.join(shared, "fp").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("seeds"))
     .repartitionByRange(F.col("doc.id").asc_nulls_first(), F.col("doc.h")).sortWithinPartitions(F.col("doc.id").asc_nulls_first(), F.col("doc.h"))
     .mapInArrow(number, f"doc {kind}, place long, seeds array<int>").write.parquet(f"{path}/seeds"))
    return spark.read.parquet(f"{path}/seeds")


def _repeats(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """place, lo, hi: the repeated runs of each text, merged, as lists."""
    total = seeds.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bits = int(min(20, max(4, np.ceil(np.log2(max(1, total * _GRAMS / 2) / BUCKET_WINDOWS)))))
    message = "bucket int, block long, hash binary, place binary, at binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches)):
            block = part << 32 | k
            h, place, at = windows(b.column("text"), b.column("place").to_numpy(), b.column("seeds"))
            later, own = _later(h, place, at)
            out = [(block % (1 << bits), None, _pack(place[later]), _pack(at[later]))]  # known here; the others meet their like
            h, place, at = h[own], place[own], at[own]
            bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            for x, i in zip(used.tolist(), np.split(order, first[1:]), strict=False):
                out.append((x, h[i].astype("<u8").tobytes(), _pack(place[i]), _pack(at[i])))
            x, h, place, at = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array([block] * len(out), pa.int64()),
                                              *(pa.array(c, pa.binary()) for c in (h, place, at))], ["bucket", "block", "hash", "place", "at"])

    def meet(t: pa.Table) -> pa.Table:
        known, t = t.filter(pc.is_null(t.column("hash"))), t.filter(pc.is_valid(t.column("hash")))
        hs = [np.frombuffer(x, "<u8") for x in t.column("hash").to_pylist()]
        places, ats = ([_unpack(x) for x in t.column(c).to_pylist()] for c in ("place", "at"))
        some = known.select(["block", "place", "at"])
        if hs:
            h, place, at = (np.concatenate(x) for x in (hs, places, ats))
            order = np.lexsort((at, place))
            later = np.empty(len(h), bool)
            later[order] = _later(h[order], place[order], at[order])[0]
            found = np.split(later, np.cumsum([len(x) for x in hs])[:-1])
            some = pa.concat_tables([some, pa.table({"block": t.column("block"), **{
                c: pa.array([_pack(x[f]) for x, f in zip(v, found, strict=True)], pa.binary()) for c, v in (("place", places), ("at", ats))}})])
        return some

    def add(t: pa.Table) -> pa.Table:
        place, at = (np.concatenate([_unpack(x) for x in t.column(c).to_pylist()]).astype(np.int64) for c in ("place", "at"))
        order = np.lexsort((at, place))
        place, at = place[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] > at[:-1] + MIN_RUN)
        lo, hi = at[new], at[np.append(new[1:], True)[:len(new)]] + MIN_RUN
        text, first = np.unique(place[new], return_index=True)
        ends = pa.array(np.append(first, len(lo)), pa.int32())
        return pa.table({"place": pa.array(text, pa.int64()), **{c: pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for c, x in (("lo", lo), ("hi", hi))}})

    # the same columns as in the last join, so that both read one exchange of the texts
    found = (docs.join(seeds, "doc").select("text", "rest", "place", "seeds").mapInArrow(deal, message)
             .groupBy("bucket").applyInArrow(meet, "block long, place binary, at binary")
             .groupBy("block").applyInArrow(add, "place long, lo array<int>, hi array<int>"))
    # rows that repeat id and text have one place and the same runs
    return found.groupBy("place").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def cut_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without those words; the parts left are joined by a line end where the gap held one, else a blank."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = "", 0
    for lo, hi in [*runs, (len(spans), len(spans))]:
        if lo > at:
            part = text[spans[at][0]:spans[lo - 1][1]]
            gap = text[spans[kept][1]:spans[at][0]] if out else ""
            out += ("\n" if "\n" in gap else " ") * bool(out) + part
            kept = lo - 1
        at = hi
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with later repeated runs cut from the text, and n_words, n_removed_words, n_runs in front
    (as ``__n_words``, ``__n_removed``, ``__n_runs``)."""
    docs = _identified(df, id_col, text_col)
    seeds = _seeds(docs, scratch_path(df.sparkSession, "fingerprints"))
    runs = _repeats(docs, seeds).join(seeds.select("doc", "place"), "place").select("doc", "lo", "hi")
    joined = docs.join(runs, "doc", "left").select("text", "rest", "lo", "hi")
    rest = docs.schema["rest"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, counts = b.column("text").to_pylist(), [[], [], []]
            lo, hi = b.column("lo"), b.column("hi")
            _, at, _ = split_words(b.column("text"))
            for i, n in enumerate(np.diff(at).tolist()):
                runs = list(zip(lo[i].as_py(), hi[i].as_py(), strict=True)) if lo[i].is_valid else []
                if runs:
                    texts[i] = cut_runs(texts[i], runs)
                for c, v in zip(counts, (n, sum(hi - lo for lo, hi in runs), len(runs)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in counts), pa.array(texts, pa.string()), b.column("rest")],
                                             ["n_words", "n_removed", "n_runs", "text", "rest"])

    out = joined.mapInArrow(cut, f"n_words long, n_removed long, n_runs long, text string, rest {rest}")
    return out.select(F.col("n_words").alias("__n_words"), F.col("n_removed").alias("__n_removed"), F.col("n_runs").alias("__n_runs"),
                      *[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in df.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(keyed_text(documents(spark, sf_dir), "doc_id", "text"))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed_words"),
                      F.col("__n_runs").alias("n_runs"), "text")
