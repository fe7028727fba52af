"""N-gram Jaccard join with a token-group matrix (operator 8); exact.

Documents are sets of five-word shingles; two link at a Jaccard similarity of 0.8 or more.  A node is a
distinct text (equal texts have equal sets and need no pair).

1. *Shared tokens.*  A set can only link if at least 80 % of its shingles occur in another document.  All
   shingles are dealt out by hash in packed blocks (4 bytes and a row number each) and only the number of shared ones
   per document comes back, so documents with enough text of their own leave here.
2. *Groups.*  What is left is ordered rarest shingle first; linked sets share one of the first
   ``n - ceil(0.8 n) + 1``.  Sets that share such a shingle (each is tied to the least holder, never all pairs) fall
   into the same group of similar documents; a large group is cut into blocks of ``BLOCK`` by size.
3. *Bounds.*  For a block its token union is stored.  The overlap of a query with any member is at most its
   overlap with the union; only queries that reach 80 % of their own size open the block, and only opened
   members are compared (a product of 0/1 matrices).  A task counts the links of each text, one for every copy of the other
   text, and returns links that span what it found; ``links`` returns all pairs of distinct texts on request.

A document's number of links counts the other documents it links with, copies of its own text among them.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Null and empty texts have an empty set and link with
nothing.  Null ids are allowed: a component's id is its least non-null one.  Repeated rows are copies of each other.
An empty table gives an empty result.  Other columns pass through ``keep_one``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.session import scratch_path

from .common import documents, hash_strings, mix, slices, split_words
from .components import components

N_WORDS = 5
#: Similarity in percent.
PERCENT = 80
BLOCK = 512
#: Bytes of text whose shingles make one bucket of the first step.
BUCKET_BYTES = 4 << 20
_COLUMNS = 8192
_ODD = np.uint64(0x9E3779B97F4A7C15)


def least_shared(n):
    """Shingles that a set of n must share with any set it links to."""
    return -(-PERCENT * n // 100)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, sorted and distinct per text; row offsets)."""
    code, at, words = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = mix(hash_strings(words))[code]
    n = len(h)
    gram = np.zeros(n, np.uint64)
    for k in range(min(N_WORDS, n)):
        gram[:n - N_WORDS + 1] = gram[:n - N_WORDS + 1] * _ODD + h[k:n - N_WORDS + 1 + k]
    gram = mix(gram)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= N_WORDS:
            out.append(np.unique(gram[lo:hi - N_WORDS + 1]))
        else:  # the whole sequence, told apart from shingles by its length
            x = np.array([hi - lo], np.uint64)
            for t in h[lo:hi]:
                x = mix(x) + t
            out.append(mix(x)[:min(1, hi - lo)])
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _small(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u4").tobytes(), 1)


def _back(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<u4")


def profiles(docs: DataFrame) -> DataFrame:
    """From (doc_id, h, text): doc_id, h, n (set size), shared (shingles that another row also has)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(20, max(4, np.ceil(np.log2(max(1, total) / BUCKET_BYTES)))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = f"ids array<{kind}>, hs array<long>, sizes array<int>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches)):
            block = part << 32 | k
            token, at = shingles(b.column("text"))
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, row = bucket[order], row[order]
            rest = (token[order] << np.uint64(bits) >> np.uint64(32)).astype("<u4")
            used, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(bucket))[:len(used)]  # none if the batch has no word
            empty = pa.nulls(len(used))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()),
                 pa.array([rest[f:e].tobytes() for f, e in zip(first, ends, strict=True)], pa.binary()),
                 pa.array([_small(np.diff(row[f:e], prepend=0)) for f, e in zip(first, ends, strict=True)], pa.binary()),
                 empty.cast(pa.list_(b.schema.field("doc_id").type)), empty.cast(pa.list_(pa.int64())), empty.cast(pa.list_(pa.int32()))],
                ["bucket", "block", "rest", "rows", "ids", "hs", "sizes"])
            whole = pa.array([0, b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block % (1 << bits)], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 *(pa.ListArray.from_arrays(whole, x) for x in (b.column("doc_id"), b.column("h"), pa.array(np.diff(at), pa.int32())))],
                ["bucket", "block", "rest", "rows", "ids", "hs", "sizes"])

    def count(t: pa.Table) -> pa.Table:
        data = t.filter(pc.is_valid(t.column("rest")))
        rest = [np.frombuffer(x, "<u4") for x in data.column("rest").to_pylist()]
        _, inverse, n = np.unique(np.concatenate(rest) if rest else np.zeros(0, np.uint32), return_inverse=True, return_counts=True)
        twice, at, out = n[inverse] > 1, 0, []
        for r, rows in zip(rest, data.column("rows").to_pylist(), strict=True):
            row = np.cumsum(_back(rows).astype(np.int64))
            out.append(_small(np.bincount(row[twice[at:at + len(r)]])))
            at += len(r)
        some = pa.table({"block": data.column("block"), "found": pa.array(out, pa.binary()),
                         **{c: data.column(c) for c in ("ids", "hs", "sizes")}})
        meta = t.filter(pc.is_null(t.column("rest")))
        return pa.concat_tables([some, pa.table({"block": meta.column("block"), "found": meta.column("rest"),
                                                 **{c: meta.column(c) for c in ("ids", "hs", "sizes")}})])

    def add(t: pa.Table) -> pa.Table:
        meta = t.filter(pc.is_valid(t.column("sizes"))).combine_chunks()
        ids, hs, sizes = (pc.list_flatten(meta.column(c)) for c in ("ids", "hs", "sizes"))
        shared = np.zeros(len(sizes), np.int64)
        for x in t.column("found").to_pylist():
            if x is not None:
                own = _back(x)
                shared[:len(own)] += own
        return pa.table({"doc_id": ids, "h": hs, "n": sizes.cast(pa.int64()), "shared": pa.array(shared, pa.int64())})

    return (docs.select("doc_id", "h", "text").mapInArrow(deal, f"bucket int, block long, rest binary, rows binary, {lists}")
            .groupBy("bucket").applyInArrow(count, f"block long, found binary, {lists}")
            .groupBy("block").applyInArrow(add, f"doc_id {kind}, h long, n long, shared long"))


def token_sets(texts: DataFrame) -> DataFrame:
    """From (h, copies, text): h, copies, n and the sorted set as binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            token, at = shingles(b.column("text"))
            data = [token[lo:hi].astype("<u8").tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("copies"), pa.array(np.diff(at), pa.int64()), pa.array(data, pa.binary())],
                                             ["h", "copies", "n", "tokens"])

    return texts.select("h", "copies", "text").mapInArrow(run, "h long, copies long, n long, tokens binary")


def rare_prefixes(sets: DataFrame) -> DataFrame:
    """(h, token): the shingles of each prefix, rarest first, that some other set also has."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("tokens").to_pylist()
            token = np.frombuffer(b"".join(data), "<i8")
            counts = np.fromiter((len(x) // 8 for x in data), np.int64, len(data))
            h, n = (np.repeat(b.column(c).to_numpy(), counts) for c in ("h", "n"))
            for lo in range(0, len(token), 1 << 18):
                hi = lo + (1 << 18)
                yield pa.RecordBatch.from_arrays([pa.array(h[lo:hi], pa.int64()), pa.array(n[lo:hi], pa.int64()), pa.array(token[lo:hi], pa.int64())], ["h", "n", "token"])

    counted = (sets.mapInArrow(unpack, "h long, n long, token long")
               .withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1"))
    whole, rarest = Window.partitionBy("h"), Window.partitionBy("h").orderBy("df", "token")
    return (counted.withColumn("m", F.count("*").over(whole)).withColumn("r", F.row_number().over(rarest))
            # n - m shingles are nobody else's and come first
            .where(F.col("r") + F.col("n") - F.col("m") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
            .select("h", "token"))


def _rows(sets: list[np.ndarray], universe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every token of each set that the sorted universe holds."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(universe, flat), max(0, len(universe) - 1))
    here = universe[at] == flat if len(universe) else np.zeros(len(flat), bool)
    return row[here], at[here]


def linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Pairs (i, j) of linked sets: bound each query by the other block's token union, open what qualifies, compare."""
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    union_a, union_b = (np.unique(np.concatenate(x)) for x in (a, b))
    both = np.intersect1d(union_a, union_b, assume_unique=True)
    (ra, ca), (rb, cb) = _rows(a, both), _rows(b, both)
    opens_a = np.bincount(ra, minlength=len(a)) >= least_shared(na)
    opens_b = np.bincount(rb, minlength=len(b)) >= least_shared(nb)
    if not opens_a.any() or not opens_b.any():
        return np.zeros((0, 2), np.int64)
    over = np.zeros((len(a), len(b)), np.float64)
    ka, kb = opens_a[ra], opens_b[rb]
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    for lo in range(0, len(both), _COLUMNS):
        ia, ib = (slice(*np.searchsorted(c, [lo, lo + _COLUMNS])) for c in (ca, cb))
        ma, mb = np.zeros((len(a), _COLUMNS), np.float32), np.zeros((len(b), _COLUMNS), np.float32)
        ma[ra[ia], ca[ia] - lo] = 1
        mb[rb[ib], cb[ib] - lo] = 1
        over += ma @ mb.T
    return np.argwhere(over * 100 >= PERCENT * (na[:, None] + nb[None] - over) - 1e-6)


def _span(nodes: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs.tolist():
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [(int(nodes[i]), int(nodes[root(i)])) for i in range(len(nodes)) if root(i) != i]


def _compare(t: pd.DataFrame, every: bool = False) -> pd.DataFrame:
    """One pair of blocks (or a block with itself): links (a, b), spanning or every one, and rows (a, a, n) of link counts."""
    sides = [t[t["block"] == k] for k in sorted(set(t["block"]))]
    sets = [[np.frombuffer(x, "<u8") for x in s["tokens"]] for s in sides]
    nodes = np.concatenate([s["h"].to_numpy() for s in sides])
    if t["i"].iat[0] == t["j"].iat[0]:
        pairs = linked(sets[0], sets[0])
    elif len(sides) == 2:
        pairs = linked(*sets) + np.array([0, len(sets[0])])
    else:
        pairs = np.zeros((0, 2), np.int64)
    i, j = pairs[pairs[:, 0] < pairs[:, 1]].T
    copies = np.concatenate([s["copies"].to_numpy() for s in sides])
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    found = np.stack([nodes[i], nodes[j]], axis=1) if every else np.array(_span(nodes, np.stack([i, j], axis=1)), np.int64).reshape(-1, 2)
    some = np.flatnonzero(n)
    return pd.DataFrame({"a": np.concatenate([found[:, 0], nodes[some]]), "b": np.concatenate([found[:, 1], nodes[some]]),
                         "n": np.concatenate([np.zeros(len(found), np.int64), n[some]])}).astype("int64")


def links(sets: DataFrame, every: bool = False) -> DataFrame:
    """(a, b): links between distinct texts that span all links there are, or every link."""
    return compared(sets, every).where("a <> b").select("a", "b")


def compared(sets: DataFrame, every: bool = False) -> DataFrame:
    """(a, b, n): links, n is 0, and for each text with links to other texts rows (a, a, n) that add up to their number."""
    spark = sets.sparkSession
    path = scratch_path(spark, "links")
    rare_prefixes(sets).write.parquet(f"{path}/prefixes")
    prefixes = spark.read.parquet(f"{path}/prefixes")
    ties = prefixes.join(prefixes.groupBy("token").agg(F.min("h").alias("b")), "token").select(F.col("h").alias("a"), "b").where("a <> b")
    groups = components(ties)
    in_group = Window.partitionBy("label").orderBy("n", "h")
    placed = (sets.join(groups.withColumnRenamed("node", "h"), "h")
              .withColumn("block", F.floor((F.row_number().over(in_group) - 1) / BLOCK).cast("int"))
              .withColumn("last", F.floor((F.count("*").over(Window.partitionBy("label")) - 1) / BLOCK).cast("int")))
    meets = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = placed.select("label", "h", "copies", "tokens", "block", F.explode(meets).alias("p")).select("label", "h", "copies", "tokens", "block", "p.i", "p.j")
    (dealt.groupBy("label", "i", "j").applyInPandas(lambda t: _compare(t, every), "a long, b long, n long").write.parquet(f"{path}/links"))
    return spark.read.parquet(f"{path}/links")


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, n_links, and first_h: with component_id what stands for the component."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    path = scratch_path(spark, "jaccard")
    profiles(docs).write.parquet(f"{path}/profiles")
    known = spark.read.parquet(f"{path}/profiles")
    (known.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("shared").alias("shared"),
                                                F.count("*").alias("copies"))
     .write.parquet(f"{path}/nodes"))
    nodes = spark.read.parquet(f"{path}/nodes")
    open_nodes = nodes.where(F.col("shared") >= F.ceil(F.col("n") * PERCENT / 100)).select("h", "copies")
    token_sets(docs.select("h", "text").join(open_nodes, "h").dropDuplicates(["h"])).write.parquet(f"{path}/sets")
    pairs = compared(spark.read.parquet(f"{path}/sets"))
    counts = pairs.where("a = b").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("others"))
    found = components(pairs).withColumnRenamed("node", "h")
    found.write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    label = F.coalesce(F.col("label"), F.col("h"))
    n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    labelled = nodes.join(found.join(counts, "h"), "h", "left").select("h", "id", label.alias("label"), n_links.alias("n_links"))
    heads = labelled.groupBy("label").agg(F.min("id").alias("component_id"), F.min(F.struct("id", "h")).alias("first"))
    named = labelled.join(heads, "label").select("h", "component_id", "n_links", F.col("first.h").alias("first_h"))
    return (known.join(named, "h", "left")
            .select("doc_id", "h", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("first_h", "h").alias("first_h")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stand for their component: of each, the document of the least id (of equal ids, the least
    text hash; a row repeated whole stays once).  Documents with an empty set all stay."""
    spark = df.sparkSession
    path = scratch_path(spark, "kept")
    cluster(df, id_col, text_col).write.parquet(path)
    members = spark.read.parquet(path)
    stays = (F.col("n_shingles") == 0) | (F.col("component_id").eqNullSafe(F.col("doc_id")) & (F.col("first_h") == F.col("h")))
    gone = members.where(~stays).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    h = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    tagged = df.withColumn("__text_hash", h)
    out = tagged.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__h")), "left_anti")
    if not members.where("n_shingles > 0").groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__text_hash"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")
