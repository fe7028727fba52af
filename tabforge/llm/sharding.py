"""Sharding by fixed virtual slots (operator 2); DataFrame functions only.

A record's slot is a hash of its id and text, so it never changes.  Bytes are summed per slot
(a map-side combine, then ``n_slots`` rows), and a slot-to-shard map is laid out from those
sums: the largest slot first, always to the lightest shard.  The map is small (one row per
slot), versioned, and kept as a table; rebalancing edits only the rows that must move.

A null text has no bytes, a null id hashes like any value, repeated rows share a slot, extra
columns are not read.  An empty table gives an empty result and a map with all slots at zero.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keyed_text

#: Slots are fixed for the life of a data set; the map, not the hash, changes.
N_SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def slot_of(doc_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(n_slots)).cast("int")


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32 and virtual slot of every record; the text itself goes no further."""
    src = keyed_text(df, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    return src.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
                      slot_of(F.col("doc_id"), F.col("text"), n_slots).alias("vslot"))


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"))


def build_map(spark: SparkSession, totals: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the map, from at most ``n_slots`` rows of sums: largest slot first, to the lightest shard."""
    known = {r.vslot: r.bytes for r in totals.collect()}
    heap = [(0, s) for s in range(n_shards)]
    rows = []
    for vslot in sorted(range(n_slots), key=lambda v: (-known.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        rows.append((1, vslot, shard, known.get(vslot, 0)))
        heapq.heappush(heap, (load + known.get(vslot, 0), shard))
    return spark.createDataFrame(rows, MAP_SCHEMA)


def rebalance(spark: SparkSession, current: DataFrame, n_shards: int) -> DataFrame:
    """The next version for ``n_shards``: slots of shards that are gone move, and over-full shards hand their
    smallest slots to the lightest shards; every other row keeps its shard."""
    old = sorted(current.collect(), key=lambda r: r.vslot)
    version = max((r.version for r in old), default=0) + 1
    shard = {r.vslot: r.shard for r in old}
    size = {r.vslot: r.bytes for r in old}
    load = {s: 0 for s in range(n_shards)}
    loose = []
    for v, s in shard.items():
        if s in load:
            load[s] += size[v]
        else:
            loose.append(v)
    goal = sum(size.values()) / max(1, n_shards)
    for v in sorted((v for v in shard if shard[v] in load), key=lambda v: (size[v], v)):
        if load[shard[v]] - size[v] >= goal:
            load[shard[v]] -= size[v]
            loose.append(v)
    heap = [(b, s) for s, b in load.items()]
    heapq.heapify(heap)
    for v in sorted(loose, key=lambda v: (-size[v], v)):
        b, s = heapq.heappop(heap)
        shard[v] = s
        heapq.heappush(heap, (b + size[v], s))
    return spark.createDataFrame([(version, v, shard[v], size[v]) for v in sorted(shard)], MAP_SCHEMA)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds this version to the table of maps; earlier versions stay readable."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("version", "vslot", "shard", "bytes")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its place there, gapless from 0: rows before its slot in the shard, plus its
    rank inside the slot (a window over one slot, never over a shard)."""
    counts = records.groupBy("vslot").agg(F.count("*").alias("n"))
    per_shard = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    base = (slot_map.join(counts, "vslot")
            .select("vslot", "shard", F.coalesce(F.sum("n").over(per_shard), F.lit(0)).alias("before")))
    in_slot = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("rank", F.row_number().over(in_slot) - 1)
    # the map has one row per slot (n_slots, a constant), so it may be broadcast
    return (ranked.join(F.broadcast(base), "vslot")
            .withColumn("slot", (F.col("before") + F.col("rank")).cast("long")).drop("before", "rank"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.session import scratch_path
    records = sized(documents(spark, sf_dir))
    maps = scratch_path(spark, "slot-map")
    save_map(build_map(spark, slot_bytes(records), 16), maps)
    return place(records, load_map(spark, maps)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")
