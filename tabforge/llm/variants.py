"""Spelling variant grouping over a relational trie (operator 13).

The words of the corpus are counted, written forwards and backwards into one path-compressed trie that is
a table of edges (level, node, label, child), and searched as a frontier of states (word, position, node,
edits): each round joins the states with the edges of one level.  A state without an edit follows its own
path; from the middle of its word on it may also replace a letter by a greater one or skip one.  A state
with an edit only follows equal letters.  States that reach the end of another word with one edit are
neighbours.  Any two words one edit apart share the first or the last half of the word, so the two
directions together find every pair, once from its smaller or longer word; pairs are then turned both ways.

Nodes are 64-bit hashes of prefixes.  Two prefixes with one hash only add edges to a node, never hide one, and
every pair is measured again on the words themselves, so hashes cannot change the result.  A compressed
trie has as many levels as a word has places where another word leaves it, however long the word is.

Null texts and texts without letters have no words; a null id counts as the empty string in the hash
that deletes letters; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import scratch_path

from .common import documents, gather, keyed_text, mix

#: Shortest word, fewest occurrences, and how many times as frequent a form must be.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 7, 2, 10
#: One in so many runs loses a letter.
DELETE_EVERY = 31
#: Ends every word in the trie; no letter is as small.
END = "$"
#: Root node of the forward and of the backward trie.
ROOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Edges of the first levels are at most (letters + end) ** (level + 1) in either direction: 91 and 8,281 twice.
BROADCAST_LEVELS = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters after the rule that deletes a letter, as often as they occur."""
    src = keyed_text(df, id_col, text_col)
    # a shorter run cannot become a word, and a greedy match takes a long run whole
    found = F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-z\\x{{C0}}-\\x{{FF}}]{{{MIN_LENGTH},}})"), F.lit(1)))
    runs = src.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), found.alias("run"))
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER))  # the same, the first is faster
    runs = runs.select("id", lowered.alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def _prefixes(vocabulary: DataFrame) -> DataFrame:
    """wid, dir, depth, node, next: every prefix of every word in both directions, with the letter after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.utf8_length(b.column("word")).to_numpy().astype(np.int64)
            code = np.frombuffer("".join(b.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
            starts = np.cumsum(lengths) - lengths
            at = gather(starts, lengths)
            depth = at - np.repeat(starts, lengths) + 1
            wid = pa.array(np.repeat(b.column("wid").to_numpy(), lengths))
            order = np.argsort(-lengths, kind="stable")
            longer = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
            for way, root in enumerate(ROOTS):
                node = np.empty(len(code), np.uint64)
                state = np.full(len(lengths), root)
                for d, n in enumerate(longer.tolist()):  # the n longest words have a letter number d
                    w = order[:n]
                    letter = starts[w] + d if way == 0 else starts[w] + lengths[w] - 1 - d
                    state[w] = mix(state[w] * np.uint64(0x100000001B3) + code[letter].astype(np.uint64))
                    node[starts[w] + d] = state[w]
                shown = code if way == 0 else code[np.repeat(starts + lengths - 1, lengths) - depth + 1]
                following = np.append(shown[1:], 0).astype(np.int32)
                following[starts + lengths - 1] = ord(END)
                yield pa.RecordBatch.from_arrays(
                    [wid, pa.array(np.full(len(code), way, np.int8)), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)),
                     pa.array(following)], ["wid", "dir", "depth", "node", "next"])

    return vocabulary.select("wid", "word").mapInArrow(run, "wid long, dir byte, depth int, node long, next int")


def _spelled(vocabulary: DataFrame) -> DataFrame:
    """Every word in both directions, with its end mark and the root it starts from."""
    ways = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("dir"), F.lit(int(r.astype(np.int64))).alias("node"))
                               for i, r in enumerate(ROOTS)]))
    both = vocabulary.withColumn("way", ways).select("wid", "word", "n", "way.dir", "way.node")
    return both.withColumn("spelt", F.concat(F.when(F.col("dir") == 0, F.col("word")).otherwise(F.reverse("word")), F.lit(END)))


def _word() -> Column:
    """The word of a state: a state carries its word once, as it spells it, through every shuffle and file."""
    spelt = F.substring("spelt", F.lit(1), F.length("spelt") - 1)
    return F.when(F.col("dir") == 0, spelt).otherwise(F.reverse(spelt))


def _bit(letter: Column) -> Column:
    """One of 64 bits for a letter's number; two letters may share a bit, so a set of bits never lacks a letter."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (letter % 64).cast("int"))


def _code(text: Column, at: Column) -> Column:
    """Number of the letter at a place (from 0); 0 past the end."""
    return F.ascii(F.substring(text, at + 1, F.lit(1)))


def build_trie(vocabulary: DataFrame) -> DataFrame:
    """level, node, label, first, after, child, child_firsts, leaf, leaf_n: the edges of both compressed tries.

    An edge into a word's end has a leaf and no child.  ``after`` has the bits of the letters that can follow the first
    letter of the edge, ``child_firsts`` those of the first letters of the child's edges."""
    prefixes = _prefixes(vocabulary)
    branches = (prefixes.groupBy("node").agg(F.min("next").alias("least"), F.max("next").alias("most"), F.bit_or(_bit(F.col("next"))).alias("firsts"))
                .where(F.col("least") != F.col("most")).select("node", "firsts"))
    path = (prefixes.drop("next").join(branches, "node").groupBy("wid", "dir")
            .agg(F.sort_array(F.collect_list(F.struct("depth", "node", "firsts"))).alias("path")))
    words = _spelled(vocabulary).join(path, ["wid", "dir"], "left")
    root = F.array(F.struct(F.lit(0).alias("depth"), F.col("node"), F.lit(0).cast("long").alias("firsts")))
    words = words.withColumn("path", F.concat(root, F.coalesce("path", F.array().cast(path.schema["path"].dataType))))
    steps = words.select("word", "n", "spelt", "path", F.posexplode("path").alias("level", "at"))
    to = F.get("path", F.col("level") + 1)
    label = F.substring("spelt", F.col("at.depth") + 1, F.coalesce(to["depth"], F.length("spelt")) - F.col("at.depth"))
    is_leaf = to.isNull()
    edges = steps.select("level", F.col("at.node").alias("node"), label.alias("label"), to["node"].alias("child"),
                         to["firsts"].alias("child_firsts"), F.when(is_leaf, F.col("word")).alias("leaf"), F.when(is_leaf, F.col("n")).alias("leaf_n"))
    after = F.when(F.length("label") > 1, _bit(_code(F.col("label"), F.lit(1)))).otherwise(F.coalesce("child_firsts", F.lit(-1).cast("long")))
    inner = edges.where(F.col("leaf").isNull()).distinct()  # many words share an edge, none shares its last one
    return inner.unionAll(edges.where(F.col("leaf").isNotNull())).withColumn("first", F.ascii("label")).withColumn("after", after)


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Every state over every edge it can take: its next state, or the word whose end it reaches."""
    e = edges.select(F.col("node").alias("from"), "first", "after", "label", "child", "child_firsts", "leaf", "leaf_n")
    pos, spelt, first, end = F.col("pos"), F.col("spelt"), F.col("first"), F.lit(ord(END))
    middle = F.floor((F.length("spelt") - 1) / 2)
    s = states.select("*", ((F.col("edits") == 0) & (pos >= middle)).alias("is_open"), *[_code(spelt, pos + i).alias(f"c{i}") for i in range(3)])
    c0, c1, c2 = (F.col(f"c{i}") for i in range(3))

    def then(letter: Column) -> Column:
        return F.col("after").bitwiseAND(_bit(letter)) != 0
    s = s.join(e, (s["node"] == e["from"]) & (
        ((first == c0) & ((F.col("edits") == 0) | (c1 == 0) | then(c1)))
        | (F.col("is_open") & (c0 != end) & (((first > c0) & then(c1)) | ((first == c1) & ((c1 == end) | then(c2)))))))
    may_edit = (F.col("edits") == 0) & (pos + F.length("label") > middle) & (c0 != end)
    q = F.length("label")
    same, longer = F.substring(spelt, pos + 1, q), F.substring(spelt, pos + 1, q + 1)
    ends = F.col("label").endswith(END)
    one = q == 1
    equal = (first == c0) & (one | (same == F.col("label")))
    replaced = may_edit & ~equal & F.when(one, first > c0).otherwise(
        (same < F.col("label")) & (F.length(same) == q) & (same.endswith(END) == ends) & (F.levenshtein(same, "label", 1) == 1))
    skipped = may_edit & ~equal & F.when(one, first == c1).otherwise(
        (F.length(longer) == q + 1) & (longer.endswith(END) == ends) & (F.levenshtein(longer, "label", 1) == 1))
    moves = F.array_compact(F.array(
        F.when(equal, F.struct((pos + q).alias("pos"), F.col("edits").alias("edits"))),
        F.when(replaced, F.struct((pos + q).alias("pos"), F.lit(1).alias("edits"))),
        F.when(skipped, F.struct((pos + q + 1).alias("pos"), F.lit(1).alias("edits")))))
    s = s.select("dir", "n", "spelt", "child", "child_firsts", "leaf", "leaf_n", F.explode(moves).alias("to"))
    s = s.select("dir", "n", "spelt", F.col("to.pos").alias("pos"), F.col("child").alias("node"), F.col("to.edits").alias("edits"),
                 "leaf", "leaf_n", "child_firsts")
    goes_on = F.col("node").isNotNull() & ((F.col("edits") == 0) | (F.col("child_firsts").bitwiseAND(_bit(_code(spelt, F.col("pos")))) != 0))
    return s.where(goes_on | (F.col("edits") == 1) & F.col("leaf").isNotNull()).drop("child_firsts")


def near_pairs(spark: SparkSession, vocabulary: DataFrame, edges: DataFrame) -> DataFrame:
    """word, n, other, other_n: every two words one edit apart, from either side."""
    found, level = [], 0
    states = _spelled(vocabulary).select("dir", "n", "spelt", F.lit(0).alias("pos"), "node", F.lit(0).alias("edits"))
    while True:
        ways = edges.where(F.col("level") == level)
        path = scratch_path(spark, f"variants-frontier-{level}")
        _step(states, F.broadcast(ways) if level < BROADCAST_LEVELS else ways).write.parquet(path)
        reached = spark.read.parquet(path)
        found.append(reached.where(F.col("leaf").isNotNull()))
        states = reached.where(F.col("leaf").isNull()).drop("leaf", "leaf_n")
        if states.isEmpty():
            break
        level += 1
    pairs = reduce(DataFrame.unionAll, found).select(_word().alias("word"), "n", F.col("leaf").alias("other"), F.col("leaf_n").alias("other_n"))
    pairs = pairs.where(F.levenshtein("word", "other", 1) == 1).distinct()
    return pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                                       F.col("n").alias("other_n")))


def _roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms from each word ends (every step is FORM_RATIO times as frequent, so it ends)."""
    path = scratch_path(spark, "variants-roots")
    forms.select("word", F.col("form").alias("root")).write.parquet(path)
    while True:
        now = spark.read.parquet(path)
        further = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        path = scratch_path(spark, "variants-roots")
        now.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")).write.parquet(path)
        after = spark.read.parquet(path)
        if after.where("__moved").isEmpty():
            return after.select("word", "root")


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, "variants-words")
    (count_words(df, id_col, text_col).where(F.col("n") >= MIN_COUNT)
     .select(F.monotonically_increasing_id().alias("wid"), "word", "n").write.parquet(path))
    vocabulary = spark.read.parquet(path)
    trie = scratch_path(spark, "variants-trie")
    edges = build_trie(vocabulary)
    edges.write.partitionBy("level").parquet(trie)
    near = near_pairs(spark, vocabulary, spark.read.schema(edges.schema).parquet(trie)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    result = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                          F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    has_form = F.coalesce(F.col("form_n") >= FORM_RATIO * F.col("n"), F.lit(False))
    result = result.select("word", F.when(has_form, F.col("form")).alias("form"), "n", "n_near", F.when(has_form, F.col("form_n")).alias("form_n"))
    path = scratch_path(spark, "variants-forms")
    result.write.parquet(path)
    result = spark.read.parquet(path)
    roots = _roots(spark, result.where(F.col("form").isNotNull()))
    return result.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(documents(spark, sf_dir))
