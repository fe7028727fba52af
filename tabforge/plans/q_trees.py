"""Queries: trees and forests grown level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split, trees
from ..sources.fixtures import LINEITEM_KEY, fixture, fixture_cte
from ..sources.tables import Tables
from .catalog import finish, query
from .q_learn import _binary_split
from .q_prep import BIN_FEATS, encoded_sql
from .sqlgen import level_tree_sql, walk_value

DEPTH = 2

_TREE_SQL = (encoded_sql("fx_binary").rstrip() + f", sp AS {split.split_sql('enc', LINEITEM_KEY, 'label')},\n"
             + level_tree_sql("(SELECT * FROM sp WHERE NOT is_test)", BIN_FEATS, LINEITEM_KEY, 2, DEPTH))


def _tree(spark, sf_dir):
    d, feats = _binary_split(spark, sf_dir)
    return trees.fit(d.where(~F.col("is_test")), feats, LINEITEM_KEY, "classification", max_depth=DEPTH, n_classes=2)


@query("l3c_level_tree", sql=_TREE_SQL + """
SELECT node, CAST(s0 + s1 AS BIGINT) AS n, n_rows, CAST(f AS INTEGER) AS feature, round(th, 6) AS threshold, round(gain, 6) AS gain,
       round(s1 / (s0 + s1), 6) AS share FROM nodes""")
def l3c_level_tree(spark, sf_dir):
    """Nodes of a tree of two levels, every midpoint of every feature tried."""
    n = _tree(spark, sf_dir).nodes
    return finish(n.select("node", "n", "n_rows", "feature", "threshold", "gain", F.col("value")[1].alias("share")))


@query("i1_level_importance", sql=_TREE_SQL + f""", g AS (SELECT f, sum(gain) AS g FROM nodes WHERE f IS NOT NULL GROUP BY f)
SELECT [{', '.join(f"'{c}'" for c in BIN_FEATS)}][i + 1] AS feature, round(coalesce(g / (SELECT sum(g) FROM g), 0.0), 6) AS importance
FROM range({len(BIN_FEATS)}) t(i) LEFT JOIN g ON f = i""")
def i1_level_importance(spark, sf_dir):
    """Impurity taken away by each feature's splits."""
    return finish(_tree(spark, sf_dir).importances())


MULTI = ["o_totalprice", "o_custkey", "priority", "month"]
STATUS = ["F", "O", "P"]
N_TREES = 3

_MULTI_SQL = (fixture_cte("fx_multiclass").rstrip() + f""", enc AS (SELECT o_orderkey, o_totalprice, o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
  month(o_orderdate) AS month, CAST(list_position({STATUS}, o_orderstatus) - 1 AS DOUBLE) AS label FROM fx_multiclass),
sp AS {split.split_sql('enc', ['o_orderkey'], 'label')},
""" + level_tree_sql("(SELECT * FROM sp WHERE NOT is_test)", MULTI, ["o_orderkey"], len(STATUS), DEPTH, N_TREES, 2))


def _walked_sql() -> str:
    out = f", w0 AS (SELECT o_orderkey, tree, '' AS node, label, {', '.join(MULTI)} FROM sp, range({N_TREES}) t(tree) WHERE is_test)"
    for d in range(DEPTH):
        out += f""",
w{d + 1} AS (SELECT o_orderkey, tree, w{d}.node || CASE WHEN f IS NULL THEN '' WHEN {walk_value(MULTI)} <= th THEN '0' ELSE '1' END AS node, label, {', '.join(MULTI)}
  FROM w{d} LEFT JOIN (SELECT tree, node, f, th FROM nodes WHERE f IS NOT NULL) USING (tree, node))"""
    s = " + ".join(f"s{c}" for c in range(len(STATUS)))
    mean = [f"list_reduce(list(CAST(s{c} AS DOUBLE) / ({s}) ORDER BY tree), lambda a, b: a + b) / {N_TREES} AS p{c}" for c in range(len(STATUS))]
    return out + f""", pr AS (SELECT o_orderkey, label, {', '.join(mean)} FROM w{DEPTH} JOIN nodes USING (tree, node) GROUP BY o_orderkey, label)
SELECT o_orderkey, label, CAST(list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 AS DOUBLE) AS prediction,
       round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM pr"""


@query("l3d_level_forest", sql=_MULTI_SQL + _walked_sql())
def l3d_level_forest(spark, sf_dir):
    """Three classes: held-out probabilities of a forest whose rows and features are drawn by hash."""
    t = fixture(Tables(spark, sf_dir), "fx_multiclass").select(
        "o_orderkey", "o_totalprice", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.month("o_orderdate").alias("month"),
        (F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("o_orderstatus")) - 1).cast("double").alias("label"))
    d = split.split(t, ["o_orderkey"], "label")
    m = trees.fit(d.where(~F.col("is_test")), MULTI, ["o_orderkey"], "classification", n_trees=N_TREES, max_features=2, max_depth=DEPTH, n_classes=len(STATUS))
    out = m.transform(d.where("is_test"))
    return finish(out.select("o_orderkey", "label", "prediction", *[F.col("probability")[c].alias(f"p{c}") for c in range(len(STATUS))]))
