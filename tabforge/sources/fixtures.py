"""Derived fixture views over the driver tables.

Each fixture is written twice, identically: as a DataFrame plan and as a
DuckDB SQL text used by the oracle.  ``key`` lists the row-identity columns
(integral, so their string form is the same in both engines); ``target`` is
the label column used by the learning steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus"]


def _net(li: DataFrame):
    return F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))


_NET_SQL = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@dataclass(frozen=True)
class Fixture:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str
    key: list[str] = field(default_factory=list)
    target: str | None = None


def _fx_missing(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    lab = t.labels.select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


def _fx_nulls(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *LINEITEM_KEY, "l_extendedprice", "l_quantity",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("l_returnflag"),
        F.nullif(F.col("l_linestatus"), F.lit("F")).alias("l_linestatus"))


def _fx_imbalanced(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars", "lang")
    lab = t.labels.select("doc_id", "toxic")
    return d.join(lab, "doc_id", "inner")


def _line_base(t: Tables) -> DataFrame:
    return t.lineitem.select(*LINEITEM_KEY, *LINE_FEATURES, _net(None).alias("net"))


def _fx_regression(t: Tables) -> DataFrame:
    return _line_base(t)


def _fx_binary(t: Tables) -> DataFrame:
    b = _line_base(t)
    return b.select(*LINEITEM_KEY, *LINE_FEATURES,
                    (F.col("net") > 50000).cast("int").alias("high_value"))


def _fx_severe(t: Tables) -> DataFrame:
    b = _line_base(t)
    return b.select(*LINEITEM_KEY, *LINE_FEATURES,
                    (F.col("net") > 95000).cast("int").alias("is_large"))


def _fx_dups(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", "c_mktsegment")


def _fx_outliers(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value")


def _fx_json_num(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _fx_multiclass(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                           "o_orderdate", "o_orderstatus")


def _fx_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "embedding", "label")


_LI_KEY_SQL = ", ".join(LINEITEM_KEY)
_LI_FEAT_SQL = ", ".join(LINE_FEATURES)

FIXTURES: dict[str, Fixture] = {f.name: f for f in [
    Fixture("fx_missing", _fx_missing,
            "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
            "FROM documents d LEFT JOIN labels l USING (doc_id)",
            ["doc_id"], "toxic"),
    Fixture("fx_nulls", _fx_nulls,
            f"SELECT {_LI_KEY_SQL}, l_extendedprice, l_quantity, "
            "nullif(l_discount, 0.0) AS l_discount, nullif(l_returnflag, 'N') AS l_returnflag, "
            "nullif(l_linestatus, 'F') AS l_linestatus FROM lineitem",
            LINEITEM_KEY, "l_quantity"),
    Fixture("fx_imbalanced", _fx_imbalanced,
            "SELECT d.doc_id, d.n_chars, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)",
            ["doc_id"], "toxic"),
    Fixture("fx_regression", _fx_regression,
            f"SELECT {_LI_KEY_SQL}, {_LI_FEAT_SQL}, {_NET_SQL} AS net FROM lineitem",
            LINEITEM_KEY, "net"),
    Fixture("fx_binary", _fx_binary,
            f"SELECT {_LI_KEY_SQL}, {_LI_FEAT_SQL}, CAST({_NET_SQL} > 50000 AS INTEGER) AS high_value "
            "FROM lineitem",
            LINEITEM_KEY, "high_value"),
    Fixture("fx_severe", _fx_severe,
            f"SELECT {_LI_KEY_SQL}, {_LI_FEAT_SQL}, CAST({_NET_SQL} > 95000 AS INTEGER) AS is_large "
            "FROM lineitem",
            LINEITEM_KEY, "is_large"),
    Fixture("fx_dups", _fx_dups, "SELECT c_nationkey, c_mktsegment FROM customer", [], "c_mktsegment"),
    Fixture("fx_outliers", _fx_outliers, "SELECT event_id, value FROM events", ["event_id"], "value"),
    Fixture("fx_json_num", _fx_json_num,
            "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", ["event_id"], "k"),
    Fixture("fx_multiclass", _fx_multiclass,
            "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate, o_orderstatus "
            "FROM orders",
            ["o_orderkey"], "o_orderstatus"),
    Fixture("fx_vectors", _fx_vectors, "SELECT vec_id, embedding, label FROM embeddings",
            ["vec_id"], "label"),
]}


def fixture(t: Tables, name: str) -> DataFrame:
    return FIXTURES[name].build(t)


def fixture_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixtures for the DuckDB oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n].sql})" for n in names) + "\n"
