"""Registry of named queries: a Spark plan and, where SQL can say the same,
its DuckDB oracle text.  ``__spark_entry__`` exposes both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so engines agree on the printed value."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def load_all() -> None:
    """Import every query module so its registrations run."""
    from . import q_profile, q_eda, q_prep, q_learn, q_run, q_trees  # noqa: F401


def sig(c, digits: int = 10):
    """Round to significant digits (large-magnitude sums differ in the last bits)."""
    e = F.floor(F.log10(F.abs(c)))
    return (F.when(c == 0, F.lit(0.0))
             .otherwise(F.round(c / F.pow(F.lit(10.0), e), digits - 1) * F.pow(F.lit(10.0), e)))


def sig_sql(x: str, digits: int = 10) -> str:
    e = f"floor(log10(abs({x})))"
    return f"(CASE WHEN ({x}) = 0 THEN 0.0 ELSE round(({x}) / pow(10, {e}), {digits - 1}) * pow(10, {e}) END)"
