"""ANSI-safe arithmetic and rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(a: Column, b: Column) -> Column:
    """NULL when the divisor is 0 or NULL (bare '/' raises under ANSI)."""
    return F.try_divide(a, b)


def round_half_even(c: Column, scale: int) -> Column:
    """numpy / Python style rounding (half to even)."""
    return F.bround(c, scale)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, as pandas treats both as missing."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)
