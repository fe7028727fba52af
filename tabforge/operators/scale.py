"""Robust scaling (X10): (x - median) / IQR fitted on training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles


def fit_robust(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Median and IQR per feature; a zero IQR scales by 1."""
    q = quantiles(train, features, [0.25, 0.5, 0.75])
    out = {}
    for f in features:
        q1, med, q3 = q[f] if q[f] is not None else (0.0, 0.0, 1.0)
        iqr = q3 - q1
        out[f] = (float(med), float(iqr) if iqr != 0 else 1.0)
    return out


def apply_robust(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f).cast("double") - F.lit(m)) / F.lit(s) for f, (m, s) in params.items()})
