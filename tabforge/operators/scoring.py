"""Batch scoring from a saved pipeline.

The saved metadata carries the fitted imputation values and encoders, so
raw rows (with their original categorical columns) can be scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import Encoding, apply_encoding, apply_impute, fit_impute


class InputError(ValueError):
    pass


def required_columns(prep: dict) -> list[str]:
    """The raw columns that the model's features are made of."""
    enc, features = prep["encoding"], set(prep["features"])
    made = {c: {f"{c}_{v}" for v in vs} for c, vs in enc["onehot"].items()}
    return [c for c in prep.get("raw_features", []) if (made[c] if c in made else {c}) & features]


def validate_input(df: DataFrame, prep: dict) -> list[str]:
    """Missing expected columns raise (all listed); extra columns are returned and ignored."""
    need = required_columns(prep)
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise InputError(f"Missing columns: {missing}. These columns are required for prediction.")
    return [c for c in df.columns if c not in need and c not in prep.get("key", [])]


def preprocess_input(df: DataFrame, prep: dict, batch_stats: bool = False) -> DataFrame:
    """Project in training order, impute (training values, or the batch's own
    median/mode with ``batch_stats``), encode, and keep the selected features."""
    key = [c for c in prep.get("key", []) if c in df.columns]
    raw = required_columns(prep)
    out = df.select(*key, *raw)                                              # P9
    if batch_stats:
        vals = fit_impute(out, prep["kinds"], raw)
    else:
        vals = {c: v for c, v in prep.get("impute", {}).items() if c in raw}
    out = apply_impute(out, vals)
    enc = Encoding(label={c: v for c, v in prep["encoding"]["label"].items() if c in raw},
                   onehot={c: v for c, v in prep["encoding"]["onehot"].items() if c in raw}, dropped=[])
    out = apply_encoding(out, enc)
    if prep.get("scale"):
        out = out.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in prep["scale"].items() if c in out.columns})
    return out.select(*key, *prep["features"])


def predict(df: DataFrame, model, prep: dict, batch_stats: bool = False) -> DataFrame:
    """Key, prediction (original class label), probability, confidence = max prob x 100 (1 dp)."""
    validate_input(df, prep)
    x = preprocess_input(df, prep, batch_stats)
    out = model.transform(x)
    key = [c for c in prep.get("key", []) if c in df.columns]
    classes = prep.get("classes")
    if model.problem_type == "classification" and classes:
        m = F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(float(i)), F.lit(str(c)))])
        out = out.withColumn("predicted_label", m[F.col("prediction")])
        conf = F.bround(F.array_max("probability") * 100, 1)
        return out.select(*key, "prediction", "predicted_label", "probability", conf.alias("confidence"))
    return out.select(*key, "prediction")
