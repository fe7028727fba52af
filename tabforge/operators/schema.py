"""Logical column types, problem type and input validation (P1-P3, S4 core)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import nan_to_null

NUMERICAL, CATEGORICAL, DATETIME, VECTOR = "numerical", "categorical", "datetime", "vector"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Problem-type rule: at most this many target values means classification.
MAX_CLASSES = 10


class ValidationError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("Data validation failed: " + "; ".join(errors))
        self.errors = errors


def _string_failures(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, int, int]]:
    """Per string column: (non-null, not-a-number, not-a-timestamp) counts."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.isNotNull() & x.try_cast("double").isNull()).alias(f"b{i}"),
                 F.count_if(x.isNotNull() & F.try_to_timestamp(x).isNull()).alias(f"t{i}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"n{i}"], r[f"b{i}"], r[f"t{i}"]) for i, c in enumerate(cols)}


def _string_kind(n: int, bad_num: int, bad_ts: int) -> str:
    if n == 0 or bad_num == 0:
        return NUMERICAL          # an all-empty CSV column reads as float
    if bad_ts == 0:
        return DATETIME
    return CATEGORICAL


def detect_column_types(df: DataFrame) -> dict[str, str]:
    """``{column: numerical | categorical | datetime | vector}`` in column order."""
    kinds: dict[str, str] = {}
    strings = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, _NUMERIC):
            kinds[f.name] = NUMERICAL
        elif isinstance(t, _DATETIME):
            kinds[f.name] = DATETIME
        elif isinstance(t, T.StringType):
            strings.append(f.name)
            kinds[f.name] = None
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, _NUMERIC):
            kinds[f.name] = VECTOR
        else:
            kinds[f.name] = CATEGORICAL
    if strings:
        full = _string_failures(df, strings)
        for c in strings:
            kinds[c] = _string_kind(*full[c])
    return kinds


def column_types_frame(spark, kinds: dict[str, str]) -> DataFrame:
    rows = [(i, c, k) for i, (c, k) in enumerate(kinds.items())]
    return spark.createDataFrame(rows, "ordinal int, column_name string, kind string")


def apply_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast numeric-looking strings to double and NaN to NULL (pandas null model)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and kinds.get(f.name) == NUMERICAL:
            exprs.append(F.col(f.name).try_cast("double").alias(f.name))
        elif isinstance(f.dataType, T.StringType) and kinds.get(f.name) == DATETIME:
            exprs.append(F.try_to_timestamp(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return nan_to_null(df.select(*exprs))


def target_distinct(df: DataFrame, target: str, limit: int = MAX_CLASSES) -> int:
    """Exact distinct count of the target when it is small, else a lower bound.

    An approximate count screens first so a high-cardinality target never
    runs an exact distinct; only a small candidate set is counted exactly.
    """
    approx = df.agg(F.approx_count_distinct(target, 0.05).alias("a")).first()["a"]
    if approx > 2 * limit + 5:
        return int(approx)
    return df.where(F.col(target).isNotNull()).select(target).distinct().count()


def detect_problem_type(df: DataFrame, target: str, kinds: dict[str, str] | None = None) -> str:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset.")
    nd = target_distinct(df, target)
    if nd <= MAX_CLASSES:
        return "classification"
    kinds = kinds or detect_column_types(df.select(target))
    return "regression" if kinds.get(target) == NUMERICAL else "classification"


def problem_type_frame(df: DataFrame, target: str) -> DataFrame:
    """(target, n_distinct, problem_type) as a lazy one-row frame (exact distinct)."""
    is_num = isinstance(df.schema[target].dataType, _NUMERIC)
    return (df.agg(F.count_distinct(F.col(target)).alias("n_distinct"))
              .select(F.lit(target).alias("target"), F.col("n_distinct").cast("bigint"),
                      F.when(F.col("n_distinct") <= MAX_CLASSES, "classification")
                       .when(F.lit(is_num), "regression")
                       .otherwise("classification").alias("problem_type")))


def validation_frame(df: DataFrame, target: str) -> DataFrame:
    """One row per check: (check, passed, detail); all counts in one aggregation."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)]
    a = df.agg(*aggs)
    empty = F.filter(F.array(*[F.when(F.col(f"_c{i}") == 0, F.lit(c)) for i, c in enumerate(cols)]),
                     lambda x: x.isNotNull())
    return a.select(F.inline(F.array(
        F.struct(F.lit("min_rows").alias("check"), (F.col("_n") >= 10).alias("passed"),
                 F.col("_n").cast("string").alias("detail")),
        F.struct(F.lit("target_present").alias("check"), F.lit(target in cols).alias("passed"),
                 F.lit(target).alias("detail")),
        F.struct(F.lit("no_empty_columns").alias("check"), (F.size(empty) == 0).alias("passed"),
                 F.array_join(empty, ",").alias("detail")),
        F.struct(F.lit("min_columns").alias("check"), F.lit(len(cols) >= 2).alias("passed"),
                 F.lit(str(len(cols))).alias("detail")))))


def validate(df: DataFrame, target: str) -> None:
    """Collects every failed check, then raises once (like the reference)."""
    errors = []
    for r in validation_frame(df, target).collect():
        if not r["passed"]:
            errors.append({
                "min_rows": "Dataset has less than 10 rows. Too small to train.",
                "target_present": f"Target column '{target}' not found.",
                "no_empty_columns": f"These columns are completely empty: {r['detail'].split(',')}",
                "min_columns": "Dataset must have at least 2 columns.",
            }[r["check"]])
    if errors:
        raise ValidationError(errors)


def ingest_frame(df: DataFrame, target: str, key: list[str] | None = None):
    """Validate, type and classify.  Returns (typed df, kinds, problem_type)."""
    validate(df, target)
    kinds = detect_column_types(df)
    typed = apply_types(df, kinds)
    problem = detect_problem_type(typed, target, kinds)
    return typed, kinds, problem
