"""Column dropping, imputation and encoding.

Fitting returns small driver-side parameter objects (medians, modes, sorted
category lists); applying them is a single projection with the fitted
values as literals, so every row is touched once and nothing is joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import quantiles

# Fixed values of the column rules.
MAX_MISSING_PCT = 70.0
MAX_ONEHOT = 15
# Categories collected exactly only below this approximate distinct count
# (well above MAX_ONEHOT, so the HLL error (rsd 5 %) cannot change a decision).
CATEGORY_SCREEN = 64
# Largest class count a classification target may have.
MAX_CLASSES = 10_000


def useless_columns(df: DataFrame, target: str, kinds: dict[str, str],
                    exclude: list[str] | None = None) -> DataFrame:
    """(ordinal, column_name, reason) with the first matching rule per column.

    Rules in order: more than 70 % missing; every row distinct (an ID);
    datetime.  The distinct test is screened with HyperLogLog and run
    exactly only for columns whose estimate is near the row count.
    """
    exclude = set(exclude or [])
    cols = [c for c in df.columns if c != target and c not in exclude]
    spark = df.sparkSession
    a = df.agg(F.count(F.lit(1)).alias("_n"),
               *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)],
               *[F.approx_count_distinct(F.col(c), 0.05).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    n = a["_n"]
    cand = [c for i, c in enumerate(cols) if a[f"a{i}"] >= 0.8 * n and n > 0]
    exact = {}
    if cand:
        e = df.agg(*[F.count_distinct(F.col(c)).alias(f"e{i}") for i, c in enumerate(cand)]).first()
        exact = {c: e[f"e{i}"] for i, c in enumerate(cand)}
    rows = []
    for i, c in enumerate(cols):
        miss = (n - a[f"c{i}"]) / n * 100 if n else 0.0
        if miss > MAX_MISSING_PCT:
            rows.append((i, c, "missing"))
        elif exact.get(c, -1) == n:
            rows.append((i, c, "id"))
        elif kinds.get(c) == "datetime":
            rows.append((i, c, "datetime"))
    return spark.createDataFrame(rows, "ordinal int, column_name string, reason string")


def fit_impute(df: DataFrame, kinds: dict[str, str], cols: list[str], every: bool = False) -> dict[str, object]:
    """X1/X2 (A12, A13): median for numeric, smallest mode for categorical.

    Only columns that have nulls get a value, with ``every`` all of them (so rows scored later may have nulls
    where training had none).  Both are exact at any size.
    """
    if not cols:
        return {}
    a = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.approx_count_distinct(F.col(c), 0.05).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    need = [(i, c) for i, c in enumerate(cols) if every or a[f"m{i}"] > 0]
    if not need:
        return {}
    aggs, wide = [], {}
    for i, c in need:
        if kinds.get(c) != "numerical" and a[f"d{i}"] > CATEGORY_SCREEN:
            # many values: counted as rows, not in one value -> count map
            top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
            wide[c] = top[c] if top else None
            continue
        if kinds.get(c) != "numerical":
            aggs.append(F.mode(F.col(c), deterministic=True).alias(f"v{i}"))
    medians = quantiles(df, [c for _, c in need if kinds.get(c) == "numerical"], [0.5])
    wide |= {c: q[0] if q else None for c, q in medians.items()}
    r = df.agg(*aggs).first() if aggs else {}
    return {c: wide[c] if c in wide else r[f"v{i}"] for i, c in need}


def apply_impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fitted values re-enter as literals in one projection.

    A median between two integers (2.5) makes its integer column a double one."""
    def filled(c, v):
        t = df.schema[c].dataType
        if isinstance(v, float) and isinstance(t, T.IntegralType) and not v.is_integer():
            t = T.DoubleType()
        return F.coalesce(F.col(c).cast(t), F.lit(v).cast(t))

    values = {c: v for c, v in values.items() if c in df.columns}
    return df.withColumns({c: filled(c, v) for c, v in values.items()}) if values else df


@dataclass
class Encoding:
    """Fitted encoders: sorted category lists per column and the plan for each."""
    label: dict[str, list[str]] = field(default_factory=dict)     # X3, 2 values
    onehot: dict[str, list[str]] = field(default_factory=dict)    # X4, all sorted values
    dropped: list[str] = field(default_factory=list)              # P5, > 15 values
    target_classes: list | None = None                            # X5

    def feature_columns(self, base: list[str]) -> list[str]:
        """Encoded feature order: kept columns in place, one-hot columns appended."""
        out = [c for c in base if c not in self.dropped and c not in self.onehot]
        for c in base:
            if c in self.onehot:
                out += [onehot_name(c, v) for v in self.onehot[c][1:]]
        return out


def onehot_name(col: str, value) -> str:
    return f"{col}_{value}"


def _sort_key(v):
    return (0, v) if isinstance(v, (int, float)) else (1, str(v))


def fit_encoding(df: DataFrame, kinds: dict[str, str], target: str, problem_type: str,
                 cols: list[str] | None = None) -> Encoding:
    """Per categorical column (after imputation): 2 values -> label codes,
    <= 15 -> one-hot without the first sorted category, more -> dropped.
    Class labels are indexed 0..C-1 in sorted order (X5)."""
    cols = [c for c in (cols or df.columns) if kinds.get(c) == "categorical" and c != target]
    enc = Encoding()
    if cols:
        a = df.agg(*[F.approx_count_distinct(F.col(c), 0.05).alias(f"a{i}") for i, c in enumerate(cols)]).first()
        small = [(i, c) for i, c in enumerate(cols) if a[f"a{i}"] <= CATEGORY_SCREEN]
        vals = {}
        if small:
            r = df.agg(*[F.collect_set(F.col(c).cast("string")).alias(f"s{i}") for i, c in small]).first()
            vals = {c: sorted(r[f"s{i}"]) for i, c in small}
        for c in cols:
            v = vals.get(c)
            if v is None or len(v) > MAX_ONEHOT:
                enc.dropped.append(c)
            elif len(v) == 2:
                enc.label[c] = v
            else:
                enc.onehot[c] = v
    if problem_type == "classification":
        # a class list is a per-class table; refuse (rather than truncate) an unbounded one
        r = (df.where(F.col(target).isNotNull()).select(target).distinct().limit(MAX_CLASSES + 1).collect())
        if len(r) > MAX_CLASSES:
            raise ValueError(f"Target '{target}' has more than {MAX_CLASSES} classes.")
        enc.target_classes = sorted((x[0] for x in r), key=_sort_key)
    return enc


def apply_encoding(df: DataFrame, enc: Encoding, target: str | None = None,
                   label_col: str = "label") -> DataFrame:
    """Label codes and one-hot columns are added in the same projection."""
    new: dict[str, Column] = {}
    for c, v in enc.label.items():
        if c in df.columns:
            new[c] = F.when(F.col(c).cast("string") == F.lit(v[1]), 1).when(F.col(c).isNotNull(), 0).cast("int")
    for c, vs in enc.onehot.items():
        if c in df.columns:
            for v in vs[1:]:
                new[onehot_name(c, v)] = (F.col(c).cast("string") == F.lit(v)).cast("int")
    out = df.withColumns(new) if new else df
    out = out.drop(*[c for c in list(enc.onehot) + enc.dropped if c in df.columns])
    if target is not None and enc.target_classes is not None and target in df.columns:
        m = F.create_map(*[x for i, v in enumerate(enc.target_classes) for x in (F.lit(v), F.lit(float(i)))])
        out = out.withColumn(label_col, m[F.col(target)])
    return out


def bool_to_int(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Boolean feature columns become 0/1 integers."""
    cols = set(cols if cols is not None else df.columns)
    conv = {f.name: F.col(f.name).cast("int") for f in df.schema.fields
            if f.dataType.typeName() == "boolean" and f.name in cols}
    return df.withColumns(conv) if conv else df
