"""Exploratory statistics.

Each table is one or two aggregations over the data: wide aggregates for
per-column scalars, a long (column, bin) grouping for histograms.  Nothing
is collected except a handful of fitted scalars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import round_half_even
from . import quality as qual
from .ranks import quantiles

HIST_BINS = 30
KDE_GRID = 200
WHIS = 1.5


def _long(items: list[tuple[int, str, Column]], value_name: str = "value") -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), e.alias(value_name))
        for i, c, e in items]))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """A2: distinct non-null values per column.

    ``exact=False`` returns HyperLogLog++ estimates (rsd 5 %), the screen used
    before any exact count on wide or huge tables.
    """
    cols = cols or df.columns
    f = (lambda c: F.count_distinct(F.col(c))) if exact else \
        (lambda c: F.approx_count_distinct(F.col(c), 0.05))
    a = df.agg(*[f(c).alias(f"d{i}") for i, c in enumerate(cols)])
    return a.select(_long([(i, c, F.col(f"d{i}").cast("bigint")) for i, c in enumerate(cols)], "n_distinct"))


def skewness_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adjusted Fisher-Pearson G1 (pandas ``skew``), 2 dp half-even.

    ``F.skewness`` is the population g1; G1 = g1 * sqrt(n(n-1)) / (n-2).
    Fewer than 3 values -> NULL; zero variance -> 0.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g{i}"), F.var_pop(x).alias(f"v{i}")]
    a = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        n, g, v = F.col(f"n{i}").cast("double"), F.col(f"g{i}"), F.col(f"v{i}")
        big_g = (F.when(n < 3, F.lit(None).cast("double"))
                  .when(v == 0, F.lit(0.0))
                  .otherwise(g * F.sqrt(n * (n - 1)) / (n - 2)))
        items.append((i, c, round_half_even(big_g, 2)))
    return a.select(_long(items, "skewness"))


def _pair_aggs(cols: list[str]):
    """Pairwise-complete moments for i<j: covariance and the two sds."""
    aggs, pairs = [], []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")
            both = a.isNotNull() & b.isNotNull()
            k = len(pairs)
            aggs += [F.covar_pop(a, b).alias(f"c{k}"),
                     F.stddev_pop(F.when(both, a)).alias(f"sa{k}"),
                     F.stddev_pop(F.when(both, b)).alias(f"sb{k}")]
            pairs.append((i, j))
    return aggs, pairs


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every ordered pair (pairwise-complete rows).

    ``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI, so r is
    covariance over the product of sds with ``try_divide``; NULL where a
    side is constant (pandas NaN).  One aggregation holds all d(d-1)/2 pairs.
    """
    aggs, pairs = _pair_aggs(cols)
    var = [F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]
    a = df.agg(*(aggs + var))
    structs = []
    for k, (i, j) in enumerate(pairs):
        r = F.try_divide(F.col(f"c{k}"), F.col(f"sa{k}") * F.col(f"sb{k}"))
        r = F.when((F.col(f"sa{k}") > 0) & (F.col(f"sb{k}") > 0), r)
        for x, y in ((i, j), (j, i)):
            structs.append(F.struct(F.lit(x).alias("i"), F.lit(cols[x]).alias("col_a"),
                                    F.lit(y).alias("j"), F.lit(cols[y]).alias("col_b"), r.alias("corr")))
    for i, c in enumerate(cols):
        structs.append(F.struct(F.lit(i).alias("i"), F.lit(c).alias("col_a"), F.lit(i).alias("j"),
                                F.lit(c).alias("col_b"),
                                F.when(F.col(f"v{i}") > 0, F.lit(1.0)).alias("corr")))
    return a.select(F.inline(F.array(*structs)))


def _ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    return df.agg(*aggs)


def histogram(df: DataFrame, cols: list[str], bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (numpy rule).

    A constant column gets the range [x-0.5, x+0.5].  Counts come from one
    grouping on (column, bin) whose partial aggregation collapses each
    partition to at most bins*d rows before the shuffle.
    """
    rng = _ranges(df, cols).first()
    edges = []
    for i, c in enumerate(cols):
        lo, hi = rng[f"lo{i}"], rng[f"hi{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        edges.append((i, c, float(lo), float(hi)))
    spark = df.sparkSession
    if not edges:
        return spark.createDataFrame([], "ordinal int, column_name string, bin int, bin_lo double, "
                                         "bin_hi double, count bigint")
    binned = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"),
                 F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) * F.lit(bins / (hi - lo))),
                         F.lit(bins - 1)).cast("int").alias("bin"))
        for i, c, lo, hi in edges]))).where(F.col("bin").isNotNull())
    counts = binned.groupBy("ordinal", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spark.createDataFrame(
        [(i, c, b, lo + b * (hi - lo) / bins, lo + (b + 1) * (hi - lo) / bins)
         for i, c, lo, hi in edges for b in range(bins)],
        "ordinal int, column_name string, bin int, bin_lo double, bin_hi double")
    # grid is bins*d rows by construction: a bounded broadcast
    return (F.broadcast(grid).join(counts, ["ordinal", "bin"], "left")
            .select("ordinal", "column_name", "bin", "bin_lo", "bin_hi",
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def kde(df: DataFrame, col: str, grid: int = KDE_GRID, bins: int = HIST_BINS) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth on ``grid`` points over [min, max].

    Each grid point is one running sum in a single aggregation, so rows are
    read once, never paired with the grid in a join.
    """
    x = F.col(col).cast("double")
    s = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"),
               F.max(x).alias("hi")).first()
    n, sd, lo, hi = s["n"], s["sd"], s["lo"], s["hi"]
    spark = df.sparkSession
    schema = "grid_index int, x double, density double, bin_count_scale double"
    if not n or n < 2 or not sd:
        return spark.createDataFrame([], schema)
    bw = sd * n ** (-0.2)
    pts = [lo + k * (hi - lo) / (grid - 1) for k in range(grid)]
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    sums = df.agg(*[F.sum(F.exp(F.lit(-0.5) * F.pow((F.lit(p) - x) / F.lit(bw), 2))).alias(f"k{k}")
                    for k, p in enumerate(pts)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("grid_index"), F.lit(p).alias("x"),
                 (F.col(f"k{k}") * F.lit(norm)).alias("density"),
                 # the curve in histogram-count units: density * n * bin width
                 (F.col(f"k{k}") * F.lit(norm) * F.lit(n) * F.lit((hi - lo) / bins)).alias("bin_count_scale"))
        for k, p in enumerate(pts)])))


def box_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 IQR, flier count."""
    qs = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        q = qs[c]
        x = F.col(c).cast("double")
        if q is None:
            aggs += [F.lit(None).cast("double").alias(f"wl{i}"), F.lit(None).cast("double").alias(f"wh{i}"),
                     F.lit(0).cast("bigint").alias(f"nf{i}")]
            continue
        iqr = q[2] - q[0]
        lo_f, hi_f = q[0] - WHIS * iqr, q[2] + WHIS * iqr
        aggs += [F.min(F.when(x >= F.lit(lo_f), x)).alias(f"wl{i}"),
                 F.max(F.when(x <= F.lit(hi_f), x)).alias(f"wh{i}"),
                 F.count_if((x < F.lit(lo_f)) | (x > F.lit(hi_f))).alias(f"nf{i}")]
    a = df.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        q = qs[c] or [None, None, None]
        structs.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
            F.lit(q[0]).cast("double").alias("q1"), F.lit(q[1]).cast("double").alias("median"),
            F.lit(q[2]).cast("double").alias("q3"),
            F.lit(None if q[0] is None else q[2] - q[0]).cast("double").alias("iqr"),
            F.col(f"wl{i}").alias("whisker_lo"), F.col(f"wh{i}").alias("whisker_hi"),
            F.col(f"nf{i}").cast("bigint").alias("n_fliers")))
    return a.select(F.inline(F.array(*structs)))


def box_fliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every value outside the whiskers' fences with its count, per column (one scan after the quartiles)."""
    qs = quantiles(df, cols, [0.25, 0.75])
    found = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        lo, hi = qs[c] or (None, None)
        if lo is not None:
            iqr = hi - lo
            out = (x < F.lit(lo - WHIS * iqr)) | (x > F.lit(hi + WHIS * iqr))
            found.append(F.when(out, F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), x.alias("value"))))
    if not found:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, value double, n long")
    return (df.select(F.inline(F.array_compact(F.array(*found))))
              .groupBy("ordinal", "column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def missing_bars(df: DataFrame) -> DataFrame:
    """Unrounded missing %, > 0, descending."""
    return (qual.missing_table(df).select("ordinal", "column_name", F.col("missing_raw").alias("missing_pct"))
            .orderBy(F.desc("missing_pct"), "ordinal"))


def eda_stats(df: DataFrame, kinds: dict[str, str], target: str) -> DataFrame:
    """A10: one-row summary; the missing figures share a single aggregation."""
    cols = df.columns
    n_num = sum(1 for c in cols if kinds.get(c) == "numerical")
    n_cat = sum(1 for c in cols if kinds.get(c) == "categorical")
    a = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
               F.count_distinct(F.col(target)).alias("tu"))
    tot = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0))
    frac = sum((F.try_divide(F.col(f"m{i}"), F.col("n")) for i in range(len(cols))), F.lit(0.0))
    dup = qual.duplicate_table(df).first()["duplicate_rows"]
    stats = a.select(
        F.col("n").cast("bigint").alias("total_rows"), F.lit(len(cols)).alias("total_columns"),
        F.lit(n_num).alias("numerical_columns"), F.lit(n_cat).alias("categorical_columns"),
        tot.cast("bigint").alias("total_missing_values"),
        round_half_even(frac / len(cols) * 100.0, 2).alias("missing_percentage"),
        F.lit(target).alias("target_column"), F.col("tu").cast("bigint").alias("target_unique_values"),
        F.lit(dup).cast("bigint").alias("duplicate_rows"))
    return stats
