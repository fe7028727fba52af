"""Exact order statistics of many columns at once (A12, A20, X1, X10), at any size.

A wanted rank is enclosed by two values and the interval between them narrows: a quantile sketch of the values inside
proposes two pivots around the rank, one aggregate counts the rows below, at and between them, and the rank lies at
a pivot (done) or in one of the open intervals they leave.  A sketch cannot mislead, it only proposes; every round
drops the pivots' own values, and with a sketch of ACCURACY about one value in ACCURACY / 4 stays inside.  As soon as few values are left
they are sorted.  All columns and ranks share the two scans of a round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative rank accuracy of the sketch (1 / ACCURACY of the values inside).
ACCURACY = 2_000
#: Values of one interval that are sorted in an aggregation buffer.
SORT_ROWS = 1 << 14


@dataclass
class _Wanted:
    column: Column
    rank: int                      # from 0, among all values of the column
    inside: int                    # values in the open interval
    below: int = 0                 # values up to and including its lower end
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    def x(self) -> Column:
        """The value where it lies inside, else null."""
        x, inside = self.column, F.lit(True)
        if self.lo is not None:
            inside = inside & (x > F.lit(self.lo))
        if self.hi is not None:
            inside = inside & (x < F.lit(self.hi))
        return F.when(inside, x)

    def shares(self) -> list[float]:
        """Where in the interval the pivots are looked for."""
        at, margin = (self.rank - self.below) / self.inside, 2 / ACCURACY
        return [max(0.0, at - margin), min(1.0, at + margin)]

    def narrow(self, a: float, b: float, less: int, at_a: int, between: int, at_b: int) -> None:
        """Pivots a <= b, and how many values inside are less than a, a, between, b."""
        r = self.rank - self.below
        if r < less:
            self.hi, self.inside = a, less
        elif r < less + at_a:
            self.value = a
        elif r < less + at_a + between:
            self.below, self.lo, self.hi, self.inside = self.below + less + at_a, a, b, between
        elif r < less + at_a + between + at_b:
            self.value = b
        else:
            passed = less + at_a + between + at_b
            self.below, self.lo, self.inside = self.below + passed, b, self.inside - passed


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], counts: dict[str, int]) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0, nulls left out, NaN largest) of each column, which has so many values."""
    todo = {(c, r): _Wanted(F.col(f"`{c}`").cast("double"), r, counts[c]) for c, ranks in wanted.items() for r in set(ranks)}
    while True:
        wide = [w for w in todo.values() if w.value is None and w.inside > SORT_ROWS]
        if not wide:
            break
        got = df.agg(*[F.percentile_approx(w.x(), F.array(*map(F.lit, w.shares())), F.lit(ACCURACY)).alias(f"p{i}") for i, w in enumerate(wide)]).first()
        tests = []
        for i, w in enumerate(wide):
            (a, b), x = got[f"p{i}"], w.x()
            conditions = (x < F.lit(a), x == F.lit(a), (x > F.lit(a)) & (x < F.lit(b)), (x == F.lit(b)) & (x > F.lit(a)))
            tests += [F.count_if(c).alias(f"n{i}_{k}") for k, c in enumerate(conditions)]
        n = df.agg(*tests).first()
        for i, w in enumerate(wide):
            w.narrow(*got[f"p{i}"], *(n[f"n{i}_{k}"] for k in range(4)))
    last = {k: w for k, w in todo.items() if w.value is None}
    if last:
        found = df.agg(*[F.sort_array(F.collect_list(w.x()))[w.rank - w.below].alias(f"v{i}") for i, w in enumerate(last.values())]).first()
        for i, w in enumerate(last.values()):
            w.value = found[f"v{i}"]
    return {k: w.value for k, w in todo.items()}


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column (the rule of numpy and of ``percentile``); None for a column without values."""
    if not cols:
        return {}
    n = df.agg(*[F.count(F.col(f"`{c}`").cast("double")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    counts = {c: n[f"n{i}"] for i, c in enumerate(cols)}
    places = {c: [p * (counts[c] - 1) for p in probs] for c in cols if counts[c]}
    values = order_statistics(df, {c: [r for x in at for r in (math.floor(x), math.ceil(x))] for c, at in places.items()}, counts)

    def between(c: str, x: float) -> float:
        lo, hi = math.floor(x), math.ceil(x)
        a, b = values[c, lo], values[c, hi]
        return a if lo == hi or a == b else (hi - x) * a + (x - lo) * b
    return {c: [between(c, x) for x in places[c]] if c in places else None for c in cols}
