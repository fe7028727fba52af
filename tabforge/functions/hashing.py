"""Stable hash order.

Every randomised step (split, folds, resampling, shuffles, random search)
draws from md5 of the row key and a seed, so results do not depend on
partitioning or task order and can be re-derived in plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_TWO32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(keys: Sequence, seed=SEED, salt: str | None = None) -> Column:
    """md5 hex of ``k1|k2|...|seed[|salt]``; keys must be integral or strings."""
    parts = [_col(k).cast("string") for k in keys] + [F.lit(str(seed))]
    if salt is not None:
        parts.append(F.lit(str(salt)))
    return F.md5(F.concat_ws("|", *parts))


def hash_int(h: Column, digits: int = 8) -> Column:
    """Integer from the first ``digits`` hex digits (<= 15)."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def hash_unit(h: Column) -> Column:
    """Uniform double in [0, 1) from the first 8 hex digits."""
    return hash_int(h, 8) / F.lit(_TWO32)


# SQL twins (DuckDB dialect) used by the oracle queries.
def hash_hex_sql(keys: Sequence[str], seed=SEED, salt: str | None = None) -> str:
    parts = [f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{seed}'"]
    if salt is not None:
        parts.append(f"'{salt}'")
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def hash_int_sql(h: str, digits: int = 8) -> str:
    return f"CAST(('0x' || substr({h}, 1, {digits})) AS BIGINT)"


def hash_unit_sql(h: str) -> str:
    return f"({hash_int_sql(h)} / {_TWO32})"
