"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabforge.sources.tables import TABLES  # noqa: E402

_SPARK_T = {"LongType": "bigint", "IntegerType": "int", "DoubleType": "double", "StringType": "string",
            "BooleanType": "bool", "ShortType": "smallint", "FloatType": "float", "ByteType": "tinyint"}
_DUCK_T = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
           "BOOLEAN": "bool", "SMALLINT": "smallint", "FLOAT": "float", "TINYINT": "tinyint"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return round(v, 6)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def compare(spark_df, con, sql):
    sschema = [(f.name, _SPARK_T.get(type(f.dataType).__name__, type(f.dataType).__name__))
               for f in spark_df.schema.fields]
    srows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    dschema = [(n, _DUCK_T.get(str(t), str(t))) for n, t in zip(rel.columns, rel.types)]
    drows = rel.fetchall()
    problems = []
    if sorted(sschema) != sorted(dschema):
        problems.append(f"schema spark={sschema} duck={dschema}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duck={len(drows)}")
    sidx = sorted(range(len(sschema)), key=lambda i: sschema[i][0])
    didx = sorted(range(len(dschema)), key=lambda i: dschema[i][0])
    sv = sorted((tuple(_norm(r[i]) for i in sidx) for r in srows), key=_key)
    dv = sorted((tuple(_norm(r[i]) for i in didx) for r in drows), key=_key)
    if not problems and sv != dv:
        diffs = [(a, b) for a, b in zip(sv, dv) if a != b][:3]
        problems.append(f"values differ, e.g. {diffs}")
    return problems, len(srows)


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    import __spark_entry__ as E
    from tabforge.session import get_spark
    spark = get_spark("local[8]", 8, driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(a.sf)
    names = a.names or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, a.sf)
            if n in sqls:
                probs, nrows = compare(df, con, sqls[n])
            else:
                nrows, probs = df.count(), ["(rows only)"]
        except Exception as e:  # noqa: BLE001
            probs, nrows = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1
        dt = time.time() - t0
        ok = not probs or probs == ["(rows only)"]
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:32s} rows={nrows:<7} {dt:6.1f}s {'; '.join(probs)}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
