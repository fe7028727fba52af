"""CSV reader: NA tokens, quoted fields, numeric with nan, dates, mixed columns."""

import os

import pytest

from tabforge.sources.csv import read_csv


def test_csv_fixture(spark, tmpdir_session):
    path = os.path.join(tmpdir_session, "fixture.csv")
    with open(path, "w") as f:
        f.write('id,name,score,flag,day,mixed\n')
        f.write('1,"Smith, ""Jo""",1.5,true,2024-01-02,2024-01-02\n')
        f.write('2,NA,nan,False,2024-02-03,hello\n')
        f.write('3,,2.5,true,2024-03-04,\n')
    df = read_csv(spark, path)
    t = dict(df.dtypes)
    assert t["id"] == "bigint" and t["score"] == "double" and t["flag"] == "boolean"
    assert t["day"] == "timestamp" and t["mixed"] == "string"
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["name"] == 'Smith, "Jo"'
    assert rows[2]["name"] is None and rows[2]["score"] is None and rows[3]["name"] is None
    assert rows[2]["flag"] is False


def test_csv_errors(spark, tmpdir_session):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, os.path.join(tmpdir_session, "missing.csv"))
    p = os.path.join(tmpdir_session, "x.txt")
    open(p, "w").write("a\n1\n")
    with pytest.raises(ValueError):
        read_csv(spark, p)
