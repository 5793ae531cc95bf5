"""Every query with SQL gives the same rows in DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}" if v else "0"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    ran = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    want = ran.fetchall()
    df = entry.queries()[name](spark, SF)
    order = sorted(df.columns)
    assert order == sorted(names), name
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    want = sorted(tuple(plain(r[i]) for i in at) for r in want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
