"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([cell(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(found.columns) == sorted(want_columns)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    assert len(got) == len(want)
    assert got == rows(want_columns, want)
