"""Every query that has a DuckDB form gives its rows, on the smallest tables; the rest gives rows."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return "nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    rows = sorted(repr(plain(tuple(r))) for r in df.collect())
    assert rows == sorted(repr(plain([r[i] for i in place])) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))))
def test_query_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
