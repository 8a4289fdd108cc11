"""Queries against their DuckDB twins on the smallest driver tables, where they are there."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

from ledgerlane.plans.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (Decimal, float)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == names
    assert got == sorted((tuple(plain(r[there.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
