"""Every query against its SQL in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bitlattice import queries as index_queries


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.fixture(scope="session")
def duck(sf):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def test_every_query_has_sql():
    assert index_queries.QUERIES.keys() == index_queries.ORACLE.keys()
    assert entry.queries().keys() >= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", index_queries.QUERIES)
def test_query(spark, sf, duck, name):
    got = index_queries.QUERIES[name](spark, sf)
    want = duck.execute(index_queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    rows = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in want.fetchall()]
    mine = [tuple(r[c] for c in columns) for r in got.collect()]
    rows, mine = sorted(rows, key=repr), sorted(mine, key=repr)
    assert len(rows) == len(mine)
    assert all(same(x, y) for a, b in zip(rows, mine, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 7 and sum(r["n"] for r in rows) == 6000
