"""Every relational query against its SQL on the smallest tables."""

import glob
import math

import duckdb
import pytest

from voltmill import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return con


def near(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-4, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    other = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert len(mine) == len(other)
    exact = [i for i, c in enumerate(columns) if not any(isinstance(r[i], float) for r in mine[:50] + other[:50])]
    key = lambda r: tuple(repr(r[i]) for i in exact)
    for a, b in zip(sorted(mine, key=key), sorted(other, key=key), strict=True):
        assert all(map(near, a, b)), (a, b)
