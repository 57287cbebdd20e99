"""Every registered fact query against the same question put to another engine."""

import duckdb
import pytest

from factloom.plans import queries as _queries  # noqa: F401
from factloom.plans import source_queries as _source_queries  # noqa: F401
from factloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    other = duck.sql(ORACLES[name])
    assert sorted(other.columns) == columns
    order = [other.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in other.fetchall()), key=repr)
