"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from accrete.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    expected = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda it, names: sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in it)
    assert rows(got.collect(), got.columns) == rows(expected.fetchall(), expected.columns)
