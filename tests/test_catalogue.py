"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import pytest
from statewright.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(repr([r[c] for c in sorted(got.columns)]) for r in got.collect())
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert rows == sorted(repr([r[i] for i in order]) for r in want.fetchall())
