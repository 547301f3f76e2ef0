"""Text operators whose whole result SQL can express, against that SQL."""

import glob
import os

import duckdb
import pytest

from ripplescope.llm.queries import ORACLE, QUERIES

SF = os.environ.get("SQL_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return found


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.execute(ORACLE[name])
    told = [d[0] for d in want.description]
    assert sorted(told) == sorted(got.columns)
    rows = {tuple(r[told.index(c)] for c in got.columns) for r in want.fetchall()}
    mine = {tuple(r) for r in got.collect()}
    assert len(mine) == len(rows)
    assert sorted(mine - rows, key=str)[:3] == sorted(rows - mine, key=str)[:3] == []
