"""Every catalogue query against its SQL, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from ripplescope.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def same(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return found


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(ORACLE[name])
    told = [d[0] for d in want.description]
    assert sorted(told) == columns
    rows = sorted((tuple(same(r[told.index(c)]) for c in columns) for r in want.fetchall()), key=str)
    assert sorted((tuple(same(r[c]) for c in columns) for r in got.collect()), key=str) == rows


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
