"""Every registered query with oracle SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from career_lake.plans import registry
from career_lake.plans.bindings import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    want = table(columns, want.fetchall())
    assert table(got.columns, got.collect()) == want and want
