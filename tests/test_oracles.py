"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    out = QUERIES[name](spark, sf)
    got = rows_of(out.columns, [tuple(r) for r in out.collect()])
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert got == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["source", "tokens", "docs", "dropped_too_long", "windows"] and out.count() > 0
