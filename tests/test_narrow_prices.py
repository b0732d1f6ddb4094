"""Regressions on weekly means that lie close together, as those of larger tables do: equal to their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

ORDERS = "/root/testdata/sf0.01/orders.parquet"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("narrow")
    duckdb.sql(f"COPY (SELECT * REPLACE ((240000 + (o_orderkey * 7919 % 500009) / 100.0)::DOUBLE AS o_totalprice) FROM '{ORDERS}') TO '{d}/orders.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["R01_newey_west", "R02_granger", "R05_influence"])
def test_equal_to_sql(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
