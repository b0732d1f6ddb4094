"""Every query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(str(tuple(plain(v) for v in row)) for row in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = entry.oracle_sql()[name]
    assert sorted(db.sql(sql).columns) == cols
    want = sorted(str(tuple(plain(v) for v in row)) for row in db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
