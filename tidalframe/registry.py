"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an inventory identifier and a name."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, n: int = 6) -> Column:
    """Rounded, without a negative zero: how queries report doubles."""
    return F.round(F.col(x) if isinstance(x, str) else x, n) + F.lit(0.0)


def r_all(df: DataFrame, n: int = 6, **digits: int) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[r(c, digits.get(c, n)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
