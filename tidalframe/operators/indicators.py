"""Extra indicators, each a source, a rolling score and a reading of the last row; a source that is missing reads as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from . import relational as R


def contrarian_reading(z: Column) -> Column:
    """Crowded long is bearish, crowded short bullish."""
    return F.when(z > 1, "bear").when(z < -1, "bull").otherwise("neutral")


def leverage_reading(z: Column) -> Column:
    return F.when(z > 1, "elevated leverage").when(z < -1, "light leverage").otherwise("normal")


def latest_reading(df: DataFrame, name: str, key: str, order: str, x: Column | str, window: int, reading=contrarian_reading) -> DataFrame:
    """``indicator, key, date, value, z, read`` of each key's last row with a score."""
    d = df.select(key, F.col(order).alias("date"), (F.col(x) if isinstance(x, str) else x).alias("value"))
    d = d.where(F.col("value").isNotNull()).withColumn("z", W.rolling_z("value", W.by(key, "date"), window)).where("z is not null")
    last = R.top_by(d, key, [F.desc("date")], 1)
    return last.select(F.lit(name).alias("indicator"), key, "date", "value", "z", reading(F.col("z")).alias("read"))


def all_indicators(parts: list[DataFrame | None], names: list[str], keys: DataFrame, key: str) -> DataFrame:
    """Every indicator of every key: ``available`` is false, and the reading ``n/a``, where a source is missing (None) or has no score."""
    grid = keys.select(F.col(key).cast("string").alias(key)).distinct().select(key, F.explode(F.array(*map(F.lit, names))).alias("indicator"))
    have = [p.withColumn(key, F.col(key).cast("string")) for p in parts if p is not None]
    if not have:
        return grid.select("indicator", key, F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("z"), F.lit("n/a").alias("read"), F.lit(False).alias("available"))
    found = have[0]
    for p in have[1:]:
        found = found.unionByName(p)
    out = grid.join(found, ["indicator", key], "left")
    return out.select("indicator", key, "date", "value", "z", F.coalesce("read", F.lit("n/a")).alias("read"), F.col("z").isNotNull().alias("available"))
