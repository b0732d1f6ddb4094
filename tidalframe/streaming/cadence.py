"""Which source speaks, when a cache is pulled again, and starting and stopping feeds."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.folds import grouped


def failover(ticks: DataFrame, key: str, ts: str, source: str, priority: list[str], patience: timedelta) -> DataFrame:
    """``ticks`` of the first source by ``priority`` heard within ``patience``, with a column ``active``.

    A lower source speaks only while all above it have been silent longer than
    that; ticks of one instant count as heard. Sources not listed never speak.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    recent = Window.partitionBy(key).orderBy(at).rangeBetween(-(patience // timedelta(microseconds=1)), 0)
    heard = [F.when(F.max(F.when(F.col(source) == s, 1)).over(recent) == 1, F.lit(s)) for s in priority]
    return ticks.where(F.col(ts).isNotNull()).withColumn("active", F.coalesce(*heard)).where(F.col(source) == F.col("active"))


def refreshes(reads: DataFrame, key: str, ts: str, ttl: timedelta) -> DataFrame:
    """``reads`` with ``pulled``: whether a read finds the cached table ``ttl`` old or older and pulls it anew.

    The first read pulls; the age counts from the last pull, so this is a fold
    over a key's reads. A read without a time pulls nothing.
    """

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        last, pulled = None, []
        for t in pdf[ts]:
            pulls = not pd.isna(t) and (last is None or t - last >= ttl)
            last = t if pulls else last
            pulled.append(pulls)
        return pdf.assign(pulled=pulled)

    return grouped(reads.select(key, ts), key, ts, {"pulled": "boolean"}, f)


def start(feed: DataFrame, name: str, folder: str, every: str = "3 seconds") -> StreamingQuery:
    """The named feed, written as Parquet under ``folder``; a feed that runs already is returned as it is."""
    running = active(feed.sparkSession, name)
    if running is not None:
        return running
    return feed.writeStream.queryName(name).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start(f"{folder}/rows")


def active(spark: SparkSession, name: str) -> StreamingQuery | None:
    return next((q for q in spark.streams.active if q.name == name), None)


def stop(spark: SparkSession, name: str, drain: bool = True) -> bool:
    """Whether the named feed ran; what has arrived is processed first if ``drain``."""
    running = active(spark, name)
    if running is None:
        return False
    if drain:
        running.processAllAvailable()
    running.stop()
    return True
