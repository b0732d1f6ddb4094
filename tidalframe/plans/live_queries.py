"""Live operators on streams of the tables: the trend filter with frozen parameters (X10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, r_all
from ..session import shared_folder
from ..streaming import feeds, live_filter
from .analogues import weekly
from .model_queries import TREND

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("X10_live_filter", f"WITH RECURSIVE {TREND} SELECT series_id AS key, CAST(date AS VARCHAR) AS date, round(a, 4) + 0.0 AS level, round(b, 4) + 0.0 AS trend, round(surprise, 4) + 0.0 AS surprise FROM p JOIN v USING (series_id, i)")
def _(spark, d):
    """The weekly series as two files, the second for a second run of the stream, which goes on where the first stopped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = shared_folder(spark)
    rows = weekly(spark, d).select(F.col("series_id").alias("key"), F.col("date").cast("timestamp").alias("ts"), (F.col("value") / 1e5).alias("x"))
    rows.select(F.col("key"), F.lit(0.05).alias("obs"), F.lit(0.01).alias("level"), F.lit(0.0001).alias("slope")).distinct().write.json(f"{base}/frozen")
    out = None
    for part in (F.col("ts") < "1998-03-01", F.col("ts") >= "1998-03-01"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{base}/rows")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/rows")
        out = feeds.run_once(live_filter.live(stream, live_filter.frozen(spark, f"{base}/frozen")), f"{base}/out", f"{base}/ck")
    return r_all(out.select("key", F.date_format("ts", "yyyy-MM-dd").alias("date"), "level", "trend", "surprise"), 4)
