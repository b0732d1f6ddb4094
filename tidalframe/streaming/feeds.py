"""Streaming operators: live text, ticks, dedupe, stateful barometers, event-time windows.

Sources are files that producers drop; the checkpoint is the read position.
State is bounded by a watermark. Each function maps a stream (or a batch, for
tests) to a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Barometer

FEED = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])


def tail(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Lines of JSON (or raw text) that producers drop into a folder, as they come."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)


def parse_feed(lines: DataFrame, least: int = 10) -> DataFrame:
    """``ts, text`` of lines: JSON where it parses, else the raw line now; shorter texts are dropped."""
    d = F.from_json("value", "struct<timestamp: timestamp, chunk_index: int, text: string>")
    x = lines.select(d.alias("d"), F.col("value"))
    out = x.select(F.coalesce("d.timestamp", F.current_timestamp()).alias("ts"), F.trim(F.coalesce("d.text", "value")).alias("text"))
    return out.where(F.length("text") >= least)


def first_seen(feed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row a text fingerprint within the watermark: state is bounded, unlike a set of all ever seen."""
    return feed.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("fp", F.md5("text")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fp"])


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and means in tumbling or sliding event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """A user's events with less than ``gap`` between them."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


#: Rows that a processor hands on at a time.
_HANDED = 50_000


def _in_order(rows: Iterator[pd.DataFrame], x: str, keep) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a key's rows of a batch in order of both, unknown times last.

    Held as two plain columns, 16 bytes a row, whatever the frames carry.
    """
    parts = []
    for f in rows:
        ts, v = f["ts"].to_numpy(), f[x].to_numpy(float)
        at = keep(ts, v)
        parts.append((ts[at], v[at]))
    if not parts:
        return np.empty(0, "M8[ns]"), np.empty(0)
    ts, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order = np.lexsort((v, np.where(np.isnat(ts), np.iinfo(np.int64).max, ts.view(np.int64))))
    return ts[order], v[order]


class TickState(StatefulProcessor):
    """Previous price and change (times 100) of each source, in event order within each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else np.nan
        ts, price = _in_order(rows, "price", lambda ts, v: v > 0)
        if len(price):
            self.last.update((float(price[-1]),))
        for k in range(0, len(price), _HANDED):
            now = price[k : k + _HANDED]
            previous = np.concatenate([[last], now[:-1]])
            last = now[-1]
            yield pd.DataFrame({"source": key[0], "ts": ts[k : k + _HANDED], "price": now, "previous": previous, "change": (now - previous) * 100})

    def close(self) -> None:
        pass


def ticks(stream: DataFrame) -> DataFrame:
    return stream.groupBy("source").transformWithStateInPandas(TickState(), "source string, ts timestamp, price double, previous double, change double", "Append", "None")


class BarometerState(StatefulProcessor):
    """A posterior a key, updated in event order within each batch: a key's chunks of a batch are sorted together."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, total double, up double, down double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b = Barometer()
        if self.state.exists():
            b.n, b.total, b.up, b.down = self.state.get()
        ts, x = _in_order(rows, "x", lambda ts, v: ~np.isnan(v) & ~np.isnat(ts))
        for k in range(0, len(x), _HANDED):
            now = x[k : k + _HANDED]
            mean, sd, alert = np.empty(len(now)), np.empty(len(now)), np.empty(len(now), np.int32)
            for i, v in enumerate(now.tolist()):
                alert[i] = b.update(v)
                mean[i], sd[i] = b.mean, b.var**0.5
            yield pd.DataFrame({"meeting": key[0], "ts": ts[k : k + _HANDED], "x": now, "mean": mean, "sd": sd, "alert": alert})
        self.state.update((b.n, b.total, b.up, b.down))

    def close(self) -> None:
        pass


def live_barometer(stream: DataFrame) -> DataFrame:
    return stream.groupBy("meeting").transformWithStateInPandas(BarometerState(), "meeting string, ts timestamp, x double, mean double, sd double, alert int", "Append", "None")


def append_feed(stream: DataFrame, folder: str, checkpoint: str):
    """Append to a folder of JSON files, once each; returns the query for its caller to stop."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def inject(rows: DataFrame, folder: str) -> None:
    """Put ``timestamp, chunk_index, text`` into a feed's folder as a producer does: JSON lines, appended."""
    rows.select(F.to_json(F.struct("timestamp", "chunk_index", "text")).alias("value")).write.mode("append").text(folder)


def with_callback(stream: DataFrame, callback, folder: str, checkpoint: str) -> DataFrame:
    """What ``callback`` (a table to a table) makes of each micro-batch there is now, each batch stored once under its number."""
    spark, out = stream.sparkSession, f"{folder}/batch="

    def put(batch: DataFrame, k: int) -> None:
        callback(batch).write.mode("overwrite").parquet(f"{out}{k}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}*")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a table written by the stream."""
    spark = stream.sparkSession

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={k}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch=*")
