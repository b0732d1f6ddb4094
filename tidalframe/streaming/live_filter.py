"""The local linear trend as a stream, with variances that were frozen by an earlier fit.

``freeze`` fits once and stores a key's variances; ``live`` joins them to the
arriving values and keeps, for each key, the filter's mean and covariance in the
state store. What a stream has put out is what ``folds.local_linear_trend`` with
the same variances gives on the same rows, whatever the micro-batches and across
restarts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import trend_variances

VARIANCES = "key string, obs double, level double, slope double"


def freeze(df: DataFrame, key: str, order: str, x: str, path: str) -> DataFrame:
    """Fit each series' variances by likelihood and store them as JSON at ``path``; returns what was stored."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        obs, level, slope = trend_variances(pdf.sort_values(order)[x].to_numpy(float))
        return pd.DataFrame({"key": [str(pdf[key].iloc[0])], "obs": [obs], "level": [level], "slope": [slope]})

    df.select(key, order, x).groupBy(key).applyInPandas(fit, VARIANCES).write.mode("overwrite").json(path)
    return frozen(df.sparkSession, path)


def frozen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VARIANCES).json(path)


class TrendState(StatefulProcessor):
    """A key's trend filter: rows of a batch in event order, a missing value only predicts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("filter", "seen long, level double, slope double, p00 double, p01 double, p11 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, a, b, p00, p01, p11 = self.kept.get() if self.kept.exists() else (0, 0.0, 0.0, 1e7, 0.0, 1e7)
        out = []
        for ts, x, obs, level, slope in pd.concat(rows).sort_values("ts", kind="stable")[["ts", "x", "obs", "level", "slope"]].itertuples(index=False):
            if seen:
                a, p00, p01, p11 = a + b, p00 + 2 * p01 + p11 + level, p01 + p11, p11 + slope
            surprise = None
            if x is not None and math.isfinite(x):
                total = p00 + obs
                gap, g0, g1 = x - a, p00 / total, p01 / total
                surprise = gap / math.sqrt(total)
                a, b = a + g0 * gap, b + g1 * gap
                p00, p01, p11, seen = p00 - g0 * p00, p01 - g0 * p01, p11 - g1 * p01, seen + 1
            out.append((key[0], ts, None if x is None or x != x else float(x), a, b, surprise))
        self.kept.update((seen, a, b, p00, p01, p11))
        yield pd.DataFrame(out, columns=["key", "ts", "x", "level", "trend", "surprise"]).astype({"x": "float64", "surprise": "float64"}).replace({np.nan: None})

    def close(self) -> None:
        pass


def live(stream: DataFrame, variances: DataFrame) -> DataFrame:
    """``key, ts, x, level, trend, surprise`` of ``key, ts, x`` as they arrive; keys without frozen variances are left out.

    ``surprise``: the innovation over its deviation. A key's rows must arrive in
    order between batches; inside a batch they are sorted.
    """
    joined = stream.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("x").cast("double").alias("x")).join(variances, "key")
    return joined.groupBy("key").transformWithStateInPandas(TrendState(), "key string, ts timestamp, x double, level double, trend double, surprise double", "Append", "None")
