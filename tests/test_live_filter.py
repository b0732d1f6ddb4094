"""The live filter against the batch filter: over micro-batches, after a restart, with gaps."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from tidalframe.operators import folds
from tidalframe.streaming import feeds, live_filter

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_stream_is_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rng, at, rows = random.Random(3), dt.datetime(2020, 1, 1), []
    for k in ("a", "b", "c", "late"):
        level = 5.0
        for i in range(60):
            level += rng.gauss(0.1, 0.3)
            if k != "late" or i >= 35:
                rows.append((k, at + dt.timedelta(days=i), None if i % 13 == 4 else level + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "key string, ts timestamp, x double")
    params = live_filter.freeze(df.where("key <> 'c'"), "key", "ts", "x", f"{tmp_path}/frozen")
    fixed = {r.key: (r.obs, r.level, r.slope) for r in params.collect()}
    assert set(fixed) == {"a", "b", "late"} and all(v > 0 for p in fixed.values() for v in p)
    out = None
    for a, z in ((0, 10), (10, 11), (11, 40), (40, 60)):  # a run of the stream each, from the same checkpoint
        part = df.where((df.ts >= at + dt.timedelta(days=a)) & (df.ts < at + dt.timedelta(days=z)))
        part.coalesce(1).orderBy("ts", ascending=False).write.mode("append").parquet(f"{tmp_path}/rows")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
        out = feeds.run_once(live_filter.live(stream, live_filter.frozen(spark, f"{tmp_path}/frozen")), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {(r.key, r.ts): r for r in out.collect()}
    assert len(got) == out.count() == sum(k != "c" for k, _, _ in rows)
    for k in fixed:
        mine = df.where(df.key == k)
        for r in folds.local_linear_trend(mine, "key", "ts", "x", fixed[k]).collect():
            g = got[k, r.ts]
            assert (g.level, g.trend) == (pytest.approx(r.level, rel=1e-9), pytest.approx(r.trend, rel=1e-6, abs=1e-9))
            assert (g.x is None) == (g.surprise is None) == (r.x is None)
            assert g.surprise is None or math.isfinite(g.surprise)
