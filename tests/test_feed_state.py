"""Stateful processors of feeds take a key's batch of any size in plain columns and hand on bounded frames."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidalframe.operators.folds import Barometer
from tidalframe.streaming import feeds


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


class Handle:
    def __init__(self):
        self.value = Value()

    def getValueState(self, name, schema):  # noqa: N802
        return self.value


def batch(n, seed, column):
    rng = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, n, n), "s")
    x = rng.uniform(-5, 100, n).round(1)
    x[::50] = np.nan
    return pd.DataFrame({"ts": ts, column: x})


def parts(df):
    return (df[k : k + 10_000] for k in range(0, len(df), 10_000))


@pytest.mark.parametrize(("kind", "column"), [(feeds.TickState, "price"), (feeds.BarometerState, "x")])
def test_large_batches(kind, column):
    p = kind()
    p.init(Handle())
    first = batch(200_000, 1, column)
    tracemalloc.start()
    sizes = [len(f) for f in p.handleInputRows(("a",), parts(first), None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(sizes) <= 50_000 and peak < 100 * len(first)
    second = batch(500, 2, column)
    got = pd.concat(p.handleInputRows(("a",), parts(second), None), ignore_index=True)
    good = lambda f: f[f[column] > 0 if column == "price" else f[column].notna()].sort_values(["ts", column], kind="stable")
    before, now = good(first), good(second)
    assert list(got.ts) == list(now.ts) and list(got[column]) == list(now[column])
    if column == "price":
        previous = [before.price.iloc[-1], *now.price[:-1]]
        assert list(got.previous) == previous and np.allclose(got.change, (now.price - previous) * 100)
    else:
        b = Barometer()
        for v in before.x:
            b.update(v)
        want = [(b.update(v), b.mean, b.var**0.5) for v in now.x]
        assert list(zip(got.alert, got["mean"], got.sd, strict=True)) == want
