"""Versions of a composite: shared inputs, isolated failures, the blend, and that later rows change nothing."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import versions as V

DAY = dt.date(2000, 1, 7)
SMALL = {"z": 30, "short": 20, "long": 40, "flow": 4, "halflife": 10, "rounds": 20}


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = np.random.default_rng(6), []
    for k in ("a", "b"):
        net = {c: np.cumsum(rng.normal(size=140)) for c in ("am", "lev", "dealer")}
        for i in range(140):
            for c in net:
                for j, x in enumerate(("TU", "TY")):
                    if (k, i, c, x) != ("a", 5, "am", "TY"):
                        rows.append((k, DAY + dt.timedelta(weeks=i), x, c, float(net[c][i] * (1 + j) + rng.normal()), float(100 + i + j)))
    return spark.createDataFrame(rows, "k string, d date, i string, c string, net double, oi double").repartition(4)


def make(df, extra=None):
    return V.inputs(df, "k", "d", "i", "c", "net", "oi", scoring=["am", "lev"], front=["TU"], long=["TY"], extra=extra)


@pytest.fixture(scope="module")
def built(table):
    failing = {"bad": lambda inp, p: inp.table.select("k", "d", F.raise_error(F.lit("broken while it runs")).cast("double").alias("value")), "worse": lambda inp, p: inp.table.select("no_such_column")}
    rows, failed = V.build_all(make(table), SMALL, V.BUILDERS | failing)
    return {(r.version, r.k, r.d): r.value for r in rows.collect()}, failed


def test_inputs(table):
    rows = table.where("k = 'a'").collect()
    got = {r.d: r for r in make(table).table.where("k = 'a'").collect()}
    for d in (DAY, DAY + dt.timedelta(weeks=5)):
        mine = {(r.c, r.i): r.net for r in rows if r.d == d}
        at = lambda c, i, mine=mine: mine.get((c, i), 0.0)
        assert got[d].level == pytest.approx(sum(at(c, i) for c in ("am", "lev") for i in ("TU", "TY")))
        assert got[d].curve == pytest.approx(np.mean([at(c, "TU") - at(c, "TY") for c in ("am", "lev")])) and got[d].oi == sum({r.i: r.oi for r in rows if r.d == d}.values())
    assert got[DAY + dt.timedelta(weeks=5)].cell_am_TY is None


def test_failures_are_isolated(built):
    got, failed = built
    assert set(failed) == {"bad", "worse"} and "broken while it runs" in failed["bad"]
    assert {v for v, _, _ in got} == set(V.BUILDERS) | {"v9"}
    for v in {v for v, _, _ in got}:
        mine = [x for (n, _, _), x in got.items() if n == v]
        assert len(mine) == 280 and sum(x is not None for x in mine) > 100 and all(x is None or np.isfinite(x) for x in mine)
    assert all(0 <= x <= 100 for (v, _, _), x in got.items() if v == "v2" and x is not None)


def test_the_blend_is_the_mean_of_ranks(built):
    got, _ = built
    days = sorted({d for _, _, d in got})
    for n in (70, 139):
        ranks = []
        for v in V.BLENDED:
            held = [x for d in days[n - 19 : n + 1] if (x := got[v, "a", d]) is not None]
            ranks.append((sum(x < held[-1] for x in held) + 0.5 * sum(x == held[-1] for x in held)) / len(held))
        assert got["v9", "a", days[n]] == pytest.approx(np.mean(ranks) - 0.5)


def test_windows_and_filters_are_causal(table, built):
    got, _ = built
    early, _ = V.build_all(make(table.where(F.col("d") < DAY + dt.timedelta(weeks=100))), SMALL, {v: V.BUILDERS[v] for v in ("v2", "v3", "v6", "v7", "v8")})
    rows = early.collect()
    assert len(rows) == 6 * 200
    for r in rows:
        want = got[r.version, r.k, r.d]
        assert r.value is None if want is None else r.value == pytest.approx(want, abs=1e-9)


def test_nothing_to_build(table):
    with pytest.raises(ValueError, match="no version can be built"):
        V.build_all(make(table), SMALL, {"worse": lambda inp, p: inp.table.select("no_such_column")})


def test_frontier(table):
    inp = make(table)
    prices = inp.table.select("k", "d", (F.col("level") * -1).alias("p"))
    rows, _ = V.build_all(inp, SMALL, {v: V.BUILDERS[v] for v in ("v0", "v2", "v3", "v6")})
    got = V.frontier(rows, inp, prices, "p").collect()
    assert {(r.k, r.version) for r in got} == {(k, v) for k in "ab" for v in ("v0", "v2", "v3", "v6", "v9")}
    for k in "ab":
        mine = [r for r in got if r.k == k]
        for r in mine:
            assert r.best == (not any(q.turns_per_yr > r.turns_per_yr and q.hit > r.hit for q in mine)) and r.hit == pytest.approx(0.5 + r.ic / 2)
        assert next(r for r in mine if r.version == "v0").added is None
    z = {(r.k, r.d): r.z for r in V.comparable(rows).where("version = 'v2'").collect()}
    b = {(r.k, r.d): r.z for r in V.comparable(rows).where("version = 'v0'").collect()}
    p = {(r.k, r.d): r.p for r in prices.collect()}
    at = [(z[i], b[i], p[i[0], i[1] + dt.timedelta(weeks=8)] - p[i]) for i in z if i[0] == "a" and z[i] is not None and b[i] is not None and (i[0], i[1] + dt.timedelta(weeks=8)) in p]
    x, y, o = (np.array(c) for c in zip(*at, strict=True))
    left = lambda u: u - np.polyval(np.polyfit(y, u, 1), y)
    assert next(r for r in got if (r.k, r.version) == ("a", "v2")).added == pytest.approx(np.corrcoef(left(x), left(o))[0, 1])
