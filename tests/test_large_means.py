"""Least squares of columns whose means are large beside their deviations, as prices are, against centred numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidalframe.operators import linear


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(5)
    z = 241214 + rng.normal(0, 3000, 344).round(2)
    return z, (241000 + 0.04 * (z - 241214) + rng.normal(0, 3000, 344)).round(2)


@pytest.fixture(scope="module")
def table(spark, prices):
    z, y = prices
    rows = [("p", dt.date(1995, 1, 6) + dt.timedelta(weeks=k), float(a), float(b)) for k, (a, b) in enumerate(zip(y, z, strict=True))]
    return spark.createDataFrame(rows, "k string, d date, y double, z double")


def solved(y, *xs):
    """Slopes, residuals and the centred design, by QR in place of sums."""
    x = np.column_stack([v - v.mean() for v in xs])
    b = np.linalg.lstsq(x, y - y.mean(), rcond=None)[0]
    return b, y - y.mean() - x @ b, x


def test_betas(table, prices):
    z, y = prices
    b, e, _ = solved(y, z)
    fit = linear.ols(table, "y", ["z"])
    assert np.allclose(fit["coef"], [y.mean() - b[0] * z.mean(), b[0]], rtol=1e-10, atol=0)
    assert np.isclose(fit["ssr"], e @ e, rtol=1e-11) and np.isclose(fit["r2"], 1 - e @ e / ((y - y.mean()) ** 2).sum(), rtol=1e-9, atol=0)
    assert np.isclose(fit["se"][1], np.sqrt(e @ e / 342 / ((z - z.mean()) ** 2).sum()), rtol=1e-10)


def test_robust_errors(table, prices):
    z, y = prices
    b, e, x = solved(y, z)
    u = np.column_stack([np.ones(344), x]) * e[:, None]
    meat = sum((1 - h / 6) * ((s := u[h:].T @ u[: 344 - h]) + s.T) / (2 if h == 0 else 1) for h in range(6))
    fit = linear.newey_west(table, "k", "d", "y", ["z"], 5)
    var = (x[:, 0] ** 2).sum()
    se = np.sqrt(meat[1, 1]) / var
    level = np.array([1 / 344, -z.mean() / var])
    assert np.allclose(fit["se"], [np.sqrt(level @ meat @ level), se], rtol=1e-10, atol=0) and np.isclose(fit["coef"][1], b[0], rtol=1e-10)


def test_granger(table, prices):
    z, y = prices
    own, other = (y[1:-1], y[:-2]), (z[1:-1], z[:-2])
    short, full = (solved(y[2:], *xs)[1] for xs in (own, own + other))
    want = (short @ short - full @ full) / 2 / (full @ full / (342 - 5))
    got = linear.granger(table, "k", "d", "y", "z", 2)
    assert got["n"] == 342 and np.isclose(got["f"], want, rtol=1e-9, atol=0)


def test_influence(table, prices):
    z, y = prices
    _, e, x = solved(y, z)
    h = 1 / 344 + x[:, 0] ** 2 / (x[:, 0] ** 2).sum()
    cooks = e * e / (2 * (e @ e / 342)) * h / (1 - h) ** 2
    got = linear.influence(table, "y", "z").orderBy("d").select("leverage", "cooks").collect()
    assert np.allclose(np.array(got), np.column_stack([h, cooks]), rtol=1e-8, atol=1e-11)
