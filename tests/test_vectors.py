"""Models of vector columns against numpy on the same rows; rows that do not count."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import linear, vectors

DIM = 7


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, DIM)) @ np.diag(np.linspace(0.5, 2, DIM)) + 0.3
    x[:, 3] = x[:, 0] + 0.2 * x[:, 3]
    y = x @ np.linspace(-1, 1, DIM) + rng.normal(size=600)
    return x, y, (y + rng.normal(size=600) > 0.4).astype(int), np.digitize(y, [-1.5, 0.2, 2.0])


@pytest.fixture(scope="module")
def df(spark, data):
    x, y, t, c = data
    rows = [(k, v.tolist(), float(a), int(b), int(d)) for k, (v, a, b, d) in enumerate(zip(x, y, t, c, strict=True))]
    odd = [(-1, None, 1.0, 1, 1), (-2, [1.0], 1.0, 1, 1), (-3, [None] * DIM, 1.0, 1, 1), (-4, [float("nan")] * DIM, 1.0, 0, 0), (-5, x[0].tolist(), None, None, None), (-6, x[0].tolist(), float("nan"), None, None)]
    return spark.createDataFrame(rows + odd, "id int, v array<double>, y double, t int, c int").repartition(5).sortWithinPartitions(F.desc("id"))


def test_moments_are_sums(df, data):
    x, y, *_ = data
    n, g = vectors.moments(df, "v", [F.col("y")], DIM)
    z = np.column_stack([np.ones(len(x)), x, y])
    assert n == len(x)
    np.testing.assert_allclose(g, z.T @ z, rtol=1e-10)
    entries = {(r.i, r.j): r.total for r in vectors.gram_entries(df.where("id >= 0"), "v").collect()}
    assert len(entries) == DIM * (DIM + 1) // 2 and entries[(2, 5)] == pytest.approx((x[:, 2] * x[:, 5]).sum())


def test_nothing(df):
    n, g = vectors.moments(df.where("id < -90"), "v", [F.col("y")], DIM)
    assert n == 0 and not g.any() and vectors.width(df.where("id < -90"), "v") == 0


def test_components(df, data):
    x = data[0]
    good = df.where("id >= 0 or id = -1")
    model = vectors.pca(good, "v", 3)
    z = (x - x.mean(0)) / x.std(0)
    values, vecs = np.linalg.eigh(np.cov(z.T, ddof=1))
    np.testing.assert_allclose(model["values"], values[::-1][:3])
    got = {r.id: (r.pc1, r.pc2, r.pc3) for r in vectors.project(good, "v", model).collect()}
    assert got[-1] == (None, None, None)
    want = z @ vecs[:, ::-1][:, :3]
    np.testing.assert_allclose(np.abs([got[k] for k in range(len(x))]), np.abs(want), atol=1e-8)


def test_linear_models(df, data):
    x, y, *_ = data
    z = np.column_stack([np.ones(len(x)), x])
    got = vectors.linear_models(df, "v", F.col("y"), ridge=2.0, l1=0.05, mixed=(0.02, 0.3))
    np.testing.assert_allclose(got["ols"], np.linalg.lstsq(z, y, rcond=None)[0], atol=1e-8)
    np.testing.assert_allclose(got["ridge"], np.linalg.solve(z.T @ z + 2 * np.diag([0.0] + [1] * DIM), z.T @ y), atol=1e-8)
    sd = x.std(0)
    for name, l1, l2 in (("lasso", 0.05, 0.0), ("elastic_net", 0.02, 0.3)):
        b = got[name][1:] * sd
        e = y - z @ got[name]
        slope = ((x - x.mean(0)) / sd * e[:, None]).mean(0) - l2 * b
        assert abs(e.mean()) < 1e-9
        assert all(abs(s - np.sign(c) * l1) < 1e-6 if c else abs(s) <= l1 + 1e-9 for s, c in zip(slope, b, strict=True))


def test_inflation(df, data):
    x = data[0]
    df = df.where("id > -5")  # the others' vectors are whole
    got = vectors.variance_inflation(df, "v")
    for k in range(DIM):
        rest = np.delete(x, k, 1)
        e = x[:, k] - rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0]
        assert got[k] == pytest.approx((x[:, k] ** 2).sum() / (e**2).sum())
    named = df.where("id >= 0").select(*[F.col("v")[k].alias(f"x{k}") for k in range(DIM)])
    assert [f"x{k}" for k in vectors.independent(df, "v", 5.0)] == linear.drop_collinear(named, [f"x{k}" for k in range(DIM)], 5.0)


@pytest.mark.parametrize("link", ["logit", "cloglog"])
def test_binary_model_is_at_the_top(df, data, link):
    x, _, t, _ = data
    z = np.column_stack([np.ones(len(x)), x])

    def value(b):
        eta = z @ b
        p = 1 / (1 + np.exp(-eta)) if link == "logit" else 1 - np.exp(-np.exp(eta))
        return np.log(np.where(t == 1, p, 1 - p)).sum() - 0.5 * (b[1:] ** 2).sum()

    b = vectors.binary_model(df, "v", F.col("t"), link=link)
    for k in range(DIM + 1):
        for h in (1e-4, -1e-4):
            assert value(b + h * np.eye(DIM + 1)[k]) < value(b)
    with pytest.raises(ValueError):
        vectors.binary_model(df, "v", F.col("t"), link="probit")
    with pytest.warns(UserWarning, match="stopped"):
        vectors.binary_model(df, "v", F.col("t"), link=link, rounds=2)


def test_ordered_model_is_at_the_top(df, data):
    x, _, _, c = data
    slopes, cuts = vectors.ordered_model(df, "v", F.col("c"), 4, l2=0.01)

    def value(at):
        below = 1 / (1 + np.exp(-(np.concatenate([at[:3], [np.inf]])[None, :] - (x @ at[3:])[:, None])))
        p = np.diff(np.concatenate([np.zeros((len(x), 1)), below], 1))
        return np.log(p[np.arange(len(x)), c]).mean() - 0.005 * (at[3:] ** 2).sum()

    at = np.concatenate([cuts, slopes])
    assert (np.diff(cuts) > 0).all()
    for k in range(len(at)):
        for h in (1e-4, -1e-4):
            assert value(at + h * np.eye(len(at))[k]) < value(at)
    got = {r.id: r.probabilities for r in vectors.ordered_probabilities(df, "v", slopes, cuts).collect()}
    assert got[-1] is None and got[-2] is None
    below = 1 / (1 + np.exp(-(cuts - x[5] @ slopes)))
    np.testing.assert_allclose(got[5], np.diff([0, *below, 1]), atol=1e-10)
