from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidalframe.operators import evaluate, folds, linear, ml, optimize, simulate, survival
from tidalframe.operators import relational as R
from tidalframe.sources import files


def series(spark, values, key="a"):
    rows = [(key, dt.date(2024, 1, 1) + dt.timedelta(days=k), None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, d date, x double")


def column(df, name, order="d"):
    return [row[0] for row in df.orderBy(order).select(name).collect()]


Z = [0, 2.0, 1.0, 0.4, -2.0, None, 2.5, 2.0]


def test_two_state_machines(spark):
    df = series(spark, Z)
    assert column(folds.hysteresis(df, "k", "d", "x", 2.0, 0.5), "signal") == [0, -1, -1, 0, 1, 1, -1, -1]
    assert column(folds.contrarian(df, "k", "d", "x", 2.0, 0.5), "stance") == [0, 0, 0, 0, 0, 0, -1, -1]


def test_validation(spark):
    df = series(spark, [1, 2])
    assert R.validate(df, {"x": "double"}, ["d"]).count() == 2
    with pytest.raises(R.SchemaError):
        R.validate(df, {"y": "double"}, ["d"])
    with pytest.raises(R.SchemaError):
        R.validate(df, {"x": "double"}, ["k"])
    with pytest.raises(R.SchemaError):
        R.validate(df.limit(0), {"x": "double"}, ["d"])


def test_asof_kinds(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 7, 70.0)], "k string, t int, v double")
    get = lambda **o: {(r.k, r.t): r.v for r in R.asof(left, right, "t", ["k"], ["v"], **o).collect()}
    assert get() == {("a", 1): None, ("a", 5): 50.0, ("a", 9): 70.0, ("b", 1): None}
    assert get(strict=True)[("a", 5)] is None
    assert get(direction="forward") == {("a", 1): 50.0, ("a", 5): 50.0, ("a", 9): None, ("b", 1): None}


def test_episodes_break_on_null(spark):
    e = R.episodes(series(spark, [2, 3, None, 2, 0, -2]), "k", "d", "x", 1.0).orderBy("start").collect()
    assert [(r.side, r.weeks, r.peak) for r in e] == [(1, 2, 3.0), (1, 1, 2.0), (-1, 1, -2.0)]


def test_panel_of_weeks(spark):
    ev = spark.createDataFrame([("i", 0, 1), ("i", 0, 1), ("i", 5, 1), ("i", 60, 1)], "issuer string, wk int, n int")
    p = {r.wk: r for r in survival.build_panel(ev, "issuer", "wk", "n").collect()}
    assert min(p) == 1 and p[5].weeks_since_last == 5 and p[6].weeks_since_last == 1
    assert p[52].issues_trailing_52w == 3 and p[53].issues_trailing_52w == 1


def test_panel_makes_the_grid_after_the_last_shuffle(spark):
    rng = np.random.default_rng(8)
    ev = [("a", 3, 0), ("a", 9, 2), ("b", 50, 1), ("c", 8, 1), *[("d", int(w), int(k)) for w, k in zip(rng.integers(0, 200, 25), rng.integers(0, 3, 25), strict=True)]]
    events = spark.createDataFrame(ev, "issuer string, wk int, n int")
    for last, cap, trailing in ((None, 260, 52), (40, 12, 5)):
        want = set()
        for key in "abcd":
            seen = [(w, n) for i, w, n in ev if i == key]
            for w in range(min(w for w, _ in seen) + 1, (max(w for _, w, _ in ev) if last is None else last) + 1):
                before = [v for v, n in seen if n and v < w]
                want.add((key, w, min([cap, *(w - v for v in before)]), sum(n for v, n in seen if w - trailing <= v < w), int(any(v == w and n for v, n in seen))))
        panel = survival.build_panel(events, "issuer", "wk", "n", last, cap, trailing)
        got = [tuple(r) for r in panel.collect()]
        assert len(got) == len(want) and set(got) == want
        plan = panel._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(sequence") < plan.index("Window")


def test_grid_query_holds_every_issuer(spark, tmp_path):
    day, end = dt.date(1995, 1, 3), dt.date(1995, 1, 3) + dt.timedelta(weeks=70)
    orders = [(k, day + dt.timedelta(weeks=w)) for k in range(1, 13) for w in (k % 4, k % 4, 20 + k, 60)] + [(3, end)]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    want = set()
    for k in range(1, 13):
        at = [(d - day).days // 7 for i, d in orders if i == k]
        for w in range(min(at) + 1, 71):
            want.add((k, w, int(w in at), w - max(a for a in at if a < w), sum(w - 52 <= a < w for a in at)))
    got = entry.queries()["R23_issuer_week_grid_whole"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hazard_link_query_holds_every_order(spark, tmp_path):
    orders = [(k, 30000.0 * k) for k in range(25)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.h for r in entry.queries()["F07_hazard_link_whole"](spark, str(tmp_path)).collect()}
    assert got.keys() == {k for k, _ in orders}
    assert all(math.isclose(h, 1 - math.exp(-math.exp(max(-0.3 * k, -30))), abs_tol=1e-8) for k, h in got.items())


def test_horizons(spark):
    h = spark.createDataFrame([("i", 1, 0.1), ("i", 2, 0.2), ("i", 3, 0.3)], "k string, s int, hazard double")
    p = lambda spec: survival.timing_probability(h, "k", "s", spec).first().probability
    assert math.isclose(p(("within", 2)), 0.28) and math.isclose(p(("interval", 2, 3)), 0.396) and math.isclose(p(("recurrent", 2, 3)), 0.44)
    s = column(survival.survival(h, "k", "s", "hazard"), "survival", "s")
    assert np.allclose(s, [0.9, 0.72, 0.504])


def test_ordered_logit_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.12, (1500, 2))
    y = np.digitize(x @ [6.0, -4.0] + rng.logistic(size=1500), [-0.7, 0.9])
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(y, x, strict=True)], "y int, a double, b double")
    fit = ml.ordered_logit(df, "y", ["a", "b"])

    def loss(t):
        cum = 1 / (1 + np.exp(-(t[2:] - (x @ t[:2])[:, None])))
        p = np.column_stack([cum[:, 0], cum[:, 1] - cum[:, 0], 1 - cum[:, 1]])[np.arange(1500), y]
        return -np.log(p).mean() + 1e-3 / 2 * (t[:2] ** 2).sum()

    slope = [(loss(fit + e) - loss(fit - e)) / 2e-5 for e in 1e-5 * np.eye(4)]
    assert np.abs(slope).max() < 1e-7
    with pytest.warns(UserWarning, match="after 2 rounds"):
        ml.ordered_logit(df, "y", ["a", "b"], rounds=2)


def motions(spark):
    return spark.createDataFrame([("a", 4.0, 0.0, 0.2), ("b", 1.0, 0.1, 0.3), ("none", None, 0.1, 0.3)], "k string, start double, mu double, sigma double")


def test_paths_of_a_table_of_parameters(spark):
    p = simulate.gbm_paths(motions(spark), "k", 10000, 30, 42)
    assert {(r.k, r["count"]) for r in p.groupBy("k").count().collect()} == {("a", 310000), ("b", 310000)}
    got = {r.k: r for r in simulate.desk_metrics(p, "k", 1.05, 0.95).collect()}
    again = {r.k: r for r in simulate.desk_metrics(simulate.gbm_paths(motions(spark).repartition(7), "k", 10000, 30, 42), "k", 1.05, 0.95).collect()}
    assert again.keys() == got.keys() and all(np.allclose(again[k][1:], got[k][1:], rtol=1e-12) for k in got)
    rows = np.array([(r.path, r.step, r.value) for r in p.where("k = 'a'").collect()])
    level = np.zeros((10000, 31))
    level[rows[:, 0].astype(int), rows[:, 1].astype(int)] = rows[:, 2]
    pnl = -(level[:, -1] - 4) * 100
    var = np.percentile(pnl, 5)
    assert np.allclose([got["a"].touch, got["a"].var, got["a"].shortfall], [(level.max(1) >= 4.2).mean(), var, pnl[pnl <= var].mean()])
    fan = {(r.k, r.step): r for r in simulate.closed_form_fan(motions(spark).dropna(), "k", 30).collect()}
    assert abs(np.percentile(level[:, 30], 95) / fan["a", 30].q95 - 1) < 0.01 and abs(np.median(level[:, 30]) / fan["a", 30].q50 - 1) < 0.01


def test_other_processes(spark):
    h = spark.createDataFrame([("a", 1.0, 0.0, 0.04, 3.0, 0.04, 0.2, -0.5)], "k string, start double, mu double, v0 double, kappa double, theta double, xi double, rho double")
    s = simulate.path_summary(simulate.heston_paths(h, "k", 20000, 20, 3), "k").where("step = 20").first()
    assert s.n == 20000 and math.isclose(s.mean, 1.0, abs_tol=0.003) and math.isclose(s.sd, 0.2 * math.sqrt(20 / 252), rel_tol=0.05)
    v = spark.createDataFrame([("a", 3.0, 5.0, 2.0, 0.4)], "k string, start double, kappa double, mean double, sigma double")
    for root in (False, True):
        s = simulate.path_summary(simulate.mean_reverting_paths(v, "k", 4000, 252, 3, root), "k").where("step = 252").first()
        assert math.isclose(s.mean, 2 + math.exp(-5), abs_tol=0.03)


def test_ew_moments_against_pandas():
    v = np.array([1.0, 2.0, np.nan, 4.0, 3.0, 8.0])
    mean, var, _ = folds.ew_moments(v, 3)
    e = pd.Series(v).ewm(halflife=3, adjust=True)
    assert np.allclose(mean, e.mean()) and np.allclose(var[1:], e.var()[1:])


def test_splice_has_no_jump(spark):
    rows = [("a", dt.date(2024, 1, 1), 100.0, 110.0, 1), ("a", dt.date(2024, 1, 2), 101.0, 111.0, 1), ("a", dt.date(2024, 1, 3), 112.11, 120.0, 2)]
    df = spark.createDataFrame(rows, "k string, d date, n double, f double, c int")
    out = folds.spliced_returns(df, "k", "d", "n", "f", "c").orderBy("d").collect()
    assert out[2].roll == 1 and math.isclose(out[2].ret, 112.11 / 111 - 1) and out[0].ret is None


def test_barometer_variance_falls():
    b, seen = folds.Barometer(), []
    for x in (57, 57, 90, 90):
        seen.append((b.update(x), b.var))
    assert all(a[1] > c[1] for a, c in zip(seen, seen[1:], strict=False))
    assert seen[2][0] == 1 and b.interval()[1] <= 100


def test_ols_and_curve(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]}))
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)
    assert np.allclose(linear.ols(df, "y", ["a", "b"])["coef"], want)
    assert np.allclose(linear.elastic_net(df, "y", ["a", "b"], 0.0), want)
    assert np.allclose(linear.huber(df, "y", ["a", "b"]), want, atol=0.05)
    tau, lam, beta = np.array([1, 2, 3, 5, 10, 20.0]), 0.0609, (4, -2, 1)
    s = (1 - np.exp(-tau * lam)) / (tau * lam)
    v = beta[0] + beta[1] * s + beta[2] * (s - np.exp(-tau * lam))
    rows = [("p", float(t), float(q)) for t, q in zip(tau, v, strict=True)] + [("q", 1.0, 2.0), ("q", 2.0, 2.0)]
    out = {r.d: r for r in linear.curve_factors(spark.createDataFrame(rows, "d string, t double, y double"), "d", "t", "y", lam).collect()}
    assert np.allclose([out["p"].b0, out["p"].b1, out["p"].b2], beta, atol=1e-5) and out["p"].rmse < 1e-5 and out["q"].b0 is None


def test_pca_sign_and_scale(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=300)
    pdf = pd.DataFrame({c: s * f + rng.normal(size=300) * 0.2 for c, s in (("a", 1), ("b", 2), ("c", -1))})
    model = linear.pca(spark.createDataFrame(pdf), ["a", "b", "c"], 2)
    z = (pdf - pdf.mean()) / pdf.std(ddof=0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(model["values"], values[:2]) and model["loadings"][0, 0] > 0


def test_glm_recovers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y.astype(int)}))
    assert np.allclose(linear.glm(df, "y", ["x"]), [0.3, 1.2], atol=0.2)


def test_distribution_functions():
    assert math.isclose(optimize.t_sf(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(optimize.chi2_sf(3.841, 1), 0.05, abs_tol=1e-4)
    assert math.isclose(optimize.f_sf(4.965, 1, 10), 0.05, abs_tol=1e-4)


def test_simulated_moments(spark):
    one = spark.createDataFrame([("a", 1.0, 0.0, 0.2)], "k string, start double, mu double, sigma double")
    p = simulate.path_summary(simulate.gbm_paths(one, "k", 20000, 10, 1), "k").where("step = 10").first()
    assert p.n == 20000 and math.isclose(p.mean, 1.0, abs_tol=0.003) and math.isclose(p.sd, 0.2 * math.sqrt(10 / 252), rel_tol=0.05)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double")
    assert evaluate.auc(df, "y", "p").first().auc == 0.875


def test_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Date,A,B\n2024-01-01,1.5,.\n2024-01-02,,2\nbad,1,1\n")
    rows = sorted((str(r.date), r.series, r.value) for r in files.wide_csv(spark, str(tmp_path / "w.csv")).collect())
    assert rows == [("2024-01-01", "A", 1.5), ("2024-01-02", "B", 2.0)]
    (tmp_path / "p.csv").write_text('terms\nmore\n"OBSERVATIONS"\n"date","X","Y"\n"2024-01-01","1","2"\n"2024-01-02","","3"\n')
    rows = sorted((str(r.date), r.series, r.value) for r in files.preamble_csv(spark, str(tmp_path / "p.csv"), "OBSERVATIONS").collect())
    assert rows == [("2024-01-01", "X", 1.0), ("2024-01-01", "Y", 2.0), ("2024-01-02", "Y", 3.0)]
    (tmp_path / "o.json").write_text('{"value": [{"data": "2024-01-01", "valor": "4.5"}, {"data": "2024-01-02", "valor": null}]}')
    rows = files.json_observations(spark, str(tmp_path / "o.json"), "value", "data", "valor", F.lit("s")).collect()
    assert [(str(r.date), r.value) for r in rows] == [("2024-01-01", 4.5)]
    assert files.or_empty(lambda: files.wide_csv(spark, str(tmp_path / "none.csv")), spark).count() == 0


def test_feed_formats(spark):
    rss = "<rss><item><title>A &amp; b</title><link>http://x/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item></rss>"
    atom = '<feed><entry><title>C</title><link href="http://x/2"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom)], "s string, t string")
    rows = {r.source: r for r in files.feed_items(df, "t", F.col("s")).collect()}
    assert rows["r"].url == "http://x/1" and rows["a"].url == "http://x/2" and rows["r"].ts is not None and rows["a"].ts is not None


def test_global_ranks_do_not_depend_on_where_ranges_are_cut(spark):
    n = 400_000
    df = spark.range(n, numPartitions=7).select(F.col("id").alias("i"), (F.xxhash64("id") % 50_000 / 1000).alias("p"), (F.xxhash64("id", F.lit(3)) % 3 == 0).cast("int").alias("y"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = evaluate.auc(df, "y", "p").first().auc
        ranked = R.global_row_number(df, [F.col("p"), F.col("i")], "k").orderBy("k").select("p", "i", "k").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pdf = df.toPandas()
    rank = pdf["p"].rank().to_numpy()
    pos = pdf["y"].to_numpy() == 1
    want = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert math.isclose(got, want, rel_tol=1e-12)
    assert (ranked["k"].to_numpy() == np.arange(1, n + 1)).all()
    assert ranked[["p", "i"]].to_numpy().tolist() == pdf[["p", "i"]].sort_values(["p", "i"]).to_numpy().tolist()


def test_change_points_by_listing_every_segmentation():
    rng = np.random.default_rng(4)
    x, hazard, recent = np.concatenate([rng.normal(0, 0.3, 4), rng.normal(4, 0.3, 5)]), 0.2, 2

    def predictive(v, run):
        kappa, alpha = 1 + len(run), 1 + len(run) / 2
        mu = sum(run) / kappa
        beta = 1 + 0.5 * (sum(r * r for r in run) - kappa * mu * mu)
        s, d = math.sqrt(beta * (kappa + 1) / (alpha * kappa)), 2 * alpha
        return math.gamma((d + 1) / 2) / math.gamma(d / 2) / math.sqrt(d * math.pi) / s * (1 + ((v - mu) / s) ** 2 / d) ** (-(d + 1) / 2)

    got = folds.bocpd(x, hazard, recent)
    for t in range(1, len(x) + 1):
        mass = {}
        for bits in range(1 << t):  # whether a run ends after each value
            p, run = 1.0, []
            for k in range(t):
                p *= predictive(x[k], run)
                run = [*run, x[k]]
                end = bits >> k & 1
                p *= hazard if end else 1 - hazard
                run = [] if end else run
            mass[len(run)] = mass.get(len(run), 0.0) + p
        assert math.isclose(got[t - 1], sum(p for n, p in mass.items() if n <= recent) / sum(mass.values()), rel_tol=1e-9)


def test_barometer_moves_before_its_chart():
    b = folds.Barometer()
    alerts = [b.update(v) for v in (90.0, 90.0, 10.0)]
    means, sums = [], []
    for n, total in ((1, 90.0), (2, 180.0), (3, 190.0)):
        means.append((57 / 180 + total / 120) / (1 / 180 + n / 120))
    up = max(0, 90 - means[0] - 3)
    sums.append(up)
    assert alerts[0] == (1 if up > 15 else 0) == 0 and math.isclose(b.mean, means[2])
    assert math.isclose(b.var, 1 / (1 / 180 + 3 / 120))
    assert alerts[1] == (1 if up + 90 - means[1] - 3 > 15 else 0) and alerts[2] == -1 and b.down == 0.0


def test_phase_of_a_cosine_advances():
    period = 20
    osc = np.cos(2 * np.pi * np.arange(60) / period)
    p = folds.hilbert_phase(osc, period)
    assert p["phase"][0] == 0 and p["amplitude"][0] == osc[0]
    quad = (osc[:-1] - osc[1:]) / (2 * math.sin(math.pi / period))
    assert np.allclose(np.diff(np.unwrap(np.arctan2(quad, osc[1:]))).mean(), 2 * np.pi / period, atol=0.01)
    assert np.allclose(p["sine"][1:], np.sin(np.arctan2(quad, osc[1:])))


def test_lag_weighted_regression_finds_its_weights(spark):
    from tidalframe.operators import validation

    rng = np.random.default_rng(6)
    lags, u = rng.normal(size=(900, 6)), np.arange(1, 7) / 7
    w = u**1.0 * (1 - u) ** 4.0
    w /= w.sum()
    y = 0.5 + 2.0 * lags @ w + rng.normal(0, 0.05, 900)
    df = spark.createDataFrame([(float(a), [float(v) for v in b]) for a, b in zip(y, lags, strict=True)], "y double, lags array<double>")
    fit = validation.lag_weighted_regression(df, "y", "lags", 6)
    assert np.abs(fit["weights"] - w).max() < 0.02 and np.allclose(fit["coef"], [0.5, 2.0], atol=0.03)
    x = np.column_stack([np.ones(900), lags @ fit["weights"]])
    assert math.isclose(fit["rss"], ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum(), rel_tol=1e-8)
    assert fit["rss"] <= ((y - 0.5 - 2.0 * lags @ w) ** 2).sum()
