"""Further inventory rows: compositions of the operators on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, scalars
from ..functions import windows as W
from ..operators import composites as C
from ..operators import calibrated, folds, resampling
from ..operators import relational as R
from ..registry import query, r, r_all, table
from .analogues import DAILY, MONTHLY, PAIR, POSITIONS, WEEKLY, daily, monthly, pair, positions, weekly


def _by():
    return W.by("series_id", "date")


def _text_date(df, name="date"):
    return df.withColumn(name, F.col(name).cast("string"))


@query("P04_target_series", f"""WITH {DAILY}, c AS (SELECT * FROM daily WHERE date <= DATE '2000-12-15'), m AS (SELECT series_id, last_day(date) AS month, arg_max(value, date) AS v FROM c GROUP BY ALL)
    SELECT series_id, CAST(month AS VARCHAR) AS date, round(v / lag(v) OVER w - 1, 8) + 0.0 AS mom, round(v / lag(v, 12) OVER w - 1, 8) + 0.0 AS yoy FROM m WINDOW w AS (PARTITION BY series_id ORDER BY month)""")
def _(spark, d):
    cutoff = dates.add_business_days(F.lit("2000-12-20").cast("date"), -3)
    m = daily(spark, d).where(F.col("date") <= cutoff).groupBy("series_id", F.last_day("date").alias("date")).agg(F.max_by("value", "date").alias("v"))
    return _text_date(m.select("series_id", "date", r(W.pct_change("v", _by()), 8).alias("mom"), r(W.pct_change("v", _by(), 12), 8).alias("yoy")))


@query("P08_rating_notch", "SELECT n_nationkey, CAST(CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 10 END AS INTEGER) AS notch FROM nation")
def _(spark, d):
    s = F.element_at(F.array(*[F.lit(v) for v in ("AAA", " aa− watch", "BBB− /stable", "none")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", scalars.rating_notch(s).alias("notch"))


@query("J04_grid_asof", f"""WITH {WEEKLY}, {POSITIONS}, g AS (SELECT DISTINCT date FROM positions), m AS (SELECT last_day(date) AS date, sum(n) AS n FROM weekly GROUP BY ALL)
    SELECT CAST(g.date AS VARCHAR) AS date, CAST(m.n AS BIGINT) AS n FROM g ASOF LEFT JOIN m ON g.date >= m.date""")
def _(spark, d):
    grid = positions(spark, d).select("date").distinct().withColumn("k", F.lit(0))
    m = weekly(spark, d).groupBy(F.last_day("date").alias("date")).agg(F.sum("n").alias("n")).withColumn("k", F.lit(0))
    return _text_date(R.asof(grid, m, "date", ["k"], ["n"]).select("date", "n"))


@query("J08_static_join", "SELECT c_mktsegment, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def _(spark, d):
    j = table(spark, d, "orders").select("o_custkey", "o_orderstatus").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


@query("J17_added_deviation", f"""WITH {PAIR}, z AS (SELECT date, CASE WHEN count(*) OVER f >= 13 THEN (y - avg(y) OVER f) / stddev_pop(y) OVER f END AS a, CASE WHEN count(*) OVER f >= 13 THEN (z - avg(z) OVER f) / stddev_pop(z) OVER f END AS b FROM pair WINDOW f AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
    SELECT CAST(date AS VARCHAR) AS date, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM z WHERE abs(a) > 1.5 AND abs(b) < 1""")
def _(spark, d):
    p = pair(spark, d).select("date", W.rolling_z("y", _by(), 26, 13).alias("a"), W.rolling_z("z", _by(), 26, 13).alias("b"))
    return _text_date(r_all(p.where("abs(a) > 1.5 and abs(b) < 1")))


@query("A02_curve_net", f"WITH {POSITIONS} SELECT CAST(date AS VARCHAR) AS date, sum(CASE WHEN instrument = 'F' THEN net ELSE 0 END) - sum(CASE WHEN instrument = 'O' THEN net ELSE 0 END) AS curve FROM positions WHERE category = 'N' GROUP BY date")
def _(spark, d):
    leg = lambda i: F.sum(F.when(F.col("instrument") == i, F.col("net")).otherwise(0.0))
    return _text_date(positions(spark, d).where("category = 'N'").groupBy("date").agg((leg("F") - leg("O")).alias("curve")))


@query("A05_cells_and_totals", f"WITH {POSITIONS} SELECT CAST(date AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS cells, sum(net) AS net, sum(open_interest) AS oi FROM positions GROUP BY date")
def _(spark, d):
    return _text_date(positions(spark, d).groupBy("date").agg(F.count("*").alias("cells"), F.sum("net").alias("net"), F.sum("open_interest").alias("oi")))


@query("A11_subperiods", f"WITH {WEEKLY}, p(name, a, b) AS (VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1998-01-01', DATE '2001-12-31')) SELECT series_id, name, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) + 0.0 AS mean FROM weekly JOIN p ON date BETWEEN a AND b GROUP BY ALL")
def _(spark, d):
    name = F.when(F.col("date").between("1995-01-01", "1997-12-31"), "early").when(F.col("date").between("1998-01-01", "2001-12-31"), "late")
    return r_all(weekly(spark, d).withColumn("name", name).where("name is not null").groupBy("series_id", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 4)


@query("A18_A19_holding", f"""WITH {WEEKLY}, z AS (SELECT *, CASE WHEN count(value) OVER f >= 13 THEN (value - avg(value) OVER f) / stddev_pop(value) OVER f END AS z FROM weekly WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    p AS (SELECT series_id, date, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 ELSE 0 END AS p FROM z), l AS (SELECT *, lag(p) OVER (PARTITION BY series_id ORDER BY date) AS b FROM p),
    g AS (SELECT *, sum(CASE WHEN b = p THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY date) AS run FROM l), q AS (SELECT series_id, run, count(*) AS n FROM g WHERE p <> 0 GROUP BY ALL)
    SELECT series_id, CAST(e.entries AS BIGINT) AS entries, round(q.holding, 8) + 0.0 AS holding, CAST(q.runs AS BIGINT) AS runs FROM (SELECT series_id, sum(CASE WHEN coalesce(b, 0) = 0 AND p <> 0 THEN 1 ELSE 0 END) AS entries FROM l GROUP BY 1) AS e LEFT JOIN (SELECT series_id, avg(n) AS holding, count(*) AS runs FROM q GROUP BY 1) AS q USING (series_id)""")
def _(spark, d):
    z = weekly(spark, d).withColumn("z", W.rolling_z("value", _by(), 26, 13))
    p = z.select("series_id", "date", F.when(F.col("z") > 1, 1).when(F.col("z") < -1, -1).otherwise(0).alias("p"))
    return r_all(R.average_holding(p, "series_id", "date", "p"), 8)


@query("F03_contract_dv01", """WITH c AS (SELECT p_partkey, p_size AS tenor, p_retailprice AS face, coalesce(CASE WHEN p_partkey % 7 > 0 THEN 2 + p_partkey % 5 END, 3) / 100.0 AS y FROM part), f AS (SELECT *, y / 2 + CASE WHEN k = 2 * tenor THEN 1 ELSE 0 END AS flow FROM c, unnest(range(1, 2 * tenor + 1)) AS r(k))
    SELECT p_partkey, round(any_value(face) * 100 * sum(k / 2.0 * flow / (1 + y / 2) ** k) / (1 + any_value(y) / 2) * 1e-4, 6) + 0.0 AS dv01 FROM f GROUP BY 1""")
def _(spark, d):
    """Parts as contracts: size is the tenor, price the notional in hundreds, yields in percent with every seventh missing."""
    y = F.when(F.col("p_partkey") % 7 > 0, 2 + F.col("p_partkey") % 5)
    return table(spark, d, "part").select("p_partkey", r(scalars.contract_dv01("p_size", y, F.col("p_retailprice") * 100)).alias("dv01"))


@query("F04_neutral_legs", "SELECT s_suppkey, round(-1000.0 * (s_suppkey % 7 + 1) / (s_suppkey % 3 + 2), 6) + 0.0 AS other FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", r(scalars.neutral_notional(F.lit(1000.0), F.col("s_suppkey") % 7 + 1, F.col("s_suppkey") % 3 + 2)).alias("other"))


@query("F08_share_of_interest", f"WITH {POSITIONS} SELECT CAST(date AS VARCHAR) AS date, instrument, category, round(net / nullif(open_interest / 1e6, 0), 4) + 0.0 AS pct FROM positions")
def _(spark, d):
    return _text_date(positions(spark, d).select("date", "instrument", "category", r(F.try_divide(F.col("net"), F.col("open_interest") / 1e6), 4).alias("pct")))


@query("F14_scenario_table", """WITH t AS (SELECT o_orderstatus AS scenario, o_orderpriority AS topic, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS v, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders),
    s AS (SELECT scenario, (t.v / a.v - 1) * 10000 AS bps, CASE WHEN topic <> '5-LOW' THEN n / sum(n) OVER (PARTITION BY scenario) ELSE 0.05 END AS w FROM t, a) SELECT scenario, round(sum(bps * w) / sum(w), 6) + 0.0 AS bps FROM s GROUP BY 1""")
def _(spark, d):
    """Each order status as a scenario of five topics: their price against the mean in basis points, weighted by their share, a missing weight being 0.05."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario"), F.col("o_orderpriority").alias("topic"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    t = o.groupBy("scenario", "topic").agg(F.avg("c").alias("v"), F.count("*").alias("n")).join(F.broadcast(o.agg(F.avg("c").alias("a"))))
    s = t.select("scenario", ((F.col("v") / F.col("a") - 1) * 10000).alias("bps"), F.when(F.col("topic") != "5-LOW", F.col("n") / F.sum("n").over(W.Window.partitionBy("scenario"))).alias("w"))
    w = F.coalesce("w", F.lit(0.05))
    return s.groupBy("scenario").agg(r(F.sum(F.col("bps") * w) / F.sum(w)).alias("bps"))


@query("M16_lag_features", f"""WITH {WEEKLY}, k AS (SELECT series_id, date, list(x) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l FROM weekly WHERE x IS NOT NULL), f AS (SELECT * FROM k WHERE len(l) = 4)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round((l[4] - l[1]) / pi(), 6) + 0.0 AS moved, round(list_avg(l) / pi(), 6) + 0.0 AS mean, round(list_max(l), 8) + 0.0 AS high, round((-1.5 * l[4] - 0.5 * l[3] + 0.5 * l[2] + 1.5 * l[1]) / 5 / pi(), 6) + 0.0 AS slope FROM f""")
def _(spark, d):
    f = C.lag_features(weekly(spark, d), "series_id", "date", "x", 4).where("newest is not null")
    return _text_date(f.select("series_id", "date", r(F.col("moved") / F.pi()).alias("moved"), r(F.col("mean") / F.pi()).alias("mean"), r("high", 8).alias("high"), r(F.col("slope") / F.pi()).alias("slope")))


@query("M11_quantile_bands", f"""WITH {WEEKLY} SELECT series_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN count(value) OVER f >= 13 THEN quantile_cont(value / 7, 0.05) OVER f END, 6) + 0.0 AS q05, round(CASE WHEN count(value) OVER f >= 13 THEN quantile_cont(value / 7, 0.95) OVER f END, 6) + 0.0 AS q95
    FROM weekly WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    return _text_date(weekly(spark, d).select("series_id", "date", *[r(e).alias(n) for n, e in C.quantile_bands(F.col("value") / 7, _by(), 26, 13).items()]))


@query("H21_effective_bets", f"""WITH {WEEKLY}, c AS (SELECT a.series_id AS a, b.series_id AS b, corr(a.value, b.value) AS c FROM weekly AS a JOIN weekly AS b USING (date) WHERE a.series_id < b.series_id GROUP BY ALL), n AS (SELECT count(DISTINCT series_id) AS n FROM weekly)
    SELECT CAST(any_value(n) AS BIGINT) AS n, round(avg(c), 8) + 0.0 AS rho, round(any_value(n) / (1 + (any_value(n) - 1) * avg(c)), 6) + 0.0 AS bets FROM c, n""")
def _(spark, d):
    return r_all(C.effective_number(weekly(spark, d), "series_id", "date", "value"), 8, bets=6)


@query("H24_pairwise_correlation", f"WITH {WEEKLY} SELECT a.series_id AS a, b.series_id AS b, CAST(count(*) AS BIGINT) AS n, round(corr(a.x, b.x), 8) + 0.0 AS corr FROM weekly AS a JOIN weekly AS b USING (date) WHERE a.series_id < b.series_id AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL")
def _(spark, d):
    w = weekly(spark, d)
    a, b = w.select(F.col("series_id").alias("_a"), "date", F.col("x").alias("_x")), w.select(F.col("series_id").alias("_b"), "date", F.col("x").alias("_y"))
    return r_all(C.pair_correlations(a, b, "date").withColumnsRenamed({"_a": "a", "_b": "b"}), 8)


@query("T14_residual_tests", f"""WITH {WEEKLY}, m AS (SELECT *, value / 1e5 - avg(value / 1e5) OVER (PARTITION BY series_id) AS u, value / 1e5 AS e FROM weekly), l AS (SELECT *, e - lag(e) OVER w AS d, lag(u) OVER w AS u1, lag(u, 2) OVER w AS u2 FROM m WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(sum(d * d) / sum(e * e), 8) + 0.0 AS durbin_watson, round(count(*) * (count(*) + 2) * ((sum(u * u1) / sum(u * u)) ** 2 / (count(*) - 1) + (sum(u * u2) / sum(u * u)) ** 2 / (count(*) - 2)), 6) + 0.0 AS ljung_box FROM l GROUP BY 1""")
def _(spark, d):
    w = weekly(spark, d).withColumn("e", F.col("value") / 1e5)
    return r_all(C.residual_tests(w, "series_id", "date", "e", 2).drop("jarque_bera"), 8, ljung_box=6)


@query("M21_blend", f"""WITH {PAIR}, s AS (SELECT date, CASE WHEN count(*) OVER f >= 13 THEN (y - avg(y) OVER f) / stddev_pop(y) OVER f END AS a, CASE WHEN count(*) OVER g >= 13 THEN (z - avg(z) OVER g) / stddev_pop(z) OVER g END AS b FROM pair WINDOW f AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW), g AS (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
    SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.6 * a + 0.4 * b ELSE coalesce(a, b) END, 6) + 0.0 AS composite FROM s""")
def _(spark, d):
    p = pair(spark, d).select("date", W.rolling_z("y", _by(), 26, 13).alias("a"), W.rolling_z("z", _by(), 52, 13).alias("b"))
    return _text_date(C.blended(p, "date", {"a": 0.6, "b": 0.4}).select("date", r("composite").alias("composite")))


@query("M22_normalisations")
def _(spark, d):
    w, out = weekly(spark, d).select("series_id", "date", (F.col("value") / 1e5).alias("v")), None
    for mode in ("raw", "fracdiff", "volscale", "robust"):
        n = C.normalised(w, "series_id", "date", "v", mode).select("series_id", "date", F.lit(mode).alias("mode"), r("value_n").alias("value"))
        out = n if out is None else out.unionByName(n)
    return _text_date(out)


@query("T10_seasonal_decomposition")
def _(spark, d):
    m = monthly(spark, d).select("series_id", F.col("month").alias("date"), (F.col("value") / 1e5).alias("v"))
    return _text_date(r_all(C.decompose(m, "series_id", "date", "v")))


@query("T16_structure", f"""WITH {WEEKLY}, x AS (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS u, value, lag(value) OVER w AS b, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    p AS (SELECT series_id, k, sum(u * cos(2 * pi() * k * i / n)) ** 2 + sum(u * sin(2 * pi() * k * i / n)) ** 2 AS p FROM x, unnest(range(1, (SELECT max(n) // 2 + 1 FROM x))) AS r(k) WHERE k <= n // 2 GROUP BY ALL), q AS (SELECT series_id, p / sum(p) OVER (PARTITION BY series_id) AS q FROM p),
    e AS (SELECT series_id, -sum(q * ln(q)) / ln(count(*)) AS entropy FROM q WHERE q > 0 GROUP BY 1), r AS (SELECT series_id, count(*) AS n, corr(value, b) AS rho FROM x GROUP BY 1)
    SELECT series_id, round(entropy, 6) + 0.0 AS entropy, round(n * (1 - rho) / (1 + rho), 5) + 0.0 AS n_effective FROM e JOIN r USING (series_id)""")
def _(spark, d):
    return r_all(C.structure(weekly(spark, d).select("series_id", "date", "value"), "series_id", "date", "value"), 6, n_effective=5)


@query("M13_surrogates")
def _(spark, d):
    return r_all(resampling.surrogate_test(pair(spark, d), "series_id", "date", "y", "z"))


@query("T12_band_pass", f"""WITH {WEEKLY}, x AS (SELECT series_id, date, value / 1e5 AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, first(value / 1e5) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, last(value / 1e5) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    d AS (SELECT series_id, date, v, i, n, v - a - (z - a) * i / (n - 1) AS u FROM x), k AS (SELECT j, CASE WHEN j = 0 THEN (pi() / 4 - pi() / 26) / pi() ELSE (sin(j * pi() / 4) - sin(j * pi() / 26)) / (pi() * j) END AS b FROM (SELECT unnest(range(0, (SELECT max(n) FROM x))) AS j)),
    c AS (SELECT j, b, sum(CASE WHEN j > 0 THEN b ELSE 0 END) OVER (ORDER BY j) AS upto FROM k),
    s AS (SELECT t.series_id, t.date, any_value(t.v) AS v, sum(CASE WHEN s.i = t.i THEN c.b * s.u WHEN s.i > 0 AND s.i < s.n - 1 THEN c.b * s.u ELSE (-(SELECT b FROM c WHERE j = 0) / 2 - (c.upto - c.b)) * s.u END) AS cycle FROM d AS t JOIN d AS s USING (series_id) JOIN c ON c.j = abs(s.i - t.i) GROUP BY ALL)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(v / pi(), 6) + 0.0 AS v, round(cycle, 6) + 0.0 AS cycle FROM s""")
def _(spark, d):
    w = weekly(spark, d).select("series_id", "date", (F.col("value") / 1e5).alias("v"))
    f = folds.grouped(w, "series_id", "date", {"cycle": "double"}, lambda p: p.assign(cycle=C.band_pass(p["v"].to_numpy(float), 8, 52)))
    return _text_date(r_all(f.withColumn("v", F.col("v") / F.pi())))


@query("A23_seasonal_rank", f"WITH {MONTHLY}, g AS (SELECT series_id, CAST(month(month) AS INTEGER) AS m, avg(value) AS mean FROM monthly GROUP BY ALL) SELECT series_id, m, round(mean, 4) + 0.0 AS mean, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mean DESC, m) AS INTEGER) AS place FROM g")
def _(spark, d):
    return r_all(C.seasonal_rank(monthly(spark, d), "series_id", F.month("month"), "value"), 4)


@query("R19_roll_offset", f"""WITH {WEEKLY}, f AS (SELECT series_id, date, value / 1000 AS n1, value / 1000 * (1 + (extract('doy' FROM date) % 10) / 100.0) AS n2, CAST(floor(date_diff('day', DATE '1990-01-05', date) / 91.0) AS INTEGER) AS c FROM weekly),
    g AS (SELECT *, abs(n1 / lag(n1) OVER w - n2 / lag(n2) OVER w) AS gap, lag(c) OVER w AS b FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    a AS (SELECT *, {', '.join(f'coalesce(lead(gap, {k}) OVER w, 0) AS g{k}' if k else 'coalesce(gap, 0) AS g0' for k in range(4))} FROM g WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    v AS (SELECT series_id, CASE WHEN greatest(g0, g1, g2, g3) < 0.0025 THEN NULL WHEN g0 = greatest(g0, g1, g2, g3) THEN 0 WHEN g1 = greatest(g0, g1, g2, g3) THEN 1 WHEN g2 = greatest(g0, g1, g2, g3) THEN 2 ELSE 3 END AS k FROM a WHERE b IS NOT NULL AND b <> c),
    n AS (SELECT series_id, k, count(*) AS n, sum(count(*)) OVER (PARTITION BY series_id) AS changes, row_number() OVER (PARTITION BY series_id ORDER BY k IS NULL, count(*) DESC, k) AS place FROM v GROUP BY series_id, k)
    SELECT series_id, CAST(changes AS BIGINT) AS changes, CAST(CASE WHEN n / changes >= 0.4 THEN k ELSE 0 END AS INTEGER) AS "offset", round(n / changes, 8) + 0.0 AS support FROM n WHERE place = 1""")
def _(spark, d):
    f = weekly(spark, d).select("series_id", "date", (F.col("value") / 1000).alias("n1"), (F.col("value") / 1000 * (1 + (F.dayofyear("date") % 10) / 100.0)).alias("n2"), F.floor(F.datediff("date", F.lit("1990-01-05")) / 91).cast("int").alias("c"))
    return r_all(C.roll_offset(f, "series_id", "date", "c", "n1", "n2"), 8)


@query("R25_interval_share", "WITH l AS (SELECT l_suppkey AS s, l_suppkey % 5 AS g, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1.0 ELSE 0.0 END AS y FROM lineitem), o AS (SELECT avg(y) AS p FROM l), gr AS (SELECT g, avg(y) AS gp, count(*) AS gn FROM l GROUP BY 1), i AS (SELECT s, g, avg(y) AS ip, count(*) AS n FROM l GROUP BY ALL) SELECT s AS supplier, round((n * ip + 8.0 * ((gn * gp + 8.0 * p) / (gn + 8.0))) / (n + 8.0), 8) + 0.0 AS share FROM i JOIN gr USING (g), o")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_suppkey") % 5).alias("g"), "l_quantity")
    return r_all(C.interval_share(li, "supplier", "g", F.col("l_quantity").between(10, 20)), 8)


@query("T11_orthogonal_residual", f"WITH {PAIR}, c AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM pair) SELECT CAST(date AS VARCHAR) AS date, round((y - a - b * z) / pi(), 4) + 0.0 AS residual FROM pair, c")
def _(spark, d):
    return _text_date(C.orthogonal_residual(pair(spark, d), "series_id", "y", "z").select("date", r(F.col("residual") / F.pi(), 4).alias("residual")))


def _predicted(spark, d):
    """Does a leg rise over the next four weeks? By the trailing scores of all priorities."""
    w = _by()
    p = weekly(spark, d).select("series_id", "date", (F.lead("value", 4).over(w) > F.col("value")).cast("int").alias("up"), W.rolling_z("value", w, 26, 13).alias("a"), W.rolling_z("n", w, 26, 13).alias("b"))
    return calibrated.walk_forward(p, "series_id", "date", "up", ["a", "b"], least=104, step=13, embargo=4)


@query("M04_calibrated_scores")
def _(spark, d):
    return r_all(calibrated.scores(_predicted(spark, d), "series_id", "up"), 5)


@query("M04_walk_forward_logit")
def _(spark, d):
    from ..operators.ml import walk_forward_logit

    w = _by()
    p = pair(spark, d).select("date", (F.lead("y", 4).over(w) > F.col("y")).cast("int").alias("up"), W.rolling_z("y", w, 26, 13).alias("a"), W.rolling_z("z", w, 26, 13).alias("b"))
    return _text_date(r_all(walk_forward_logit(p.where("up is not null"), "date", "up", ["a", "b"], 60, 4), 6))
