"""Compositions on the test tables, each with the SQL that makes the same."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import evaluate as E
from ..operators import linear, simulate, studies
from ..registry import query, r_all, table
from ..session import shared_folder
from .analogues import DAILY, PAIR, POSITIONS, WEEKLY, daily, pair, positions, weekly


def _text(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_UNITS = f"""{PAIR}, u AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, avg(z) AS mz, stddev_pop(z) AS sz, CASE WHEN corr(y, z) < 0 THEN -1 ELSE 1 END AS sg FROM pair),
    k AS (SELECT date, y, ((y - my) / sy + sg * (z - mz) / sz) / sqrt(2) AS kaiser, ((y - my) / sy - (z - mz) / sz) / sqrt(2) AS opposed FROM pair, u)"""


@query("M02_component_composites", f"WITH {_UNITS} SELECT CAST(date AS VARCHAR) AS date, round(kaiser, 6) + 0.0 AS kaiser, round(opposed, 6) + 0.0 AS opposed FROM k")
def _(spark, d):
    return _text(r_all(studies.component_composites(pair(spark, d), ["y", "z"]).select("date", "kaiser", "opposed")))


@query("H11_lagged_components", f"WITH {_UNITS} SELECT CAST(date AS VARCHAR) AS date, round(y, 3) + 0.0 AS y, round(lag(kaiser) OVER w, 6) + 0.0 AS kaiser_lag, round(lag(y) OVER w, 3) + 0.0 AS y_lag FROM k WINDOW w AS (ORDER BY date)")
def _(spark, d):
    scored = studies.component_composites(pair(spark, d), ["y", "z"])
    return _text(r_all(studies.lagged_design(scored, "series_id", "date", ["kaiser"], "y").drop("series_id"), 3, kaiser_lag=6))


@query("L04_largest_weights", "SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS INTEGER) AS place FROM customer WHERE c_acctbal IS NOT NULL QUALIFY place <= 6")
def _(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return studies.largest(c, "c_nationkey", "c_custkey", "c_acctbal", 6)


@query("A25_shares_by_prefix", f"WITH {POSITIONS} SELECT CAST(date AS VARCHAR) AS date, coalesce(sum(net) FILTER (instrument = 'F'), 0.0) AS F, coalesce(sum(net) FILTER (instrument = 'O'), 0.0) AS O FROM positions GROUP BY date")
def _(spark, d):
    p = positions(spark, d).withColumn("cell", F.concat_ws("_", "instrument", "category"))
    wide = p.groupBy("date").pivot("cell", ["F_A", "F_N", "F_R", "O_A", "O_N", "O_R"]).agg(F.sum("net"))
    return _text(studies.by_prefix(wide, ["date"]))


@query("K04_stored_model", f"WITH {PAIR}, s AS (SELECT date, y / 1e5 AS y, z / 1e5 AS z FROM pair), m AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM s) SELECT CAST(date AS VARCHAR) AS date, round(a + b * z, 6) + 0.0 AS score FROM s, m")
def _(spark, d):
    s = pair(spark, d).select("date", (F.col("y") / 1e5).alias("y"), (F.col("z") / 1e5).alias("z"))
    path = f"{shared_folder(spark)}/model-{uuid4().hex}"
    studies.save_linear(spark, linear.ols(s, "y", ["z"]), ["z"], path)
    return _text(r_all(studies.score_saved(s, path).select("date", "score")))


@query("H14_posterior_interval", """WITH g AS (SELECT user_id, 1 / (1 / 180.0::DOUBLE + count(value) / 120.0::DOUBLE) AS v, coalesce(sum(value), 0) AS s FROM events GROUP BY 1), p AS (SELECT user_id, v, (57 / 180.0::DOUBLE + s / 120.0::DOUBLE) * v AS m FROM g)
    SELECT user_id, round(m, 6) + 0.0 AS mean, round(sqrt(v), 6) + 0.0 AS sd, round(greatest(0, m - 1.96 * sqrt(v)), 6) + 0.0 AS low, round(least(100, m + 1.96 * sqrt(v)), 6) + 0.0 AS high FROM p""")
def _(spark, d):
    return r_all(studies.posterior_interval(table(spark, d, "events").select("user_id", "value"), "user_id", "value"))


@query("S25_volatility_indicator", f"""WITH {DAILY}, c AS (SELECT series_id, date, CASE WHEN lag(value) OVER w <> 0 THEN value / lag(value) OVER w - 1 END AS chg FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    v AS (SELECT series_id, date, CASE WHEN count(chg) OVER w >= 21 THEN stddev_samp(chg) OVER w * sqrt(252) END AS vol FROM c WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 20 PRECEDING))
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(vol, 6) + 0.0 AS vol, round(CASE WHEN count(vol) OVER w >= 78 AND stddev_pop(vol) OVER w > 0 THEN (vol - avg(vol) OVER w) / stddev_pop(vol) OVER w END, 6) + 0.0 AS z FROM v WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 155 PRECEDING)""")
def _(spark, d):
    w = W.by("series_id", "date")
    v = daily(spark, d).withColumn("chg", W.pct_change("value", w)).withColumn("vol", W.volatility("chg", w, 21, yearly=252.0))
    return _text(r_all(v.select("series_id", "date", "vol", W.rolling_z("vol", w, 156).alias("z"))))


@query("H23_seasonal_system", f"""WITH {PAIR}, s AS (SELECT month(date) AS mo, y / 1e5 AS y, z / 1e5 AS z, lag(y / 1e5) OVER w AS a, lag(z / 1e5) OVER w AS b FROM pair WINDOW w AS (ORDER BY date)),
    c AS (SELECT y - avg(y) OVER k AS y, z - avg(z) OVER k AS z, a - avg(a) OVER k AS a, b - avg(b) OVER k AS b FROM s WHERE a IS NOT NULL AND b IS NOT NULL WINDOW k AS (PARTITION BY mo)),
    g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS gy, sum(a * z) AS az, sum(b * z) AS bz FROM c)
    SELECT 'y' AS equation, round((bb * ay - ab * gy) / (aa * bb - ab * ab), 6) + 0.0 AS on_y, round((aa * gy - ab * ay) / (aa * bb - ab * ab), 6) + 0.0 AS on_z FROM g
    UNION ALL SELECT 'z', round((bb * az - ab * bz) / (aa * bb - ab * ab), 6) + 0.0, round((aa * bz - ab * az) / (aa * bb - ab * ab), 6) + 0.0 FROM g""")
def _(spark, d):
    s = pair(spark, d).select("series_id", "date", (F.col("y") / 1e5).alias("y"), (F.col("z") / 1e5).alias("z"))
    fit = studies.seasonal_var(s, "series_id", "date", ["y", "z"], F.month("date"), lags=1)
    rows = [(c, *map(float, fit["coef"][k])) for k, c in enumerate(("y", "z"))]
    return r_all(spark.createDataFrame(rows, "equation string, on_y double, on_z double"))


@query("H03_study", f"""WITH {WEEKLY}, l AS (SELECT series_id, value AS x, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS b FROM weekly), h AS (SELECT series_id, regr_slope(x - b, b) AS slope FROM l WHERE b IS NOT NULL GROUP BY 1)
    SELECT series_id, 'half_life' AS part, 'half_life' AS measure, round(CASE WHEN slope < 0 THEN -ln(2) / slope END, 5) + 0.0 AS value FROM h
    UNION ALL SELECT series_id, 'mean_reversion', 'kappa', round(-slope * 52, 5) + 0.0 FROM h
    UNION ALL SELECT series_id, 'size', 'weeks', CAST(count(*) AS DOUBLE) FROM weekly GROUP BY 1""")
def _(spark, d):
    w = weekly(spark, d)
    parts = {
        "half_life": E.half_life(w, "series_id", "date", "value").select("series_id", "half_life"),
        "mean_reversion": simulate.mean_reversion(w, "series_id", "date", "value", 52.0).select("series_id", "kappa"),
        "size": w.groupBy("series_id").agg(F.count("*").alias("weeks")),
    }
    return r_all(studies.study(parts, "series_id"), 5)


@query("Y02_row_expression", "SELECT l_orderkey, l_linenumber, round(greatest(l_quantity * l_discount, l_quantity * l_tax) - least(l_discount, l_tax), 6) + 0.0 AS value FROM lineitem")
def _(spark, d):
    q, a, b = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return r_all(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.greatest(q * a, q * b) - F.least(a, b)).alias("value")))
