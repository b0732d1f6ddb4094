"""Exact-likelihood models over the weekly series: factors (T13) and ARIMA (T05, T06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import windows as W
from ..operators import arima, state_space
from ..registry import query, r_all, table
from .analogues import WEEKLY, daily, pair, weekly

XS = ["urgent", "high", "medium", "low", "other"]


def panel(spark, d):
    """``status, date`` and the mean price of each priority in a week, in an order status: null where a week has none."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "other", "5-LOW": "low"}
    mean = lambda p: (F.avg(F.when(F.col("o_orderpriority") == p, F.col("cents"))) / 100).alias(names[p])
    return o.groupBy(F.col("o_orderstatus").alias("status"), dates.week_ending_friday(F.to_date("o_orderdate")).alias("date")).agg(*[mean(p) for p in names])


def _text(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


@query("T13_likelihood_factor")
def _(spark, d):
    out = state_space.likelihood_factor(panel(spark, d), "status", "date", XS, lags=2, train_end="1999-12-31")
    return _text(r_all(out.drop(*XS), 4), "date")


@query("T05_arima_orders")
def _(spark, d):
    out = arima.fit_orders(weekly(spark, d), "series_id", "date", "value")
    return r_all(out.select("series_id", "p", "q", "n", "best", "loglik", "aic", F.sqrt("s2").alias("s"), F.element_at("coef", 1).alias("first_coef"), F.element_at("se", 1).alias("first_se")).where("p + q > 0"), 3)


@query("T05_arima_walk_forward")
def _(spark, d):
    return r_all(arima.walk_forward(weekly(spark, d), "series_id", "date", "value", 120), 3)


@query("T05_random_walk", f"""WITH {WEEKLY}, l AS (SELECT series_id, value / pi() AS v, lag(value / pi()) OVER w AS b, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, count(*) AS n, round(sqrt(avg((v - b) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(v - b)), 6) + 0.0 AS mae FROM l WHERE i > CASE WHEN n - 80 >= 250 THEN n - 80 ELSE n // 2 END AND n >= 30 GROUP BY 1""")
def _(spark, d):
    """The walk that the models are held against."""
    v = weekly(spark, d).select("series_id", "date", (F.col("value") / F.pi()).alias("v"))
    return r_all(arima.walk_forward(v, "series_id", "date", "v", 80, models=()).select("series_id", "n", "rmse", "mae"))


@query("T05_forecast_fan")
def _(spark, d):
    """Three weeks of business days behind the end of each daily series."""
    out = arima.forecast_fan(daily(spark, d), "series_id", "date", "value", 0, 1, 15)
    return r_all(out.select("series_id", F.date_format(dates.add_business_days("last", F.col("step")), "yyyy-MM-dd").alias("date"), "step", "mean", "low80", "high80", "low95", "high95"), 2)


@query("T06_exact_bridge")
def _(spark, d):
    """Does the other leg's trailing score help to forecast a leg?"""
    p = pair(spark, d).withColumn("z", W.rolling_z("z", W.by("series_id", "date"), 26, 13))
    return r_all(arima.exogenous_bridge(p, "series_id", "date", "y", "z"), 3)
