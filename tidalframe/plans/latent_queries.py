"""Latent factors, breaks, blends, scorecards and feed cadence on the test tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import latent
from ..registry import query, r_all, table
from ..streaming import cadence
from .analogues import PAIR, WEEKLY, pair, weekly


def _text(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("T13_dynamic_factor", f"""WITH RECURSIVE {WEEKLY}, s AS (SELECT series_id, avg(value) AS ma, stddev_pop(value) AS sa, avg(n) AS mb, stddev_pop(n) AS sb, CASE WHEN corr(value, n) < 0 THEN -1 ELSE 1 END AS sg FROM weekly GROUP BY 1),
    z AS (SELECT series_id, date, (value - ma) / sa AS a, ((value - ma) / sa + sg * (n - mb) / sb) / sqrt(2) AS g, ((value - ma) / sa) ** 2 + ((n - mb) / sb) ** 2 AS q, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM weekly JOIN s USING (series_id)),
    h AS (SELECT series_id, greatest(-0.99, least(0.99, sum(g * before) / sum(before * before))) AS phi FROM (SELECT series_id, g, lag(g) OVER (PARTITION BY series_id ORDER BY i) AS before FROM z) WHERE before IS NOT NULL GROUP BY 1),
    f AS (SELECT series_id, phi, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS m, (1 / (1 - phi * phi))::DOUBLE AS p, 0.0::DOUBLE AS nis, 0.0::DOUBLE AS push FROM h
        UNION ALL SELECT series_id, phi, i, pm + v * (g - pm) / 0.5::DOUBLE, v, (q - 2 * pm * g + pm * pm) / 0.5::DOUBLE - v * ((g - pm) / 0.5::DOUBLE) ** 2, g - pm
        FROM (SELECT z.series_id, f.phi, z.i, z.g, z.q, f.phi * f.m AS pm, 1 / (1 / (f.phi * f.phi * f.p + 1) + 2.0::DOUBLE) AS v FROM f JOIN z ON z.series_id = f.series_id AND z.i = f.i + 1)),
    u AS (SELECT z.series_id, date, m, nis, a, CASE WHEN corr(m, a) OVER k < 0 THEN -1 ELSE 1 END AS side, push FROM f JOIN z ON z.series_id = f.series_id AND z.i = f.i WINDOW k AS (PARTITION BY z.series_id)),
    d AS (SELECT *, CASE WHEN side * push < 0 THEN -1 ELSE 1 END * sqrt(greatest(nis, 0)) AS dev FROM u)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(side * (m - avg(m) OVER k) / stddev_pop(m) OVER k, 6) + 0.0 AS factor, round(nis, 6) + 0.0 AS nis, round(dev / stddev_pop(dev) OVER k, 6) + 0.0 AS deviation FROM d WINDOW k AS (PARTITION BY series_id)""")
def _(spark, d):
    return _text(r_all(latent.dynamic_factor(weekly(spark, d), "series_id", "date", ["value", "n"]).drop("value", "n")))


@query("H20_break_response", f"""WITH {WEEKLY}, z AS (SELECT series_id, date, (value - avg(value) OVER k) / stddev_pop(value) OVER k AS z FROM weekly WINDOW k AS (PARTITION BY series_id)),
    b AS (SELECT *, abs(z) > 2.8 AS breach, avg(CASE WHEN abs(z) > 1 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY series_id ORDER BY date ROWS 3 PRECEDING) AS chance, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM z),
    f AS (SELECT *, min(CASE WHEN breach OR (chance > 0.5 AND i > 8) THEN date END) OVER (PARTITION BY series_id) AS broke FROM b),
    p AS (SELECT *, coalesce(date >= broke, false) AS post, row_number() OVER (PARTITION BY series_id, coalesce(date >= broke, false) ORDER BY date DESC) AS back FROM f),
    c AS (SELECT series_id, count(*) FILTER (post) AS many, median(z) FILTER (post AND back <= 52) AS center, stddev_pop(z) FILTER (post AND back <= 52) AS spread FROM p GROUP BY 1)
    SELECT series_id, CAST(date AS VARCHAR) AS date, CAST(broke AS VARCHAR) AS broke_at, round(CASE WHEN post AND many >= 10 THEN (z - center) / CASE WHEN spread > 0 THEN spread ELSE 1 END ELSE z END, 6) + 0.0 AS restated FROM p JOIN c USING (series_id)""")
def _(spark, d):
    whole, z = W.by("series_id", "date"), F.abs(F.col("z"))
    k = W.Window.partitionBy("series_id")
    df = weekly(spark, d).select("series_id", "date", ((F.col("value") - F.avg("value").over(k)) / F.stddev_pop("value").over(k)).alias("z"))
    df = df.withColumn("chance", F.avg(F.when(z > 1, 1.0).otherwise(0.0)).over(whole.rowsBetween(-3, 0)))
    out = latent.break_response(df, "series_id", "date", "z", z > 2.8, F.col("chance"))
    return _text(r_all(out.select("series_id", "date", F.date_format("broke_at", "yyyy-MM-dd").alias("broke_at"), "restated")))


@query("H19_surprise_blend", f"""WITH {WEEKLY}, e AS (SELECT series_id, date, x, count(x) OVER o AS seen, count(x) OVER k AS many, abs(x - lag(x) OVER w) AS jump, x - avg(x) OVER (PARTITION BY series_id ORDER BY date ROWS 25 PRECEDING) AS resid FROM weekly
        WINDOW k AS (PARTITION BY series_id), w AS (PARTITION BY series_id ORDER BY date), o AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT series_id, median(x) AS center, stddev_pop(x) AS sd FROM e WHERE seen <= least(greatest(floor(many / 4), 26), 52) GROUP BY 1),
    m AS (SELECT series_id, any_value(center) AS center, any_value(sd) AS sd, 1.4826 * median(abs(x - center)) AS mad FROM e JOIN c USING (series_id) WHERE seen <= least(greatest(floor(many / 4), 26), 52) GROUP BY 1),
    v AS (SELECT e.*, (x - center) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END AS z, CASE WHEN count(resid) OVER f >= 26 AND var_pop(resid) OVER f > 0 THEN resid ** 2 / var_pop(resid) OVER f END AS nis FROM e JOIN m USING (series_id) WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS 51 PRECEDING)),
    l AS (SELECT *, list(nis) OVER f AS ln, list(jump) OVER f AS lj FROM v WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS 51 PRECEDING)),
    r AS (SELECT *, CASE WHEN nis IS NOT NULL AND len(list_filter(ln, lambda q: q IS NOT NULL)) >= 26 THEN (len(list_filter(ln, lambda q: q < nis)) + 0.5 * len(list_filter(ln, lambda q: q = nis))) / len(list_filter(ln, lambda q: q IS NOT NULL)) END AS ra,
        CASE WHEN jump IS NOT NULL AND len(list_filter(lj, lambda q: q IS NOT NULL)) >= 26 THEN (len(list_filter(lj, lambda q: q < jump)) + 0.5 * len(list_filter(lj, lambda q: q = jump))) / len(list_filter(lj, lambda q: q IS NOT NULL)) END AS rb FROM l)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(z, 6) + 0.0 AS z, round(nis, 6) + 0.0 AS nis, round((coalesce(ra, 0) + coalesce(rb, 0)) / CASE WHEN ra IS NULL AND rb IS NULL THEN NULL WHEN ra IS NULL OR rb IS NULL THEN 1 ELSE 2 END * sign(coalesce(resid, 0)), 6) + 0.0 AS blend FROM r""")
def _(spark, d):
    w = W.by("series_id", "date")
    df = weekly(spark, d).select("series_id", "date", "x", F.abs(W.change("x", w)).alias("jump"), (F.col("x") - F.avg("x").over(W.frame(w, 26))).alias("resid"))
    out = latent.surprise_blend(latent.burn_in_z(df, "series_id", "date", "x"), "series_id", "date", "resid", ["jump"])
    return _text(r_all(out.select("series_id", "date", "z", "nis", "blend")))


@query("T06_exogenous_bridge")
def _(spark, d):
    p = latent.exogenous_walk_forward(pair(spark, d), "series_id", "date", "y", "z", refit=26)
    rmse = {c: F.sqrt(F.avg((F.col("y") - F.col(c)) ** 2)) for c in ("forecast", "plain", "before")}
    return r_all(p.groupBy("series_id").agg(F.count("*").alias("n"), *[v.alias(f"rmse_{c}") for c, v in rmse.items()]), 3)


@query("M15_scorecard", f"""WITH {WEEKLY}, s AS (SELECT series_id, date, (value - avg(value) OVER k) / stddev_pop(value) OVER k AS z, value AS y FROM weekly WINDOW k AS (PARTITION BY series_id)),
    l AS (SELECT *, lag(z) OVER w AS a, lead(z) OVER w AS b, lead(y, 8) OVER w - y AS ahead FROM s WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    r AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY z) + (count(*) OVER (PARTITION BY series_id, z) - 1) / 2.0 AS rz, rank() OVER (PARTITION BY series_id ORDER BY ahead) + (count(*) OVER (PARTITION BY series_id, ahead) - 1) / 2.0 AS ry FROM l WHERE ahead IS NOT NULL),
    i AS (SELECT series_id, corr(rz, ry) AS ic, count(*) / 8.0 - 2 AS spare FROM r GROUP BY 1),
    g AS (SELECT series_id, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN a * z < 0 THEN 1 ELSE 0 END) * 52.0 / count(*) AS c0, sum(CASE WHEN (a - 1) * (z - 1) < 0 THEN 1 ELSE 0 END) * 52.0 / count(*) AS c1, sum(CASE WHEN (a - 2) * (z - 2) < 0 THEN 1 ELSE 0 END) * 52.0 / count(*) AS c2,
        sum(CASE WHEN (z - a) * (b - z) < 0 THEN 1 ELSE 0 END) * 52.0 / count(*) AS turns, regr_slope(z - a, a) AS slope FROM l GROUP BY 1)
    SELECT series_id, n, round(c0, 6) + 0.0 AS cross0_per_yr, round(c1, 6) + 0.0 AS cross1_per_yr, round(c2, 6) + 0.0 AS cross2_per_yr, round(turns, 6) + 0.0 AS turns_per_yr, round(CASE WHEN slope < 0 THEN -ln(2) / slope END, 5) + 0.0 AS half_life,
        round(ic, 6) + 0.0 AS ic, round(CASE WHEN spare > 0 AND abs(ic) < 1 THEN ic * sqrt(spare / (1 - ic * ic)) END, 6) + 0.0 AS t, round(0.5 + ic / 2, 6) + 0.0 AS hit FROM g LEFT JOIN i USING (series_id)""")
def _(spark, d):
    k = W.Window.partitionBy("series_id")
    df = weekly(spark, d).select("series_id", "date", ((F.col("value") - F.avg("value").over(k)) / F.stddev_pop("value").over(k)).alias("z"), F.col("value").alias("y"))
    return r_all(latent.scorecard(df, "series_id", "date", "z", "y"), 6, half_life=5)


@query("M15_gate", """SELECT l_orderkey, l_linenumber, l_discount > 0.03 AND l_tax < 0.05 AND l_quantity > 10 AND abs(l_quantity - 25) > 3 AND coalesce(CASE WHEN l_linestatus = 'O' THEN l_discount - 0.06 END > 0, true) AS pass FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    passed = latent.gate(F.col("l_discount") - 0.03, F.col("l_tax"), F.col("l_quantity") - 10, F.col("l_quantity") - 25, F.when(F.col("l_linestatus") == "O", F.col("l_discount") - 0.06))
    return li.select("l_orderkey", "l_linenumber", passed.alias("pass"))


_SOURCES = ["purchase", "click", "view"]


@query("X08_source_failover", """WITH h AS (SELECT event_id, user_id, event_type, ts, max(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS a, max(CASE WHEN event_type = 'click' THEN 1 END) OVER w AS b, max(CASE WHEN event_type = 'view' THEN 1 END) OVER w AS c
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)),
    k AS (SELECT *, CASE WHEN a = 1 THEN 'purchase' WHEN b = 1 THEN 'click' WHEN c = 1 THEN 'view' END AS active FROM h) SELECT event_id, user_id, active FROM k WHERE event_type = active""")
def _(spark, d):
    out = cadence.failover(table(spark, d, "events"), "user_id", "ts", "event_type", _SOURCES, timedelta(hours=12))
    return out.select("event_id", "user_id", "active")


@query("X09_cache_refreshes", """WITH RECURSIVE p AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT user_id, (SELECT min(e.ts) FROM events AS e WHERE e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 1 DAY) FROM p WHERE ts IS NOT NULL),
    n AS (SELECT user_id, CAST(count(*) AS BIGINT) AS reads FROM events GROUP BY 1) SELECT user_id, any_value(reads) AS reads, CAST(count(ts) AS BIGINT) AS pulls FROM p JOIN n USING (user_id) GROUP BY user_id""")
def _(spark, d):
    out = cadence.refreshes(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", timedelta(days=1))
    return out.groupBy("user_id").agg(F.count("*").alias("reads"), F.count_if("pulled").alias("pulls"))
