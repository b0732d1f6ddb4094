"""Scalars, dates, folds, regressions, tests, models and simulations on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scalars
from ..functions import windows as W
from ..operators import composites as C
from ..operators import evaluate as E
from ..operators import arima, folds, linear, ml, resampling, simulate, survival, vectors
from ..operators import relational as R
from ..registry import query, r, r_all, table
from .analogues import PAIR, WEEKLY, pair, weekly


def _by():
    return W.by("series_id", "date")


def _text_date(df, name="date"):
    return df.withColumn(name, F.col(name).cast("string"))


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) if hasattr(v, "dtype") and v.dtype.kind == "f" else v for v in x) for x in rows], schema)


# --- scalars and dates -----------------------------------------------------------


@query("F01_curve_loadings", "SELECT p_size AS tenor, round(any_value(CASE WHEN p_size * 0.0609 < 1e-8 THEN 1 ELSE (1 - exp(-p_size * 0.0609)) / (p_size * 0.0609) END), 8) + 0.0 AS slope, round(any_value((1 - exp(-p_size * 0.0609)) / (p_size * 0.0609) - exp(-p_size * 0.0609)), 8) + 0.0 AS curvature FROM part GROUP BY 1")
def _(spark, d):
    load = scalars.curve_loadings("tenor", 0.0609)
    return table(spark, d, "part").select(F.col("p_size").alias("tenor")).distinct().select("tenor", r(load["slope"], 8).alias("slope"), r(load["curvature"], 8).alias("curvature"))


@query("F02_par_bond", """WITH p AS (SELECT DISTINCT p_size AS tenor, 0.01 + (p_partkey % 50) / 1000.0 AS y FROM part), f AS (SELECT tenor, y, k, y / 2 + CASE WHEN k = 2 * tenor THEN 1 ELSE 0 END AS flow FROM p, unnest(range(1, 2 * tenor + 1)) AS r(k))
    SELECT tenor, round(y, 6) + 0.0 AS y, round(sum(flow / (1 + y / 2) ** k), 8) + 0.0 AS price, round(sum(k / 2.0 * flow / (1 + y / 2) ** k) / sum(flow / (1 + y / 2) ** k) / (1 + y / 2), 8) + 0.0 AS duration FROM f GROUP BY tenor, y""")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("tenor"), (0.01 + (F.col("p_partkey") % 50) / 1000.0).alias("y")).distinct()
    b = scalars.par_bond("tenor", "y")
    return p.select("tenor", r("y").alias("y"), r(b["price"], 8).alias("price"), r(b["duration"], 8).alias("duration"))


@query("F05_lag_weights", f"""WITH {WEEKLY}, g AS (SELECT i, (i / 13.0) ** 0.5 * (1 - i / 13.0) ** 2 AS b, exp(0.1 * (i - 1) - 0.02 * (i - 1) ** 2) AS a FROM unnest(range(1, 13)) AS r(i)), w AS (SELECT i, b / sum(b) OVER () AS b, a / sum(a) OVER () AS a FROM g),
    l AS (SELECT series_id, date, list(x) OVER (PARTITION BY series_id ORDER BY date ROWS 11 PRECEDING) AS xs FROM weekly WHERE x IS NOT NULL)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(sum(b * xs[13 - i]) / pi(), 6) + 0.0 AS beta, round(sum(a * xs[13 - i]) / pi(), 6) + 0.0 AS almon FROM l, w WHERE len(xs) = 12 GROUP BY series_id, date""")
def _(spark, d):
    """The two families of weights on each series' last twelve known values, the newest first."""
    lags = R.last_k(weekly(spark, d).where("x is not null"), ["series_id"], "date", "x", 12).where("lags is not null")
    return _text_date(lags.select("series_id", "date", *[r(scalars.weighted("lags", w) / F.pi()).alias(n) for n, w in (("beta", scalars.beta_weights(12, 1.5, 3.0)), ("almon", scalars.almon_weights(12, 0.1, -0.02)))]))


@query("F07_hazard_link", "SELECT o_orderkey, round(1 - exp(-exp(greatest(least(-o_totalprice / 100000, 5), -30))), 8) + 0.0 AS h FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(scalars.cloglog_inverse(-F.col("o_totalprice") / 100000), 8).alias("h"))


@query("F07_hazard_link_whole", "SELECT o_orderkey, round(1 - exp(-exp(greatest(least(-o_totalprice / 100000, 5), -30))), 8) + 0.0 AS h FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(scalars.cloglog_inverse(-F.col("o_totalprice") / 100000), 8).alias("h"))


@query("F09_shrunk_rates", """WITH l AS (SELECT l_suppkey AS s, l_suppkey % 5 AS g, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), o AS (SELECT avg(y) AS p FROM l), gr AS (SELECT g, avg(y) AS gp, count(*) AS gn FROM l GROUP BY 1), i AS (SELECT s, g, avg(y) AS ip, count(*) AS n FROM l GROUP BY ALL)
    SELECT s AS supplier, round((n * ip + 8.0 * ((gn * gp + 8.0 * p) / (gn + 8.0))) / (n + 8.0), 8) + 0.0 AS rate FROM i JOIN gr USING (g), o""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_suppkey") % 5).alias("g"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    # One pass: supplier sums, rolled up to groups and the total.
    i = li.groupBy("supplier", "g").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    g = i.groupBy("g").agg(F.sum("k").alias("gk"), F.sum("n").alias("gn"))
    o = g.agg((F.sum("gk") / F.sum("gn")).alias("p"))
    j = i.join(g, "g").join(F.broadcast(o))
    return j.select("supplier", r(scalars.shrink(F.col("k") / F.col("n"), F.col("n"), F.col("gk") / F.col("gn"), F.col("gn"), F.col("p")), 8).alias("rate"))


#: Fixed values for these queries: words of the invented corpus as a lexicon.
LEXICON = {"the": 1.0, "of": -0.5, "tion": 2.0, "der": -1.0, "les": 0.25}


@query("F10_word_score", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS ws FROM documents),
    s AS (SELECT doc_id, len(ws) AS n, list_sum(list_transform(ws, lambda x: CASE x WHEN 'the' THEN 1.0::DOUBLE WHEN 'of' THEN -0.5 WHEN 'tion' THEN 2.0 WHEN 'der' THEN -1.0 WHEN 'les' THEN 0.25 ELSE 0.0 END)) AS t FROM w)
    SELECT doc_id, round(CASE WHEN n > 0 THEN greatest(-7.5, least(7.5, t / n * 100)) ELSE 0 END, 6) + 0.0 AS score, round(greatest(0, least(100, 50 + 50 * CASE WHEN n > 0 THEN greatest(-7.5, least(7.5, t / n * 100)) ELSE 0 END / 7.5)), 6) + 0.0 AS barometer FROM s""")
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", scalars.word_score("text", LEXICON).alias("s"))
    return s.select("doc_id", r("s").alias("score"), r(scalars.barometer("s")).alias("barometer"))


@query("F11_direction", "SELECT doc_id, CAST(sign(len(regexp_extract_all(lower(text), 'tion')) - len(regexp_extract_all(lower(text), '\\bthe'))) AS INTEGER) AS direction FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.direction("text", ["tion"], ["the"]).alias("direction"))


@query("F13_fingerprint", "SELECT page_id, md5(coalesce(url, html)) AS fp FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.fingerprint("url", "html").alias("fp"))


@query("D01_week_index", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, any_value(CAST(floor(date_diff('day', DATE '2019-01-01', CAST(o_orderdate AS DATE)) / 7.0) AS INTEGER)) AS wk FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return _text_date(o.select("date", dates.week_index_monday("date").alias("wk")))


@query("D02_calendar_parts", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(any_value(month(o_orderdate)) AS INTEGER) AS m, CAST(any_value(weekofyear(o_orderdate)) AS INTEGER) AS w, any_value(CASE WHEN month(o_orderdate) IN (3, 6, 9, 12) THEN 1 ELSE 0 END) AS q, CAST(any_value(year(o_orderdate)) AS INTEGER) AS y FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return _text_date(o.select("date", F.month("date").alias("m"), F.weekofyear("date").alias("w"), dates.quarter_end_month("date").alias("q"), F.year("date").alias("y")))


_PLUS3 = "date + CASE isodow(date) WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 5 END"
_MINUS2 = "date - CASE isodow(date) WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 6 THEN 3 WHEN 7 THEN 4 ELSE 2 END"


@query("D03_business_days", f"WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT CAST(date AS VARCHAR) AS date, CAST(CAST({_PLUS3} AS DATE) AS VARCHAR) AS plus3 FROM o")
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return _text_date(o.select("date", dates.add_business_days("date", 3).cast("string").alias("plus3")))


@query("D04_month_arithmetic", "WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT CAST(date AS VARCHAR) AS date, CAST(last_day(date) AS VARCHAR) AS month_end, CAST(CAST(date + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS later FROM o")
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return _text_date(o.select("date", dates.month_end("date").cast("string").alias("month_end"), F.add_months("date", 1).cast("string").alias("later")))


@query("S24_first_fridays", "SELECT CAST(m AS VARCHAR) AS month, CAST(m + CAST((12 - isodow(m)) % 7 AS INTEGER) AS VARCHAR) AS nfp FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)")
def _(spark, d):
    m = table(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("m")).distinct()
    return m.select(F.col("m").cast("string").alias("month"), dates.first_friday("m").cast("string").alias("nfp"))


# --- folds --------------------------------------------------------------------------

_ZED = "z AS (SELECT *, CASE WHEN count(value) OVER f >= 13 THEN (value - avg(value) OVER f) / stddev_pop(value) OVER f END AS z FROM weekly WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM z)"


def _machine(name: str, step: str) -> str:
    """A state machine by recursion over row numbers."""
    return f"""WITH RECURSIVE {WEEKLY}, {_ZED}, s AS (SELECT series_id, CAST(0 AS BIGINT) AS i, 0 AS st FROM (SELECT DISTINCT series_id FROM weekly)
        UNION ALL SELECT k.series_id, k.i, {step} FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i + 1)
    SELECT k.series_id, CAST(k.date AS VARCHAR) AS date, CAST(st AS INTEGER) AS {name} FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i"""


_FLIP = "CASE WHEN z IS NULL THEN st WHEN z >= 1.5 THEN -1 WHEN z <= -1.5 THEN 1 WHEN abs(z) <= 0.5 THEN 0 ELSE st END"
_ONCE = "CASE WHEN z IS NULL THEN st WHEN st = 0 THEN CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END WHEN st = -1 THEN CASE WHEN z < 0.5 THEN 0 ELSE -1 END ELSE CASE WHEN z > -0.5 THEN 0 ELSE 1 END END"


def _zed(spark, d):
    return weekly(spark, d).withColumn("z", W.rolling_z("value", _by(), 26, 13))


@query("R10_hysteresis", _machine("signal", _FLIP))
def _(spark, d):
    return _text_date(folds.hysteresis(_zed(spark, d), "series_id", "date", "z", 1.5, 0.5).select("series_id", "date", "signal"))


@query("R11_contrarian", _machine("stance", _ONCE))
def _(spark, d):
    return _text_date(folds.contrarian(_zed(spark, d), "series_id", "date", "z", 1.5, 0.5).select("series_id", "date", "stance"))


@query("W06_ewma_z", f"""WITH RECURSIVE {WEEKLY}, k AS (SELECT *, value / 100000 AS v, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM weekly), c AS (SELECT CAST(0.5 AS DOUBLE) ** (1 / 13.0) AS q),
    s AS (SELECT series_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS wx, 0.0::DOUBLE AS wxx FROM (SELECT DISTINCT series_id FROM weekly)
        UNION ALL SELECT k.series_id, k.i, w * q + 1, w2 * q * q + 1, wx * q + v, wxx * q + v * v FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i + 1, c)
    SELECT k.series_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN k.i >= 13 THEN (v - wx / w) / sqrt((wxx / w - (wx / w) ** 2) * w * w / (w * w - w2)) END, 5) + 0.0 AS z FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i""")
def _(spark, d):
    z = folds.ewma_z(weekly(spark, d).withColumn("v", F.col("value") / 100000).select("series_id", "date", "v"), "series_id", "date", "v", 13)
    return _text_date(z.select("series_id", "date", r("z", 5).alias("z")))


@query("R12_tvp_regression", f"""WITH RECURSIVE {PAIR}, v AS (SELECT series_id, date, y / 1e5 AS y, z / 1e5 AS z FROM pair), ok AS (SELECT * FROM v WHERE y IS NOT NULL AND z IS NOT NULL),
    r AS (SELECT series_id, (regr_syy(y, z) - regr_sxy(y, z) ** 2 / regr_sxx(y, z)) / (count(*) - 2) AS r FROM ok GROUP BY 1 HAVING count(*) >= 30),
    k AS (SELECT ok.*, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM ok),
    s AS (SELECT series_id, CAST(0 AS BIGINT) AS i, r, 1e-4 / (1 - 1e-4) * r AS q, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1000.0::DOUBLE AS p, 0.0::DOUBLE AS c, 1000.0::DOUBLE AS t, 0.0::DOUBLE AS e FROM r
        UNION ALL SELECT series_id, i, r, q, a + e * (u / f), b + e * (w / f), p - u * u / f, c - u * w / f, t - w * w / f, e
        FROM (SELECT *, u + z * w + r AS f FROM (SELECT k.series_id, k.i, k.z, r, q, a, b, p + q AS p, c, t + q AS t, y - a - b * z AS e, p + q + c * z AS u, c + (t + q) * z AS w FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i + 1)))
    SELECT v.series_id, CAST(v.date AS VARCHAR) AS date, round(a, 8) + 0.0 AS alpha, round(b, 8) + 0.0 AS beta, round(e, 8) + 0.0 AS resid FROM v LEFT JOIN (SELECT k.series_id, k.date, a, b, e FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i) AS o ON v.series_id = o.series_id AND v.date = o.date""")
def _(spark, d):
    p = pair(spark, d).select("series_id", "date", (F.col("y") / 1e5).alias("y"), (F.col("z") / 1e5).alias("z"))
    return _text_date(r_all(folds.tvp_regression(p, "series_id", "date", "y", "z").drop("y", "z"), 8))


#: The filter's recursion on the weekly series: five numbers a row.
TREND = f"""{WEEKLY}, v AS (SELECT series_id, date, value / 1e5 AS x, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM weekly),
    p AS (SELECT series_id, i, x AS x0, x * 1e7 / (1e7 + 0.05) AS a, 0.0::DOUBLE AS b, 1e7 - 1e7 / (1e7 + 0.05) * 1e7 AS p00, 0.0::DOUBLE AS p01, 1e7::DOUBLE AS p11, x / sqrt(1e7 + 0.05) AS surprise FROM v WHERE i = 1
        UNION ALL SELECT series_id, i, x, a + g0 * gap, b + g1 * gap, q00 - g0 * q00, q01 - g0 * q01, q11 - g1 * q01, gap / sqrt(q00 + 0.05)
        FROM (SELECT *, q00 / (q00 + 0.05) AS g0, q01 / (q00 + 0.05) AS g1, x - a AS gap FROM (SELECT v.series_id, v.i, v.x, p.a + p.b AS a, p.b, p.p00 + 2 * p.p01 + p.p11 + 0.01 AS q00, p.p01 + p.p11 AS q01, p.p11 + 0.0001 AS q11 FROM p JOIN v ON v.series_id = p.series_id AND v.i = p.i + 1)))"""


@query("R13_local_linear_trend", f"WITH RECURSIVE {TREND} SELECT series_id, CAST(date AS VARCHAR) AS date, round(x / pi(), 4) + 0.0 AS v, round(a, 4) + 0.0 AS level, round(b, 4) + 0.0 AS trend FROM p JOIN v USING (series_id, i)")
def _(spark, d):
    w = weekly(spark, d).select("series_id", "date", (F.col("value") / 1e5).alias("v"))
    out = folds.local_linear_trend(w, "series_id", "date", "v", (0.05, 0.01, 0.0001))
    return _text_date(r_all(out.withColumn("v", F.col("v") / F.pi()), 4))


@query("R14_R15_cycle_filters", f"""WITH RECURSIVE {WEEKLY}, c AS (SELECT exp(-1.414 * pi() / 10) AS a, cos(1.414 * pi() / 10) AS ca, (cos(0.707 * 2 * pi() / 48) + sin(0.707 * 2 * pi() / 48) - 1) / cos(0.707 * 2 * pi() / 48) AS al),
    e AS (SELECT (1 - al / 2) ** 2 AS hk, 2 * (1 - al) AS hb, (1 - al) ** 2 AS hd, 1 - 2 * a * ca + a * a AS c1, 2 * a * ca AS c2, -a * a AS c3 FROM c),
    k AS (SELECT series_id, date, x, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, row_number() OVER w AS i FROM weekly WHERE x IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    s AS (SELECT series_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS f, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS h, 0.0::DOUBLE AS h1, 0.0::DOUBLE AS g, 0.0::DOUBLE AS g1 FROM (SELECT DISTINCT series_id FROM weekly)
        UNION ALL SELECT k.series_id, k.i, CASE WHEN k.i < 3 THEN x ELSE c1 * (x + x1) / 2 + c2 * f + c3 * f1 END, f, CASE WHEN k.i < 3 THEN 0 ELSE hk * (x - 2 * x1 + x2) + hb * h - hd * h1 END, h,
            CASE WHEN k.i < 3 THEN 0 ELSE c1 * (hk * (x - 2 * x1 + x2) + hb * h - hd * h1 + h) / 2 + c2 * g + c3 * g1 END, g FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i + 1, e),
    q AS (SELECT k.series_id, date, x, f, g, CASE WHEN k.i = 1 THEN 0 ELSE (g1 - g) / (2 * sin(pi() / 20)) END AS qd FROM s JOIN k ON k.series_id = s.series_id AND k.i = s.i)
    SELECT w.series_id, CAST(w.date AS VARCHAR) AS date, round(f, 6) + 0.0 AS smooth, round(g, 6) + 0.0 AS band, round(sqrt(g * g + qd * qd), 6) + 0.0 AS amplitude, round(atan2(qd, g), 6) + 0.0 AS phase, round(sin(atan2(qd, g)), 6) + 0.0 AS sine, round(sin(atan2(qd, g) + pi() / 4), 6) + 0.0 AS lead FROM weekly AS w LEFT JOIN q ON q.series_id = w.series_id AND q.date = w.date""")
def _(spark, d):
    return _text_date(r_all(folds.cycle_filters(weekly(spark, d).select("series_id", "date", "x"), "series_id", "date", "x").drop("x"), 6))


@query("R16_change_points")
def _(spark, d):
    return _text_date(r_all(folds.change_points(_zed(spark, d).select("series_id", "date", "z"), "series_id", "date", "z"), 8))


@query("R17_cusum", f"""WITH {WEEKLY}, s AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS cnt FROM weekly GROUP BY 1),
    p AS (SELECT series_id, date, sum(value - m) OVER w / (sd * sqrt(cnt)) AS path, 0.948 * (1 + 2.0 * row_number() OVER w / cnt) AS bound FROM weekly JOIN s USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(path, 6) + 0.0 AS path, round(bound, 6) + 0.0 AS bound, abs(path) > bound AS breach FROM p""")
def _(spark, d):
    return _text_date(r_all(folds.cusum(weekly(spark, d).select("series_id", "date", "value"), "series_id", "date", "value").drop("value"), 6))


@query("R18_barometer_history", """WITH RECURSIVE w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS ws FROM conversations),
    b AS (SELECT conv_id, turn, len(ws) AS n, list_sum(list_transform(ws, lambda x: CASE x WHEN 'the' THEN 1.0::DOUBLE WHEN 'of' THEN -0.5 WHEN 'tion' THEN 2.0 WHEN 'der' THEN -1.0 WHEN 'les' THEN 0.25 ELSE 0.0 END)) AS t FROM w),
    x AS (SELECT conv_id, turn, greatest(0, least(100, 50 + 50 * CASE WHEN n > 0 THEN greatest(-7.5, least(7.5, t / n * 100)) ELSE 0 END / 7.5)) AS x FROM b),
    k AS (SELECT *, row_number() OVER o AS i, 1 / (1 / 180.0::DOUBLE + row_number() OVER o / 120.0::DOUBLE) AS v, (57 / 180.0::DOUBLE + sum(x) OVER o / 120.0::DOUBLE) / (1 / 180.0::DOUBLE + row_number() OVER o / 120.0::DOUBLE) AS m FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d, 0 AS alert FROM (SELECT DISTINCT conv_id FROM x)
        UNION ALL SELECT conv_id, i, CASE WHEN u > 15 THEN 0 ELSE u END, CASE WHEN u <= 15 AND d > 15 THEN 0 ELSE d END, CASE WHEN u > 15 THEN 1 WHEN d > 15 THEN -1 ELSE 0 END
        FROM (SELECT k.conv_id, k.i, greatest(0, u + (x - m) - 3) AS u, greatest(0, d - (x - m) - 3) AS d FROM s JOIN k ON k.conv_id = s.conv_id AND k.i = s.i + 1))
    SELECT k.conv_id, turn, round(x, 8) + 0.0 AS x, round(m, 8) + 0.0 AS mean, round(sqrt(v), 8) + 0.0 AS sd, round(greatest(0, m - 1.96 * sqrt(v)), 8) + 0.0 AS low, round(least(100, m + 1.96 * sqrt(v)), 8) + 0.0 AS high, alert FROM s JOIN k ON k.conv_id = s.conv_id AND k.i = s.i""")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", scalars.barometer(scalars.word_score("text", LEXICON)).alias("x"))
    h = folds.barometer_history(c, "conv_id", "turn", "x")
    # Means of a few observations may lie half-way between two reported values; they are scaled and rounded as SQL does it.
    return h.select(*[(F.round(F.col(k) * 1e8) / 1e8 + F.lit(0.0)).alias(k) if t == "double" else F.col(k) for k, t in h.dtypes])


@query("R20_R21_spliced_returns", f"""WITH {WEEKLY}, f AS (SELECT series_id, date, value / 1000 AS n1, value / 1000 * 1.05 AS n2, CAST(floor(date_diff('day', DATE '1990-01-05', date) / 91.0) AS INTEGER) AS contract FROM weekly),
    l AS (SELECT *, CASE WHEN lag(contract) OVER w IS NOT NULL AND lag(contract) OVER w <> contract THEN 1 ELSE 0 END AS roll, lag(n1) OVER w AS b1, lag(n2) OVER w AS b2 FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    q AS (SELECT *, n1 / CASE WHEN roll = 1 THEN b2 ELSE b1 END - 1 AS raw FROM l), g AS (SELECT *, CASE WHEN abs(raw) <= 0.5 THEN raw END AS ret FROM q)
    SELECT series_id, CAST(date AS VARCHAR) AS date, roll, round(ret, 8) + 0.0 AS ret, round(100 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY series_id ORDER BY date)), 4) + 0.0 AS level FROM g""")
def _(spark, d):
    f = weekly(spark, d).select("series_id", "date", (F.col("value") / 1000).alias("n1"), (F.col("value") / 1000 * 1.05).alias("n2"), F.floor(F.datediff("date", F.lit("1990-01-05")) / 91).cast("int").alias("contract"))
    s = folds.spliced_returns(f, "series_id", "date", "n1", "n2", "contract")
    return _text_date(s.select("series_id", "date", "roll", r("ret", 8).alias("ret"), r("level", 4).alias("level")))


# --- the minimum slice: signal, backtest, metrics ------------------------------------------

_SLICE = f"""WITH RECURSIVE {PAIR}, z AS (SELECT *, CASE WHEN count(spread) OVER f >= {{n}} THEN (spread - avg(spread) OVER f) / stddev_pop(spread) OVER f END AS zs FROM pair WINDOW f AS (ORDER BY date ROWS BETWEEN {{b}} PRECEDING AND CURRENT ROW)),
    k AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM z),
    s AS (SELECT CAST(0 AS BIGINT) AS i, 0 AS st UNION ALL SELECT k.i, CASE WHEN zs IS NULL THEN st WHEN zs >= 2.0 THEN -1 WHEN zs <= -2.0 THEN 1 WHEN abs(zs) <= 0.5 THEN 0 ELSE st END FROM s JOIN k ON k.i = s.i + 1),
    p AS (SELECT k.*, CAST(coalesce(lag(st) OVER (ORDER BY k.i), 0) AS DOUBLE) AS p, coalesce(spread - lag(spread) OVER (ORDER BY k.i), 0) AS ch FROM s JOIN k USING (i)),
    t AS (SELECT *, abs(p - coalesce(lag(p) OVER (ORDER BY i), 0)) AS turn FROM p), e AS (SELECT *, p * ch - turn * 100.0 AS pnl FROM t),
    c AS (SELECT *, sum(pnl) OVER (ORDER BY i) AS cum FROM e), dd AS (SELECT *, cum - max(cum) OVER (ORDER BY i) AS dd FROM c)
    SELECT {{w}} CAST(count(*) AS BIGINT) AS n, round(sum(pnl), 3) + 0.0 AS total, round(CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(52.0) END, 6) + 0.0 AS sharpe, round(avg(CASE WHEN p <> 0 THEN CAST(pnl > 0 AS INTEGER) END), 6) + 0.0 AS hit,
           round(min(dd), 3) + 0.0 AS max_drawdown, round(sum(turn), 3) + 0.0 AS turnover FROM dd"""


def _slice(spark, d, n: int) -> DataFrame:
    z = pair(spark, d).withColumn("z", W.rolling_z("spread", _by(), n, n))
    signal = folds.hysteresis(z, "series_id", "date", "z").select("series_id", "date", "signal")
    m = R.backtest(z.join(signal, ["series_id", "date"]), "series_id", "date", "signal", "spread", 100.0, 52.0)
    return r_all(m.drop("series_id"), 3, sharpe=6, hit=6)


@query("slice_10s5s", _SLICE.format(n=60, b=59, w=""))
def _(spark, d):
    """Spread of two legs, band z, hysteresis, backtest: one metrics row."""
    return _slice(spark, d, 60)


@query("A28_window_sweep", " UNION ALL ".join(f"SELECT * FROM ({_SLICE.format(n=n, b=n - 1, w=f'{n} AS win,')})" for n in (20, 40)))
def _(spark, d):
    parts = [_slice(spark, d, n).select(F.lit(n).alias("win"), "*") for n in (20, 40)]
    return parts[0].unionByName(parts[1])


# --- regressions and tests --------------------------------------------------------------------


@query("R01_newey_west", f"""WITH {PAIR}, c AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a, count(*) AS n, sum(z) AS sx, sum(z * z) AS sxx FROM pair),
    e AS (SELECT row_number() OVER (ORDER BY date) AS i, z, y - a - b * z AS e FROM pair, c), u AS (SELECT i, e AS u0, e * z AS u1 FROM e),
    m AS (SELECT h, sum(p.u0 * q.u0) AS s00, sum(p.u0 * q.u1) AS s01, sum(p.u1 * q.u0) AS s10, sum(p.u1 * q.u1) AS s11 FROM u AS p, (SELECT unnest(range(0, 6)) AS h) AS hs JOIN u AS q ON q.i = p.i - h GROUP BY h),
    t AS (SELECT sum(CASE WHEN h = 0 THEN s00 ELSE (1 - h / 6.0) * 2 * s00 END) AS m00, sum(CASE WHEN h = 0 THEN s01 ELSE (1 - h / 6.0) * (s01 + s10) END) AS m01, sum(CASE WHEN h = 0 THEN s11 ELSE (1 - h / 6.0) * 2 * s11 END) AS m11 FROM m),
    v AS (SELECT *, n * sxx - sx * sx AS det FROM c, t)
    SELECT n, round(b, 6) + 0.0 AS slope, round(sqrt((sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / det / det), 6) + 0.0 AS se FROM v""")
def _(spark, d):
    fit = linear.newey_west(pair(spark, d), "series_id", "date", "y", ["z"], 5)
    return r_all(frame(spark, [(fit["n"], fit["coef"][1], fit["se"][1])], "n long, slope double, se double"))


def _steps(first: str, response: str, columns: list[str]) -> str:
    """SQL that takes columns (and the response) about their means and makes each orthogonal to those before it, in order: ``u1, u2...`` beside the response ``v``."""
    parts = [f"o0 AS (SELECT {response} - avg({response}) OVER () AS v, {', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in columns)} FROM {first})"]
    for k, c in enumerate(columns):
        rest = "".join(f", {x} - {c} * (sum({x} * {c}) OVER ()) / (sum({c} * {c}) OVER ()) AS {x}" for x in columns[k + 1 :])
        done = "".join(f", u{j + 1}" for j in range(k))
        parts.append(f"o{k + 1} AS (SELECT v{done}, {c} AS u{k + 1}{rest} FROM o{k})")
    return ", ".join(parts)


_GRANGER = f"""{PAIR}, l AS (SELECT y, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(z) OVER w AS z1, lag(z, 2) OVER w AS z2 FROM pair WINDOW w AS (ORDER BY date)), c AS (SELECT * FROM l WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL), {_steps("c", "y", ["y1", "y2", "z1", "z2"])},
    g AS (SELECT count(*) AS n, sum(v * v) AS vv, sum(v * u1) ** 2 / sum(u1 * u1) + sum(v * u2) ** 2 / sum(u2 * u2) AS own, sum(v * u3) ** 2 / sum(u3 * u3) + sum(v * u4) ** 2 / sum(u4 * u4) AS other FROM o4), f AS (SELECT n, other / 2 / ((vv - own - other) / (n - 5)) AS f FROM g)"""


@query("R02_granger", f"WITH {_GRANGER} SELECT n, round(f, 6) + 0.0 AS f, round((1 + 2 * f / (n - 5)) ** (-(n - 5) / 2.0), 6) + 0.0 AS p FROM f")
def _(spark, d):
    g = linear.granger(pair(spark, d), "series_id", "date", "y", "z", 2)
    return r_all(frame(spark, [(g["n"], g["f"], g["p"])], "n long, f double, p double"))


@query("R03_betas", f"WITH {PAIR} SELECT round(regr_slope(y, z), 8) + 0.0 AS beta, round(regr_intercept(y, z), 3) + 0.0 AS alpha, round(regr_r2(y, z), 8) + 0.0 AS r2, CAST(count(*) AS BIGINT) AS n FROM pair")
def _(spark, d):
    fit = linear.ols(pair(spark, d), "y", ["z"])
    return r_all(frame(spark, [(fit["coef"][1], fit["coef"][0], fit["r2"], fit["n"])], "beta double, alpha double, r2 double, n long"), 8, alpha=3)


@query("R04_quantile_regression")
def _(spark, d):
    p = pair(spark, d).select((F.col("y") / 1e5).alias("y"), (F.col("z") / 1e5).alias("z")).persist()
    rows = [(q, *linear.quantile_regression(p, "y", ["z"], q, 15)) for q in (0.1, 0.5, 0.9)]
    p.unpersist()
    return r_all(frame(spark, rows, "q double, alpha double, beta double"))


@query("R05_influence", f"""WITH {PAIR}, c AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM pair),
    e AS (SELECT date, y - a - b * z AS e, 1.0 / n + (z - m) ** 2 / (n * v) AS h, n FROM pair, c), s AS (SELECT sum(e * e) / (count(*) - 2) AS s2 FROM e)
    SELECT CAST(date AS VARCHAR) AS date, round(h, 8) + 0.0 AS leverage, round(e * e / (2 * s2) * h / (1 - h) ** 2, 8) + 0.0 AS cooks FROM e, s""")
def _(spark, d):
    return _text_date(linear.influence(pair(spark, d), "y", "z").select("date", r("leverage", 8).alias("leverage"), r("cooks", 8).alias("cooks")))


@query("R06_curve_factors", """WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice / 1e5 AS y, (1 - exp(-0.6 * (o_orderkey % 6 + 1))) / (0.6 * (o_orderkey % 6 + 1)) AS s, exp(-0.6 * (o_orderkey % 6 + 1)) AS e FROM orders),
    m AS (SELECT month, count(*) AS n, sum(s) AS s, sum(s - e) AS c, sum(s * s) AS ss, sum(s * (s - e)) AS sc, sum((s - e) ** 2) AS cc, sum(y) AS y, sum(s * y) AS sy, sum((s - e) * y) AS cy, sum(y * y) AS yy FROM o GROUP BY 1),
    d AS (SELECT *, n * (ss * cc - sc * sc) - s * (s * cc - sc * c) + c * (s * sc - ss * c) AS det FROM m),
    b AS (SELECT *, CASE WHEN n >= 3 AND abs(det) > 1e-12 THEN (y * (ss * cc - sc * sc) - s * (sy * cc - sc * cy) + c * (sy * sc - ss * cy)) / det END AS b0,
        CASE WHEN n >= 3 AND abs(det) > 1e-12 THEN (n * (sy * cc - sc * cy) - y * (s * cc - sc * c) + c * (s * cy - sy * c)) / det END AS b1, CASE WHEN n >= 3 AND abs(det) > 1e-12 THEN (n * (ss * cy - sy * sc) - s * (s * cy - sy * c) + y * (s * sc - ss * c)) / det END AS b2 FROM d)
    SELECT CAST(month AS VARCHAR) AS month, round(b0, 5) + 0.0 AS b0, round(b1, 5) + 0.0 AS b1, round(b2, 5) + 0.0 AS b2, round(sqrt(greatest(yy - b0 * y - b1 * sy - b2 * cy, 0) / n), 5) + 0.0 AS rmse FROM b""")
def _(spark, d):
    s = table(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("month"), (F.col("o_orderkey") % 6 + 1).cast("double").alias("tenor"), (F.col("o_totalprice") / 1e5).alias("y"))
    return _text_date(r_all(linear.curve_factors(s, "month", "tenor", "y", 0.6), 5), "month")


@query("R07_R08_var", None)
def _(spark, d):
    fit = linear.var_fit(pair(spark, d), "series_id", "date", ["y", "z"], 2)
    share = linear.variance_shares(fit, 10)
    return r_all(frame(spark, [(a, b, share[i, j]) for i, a in enumerate(fit["columns"]) for j, b in enumerate(fit["columns"])], "response string, shock string, share double"))


@query("R09_T04_unit_root", f"""WITH {PAIR}, d AS (SELECT date, spread, spread - lag(spread) OVER w AS d, lag(spread) OVER w AS b FROM pair WINDOW w AS (ORDER BY date)), l AS (SELECT d, b, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM d WINDOW w AS (ORDER BY date)), c AS (SELECT * FROM l WHERE d IS NOT NULL AND b IS NOT NULL AND d1 IS NOT NULL AND d2 IS NOT NULL), {_steps("c", "d", ["d1", "d2", "b"])},
    g AS (SELECT count(*) AS n, sum(v * u3) AS p, sum(u3 * u3) AS q, sum(v * v) - sum(v * u1) ** 2 / sum(u1 * u1) - sum(v * u2) ** 2 / sum(u2 * u2) - sum(v * u3) ** 2 / sum(u3 * u3) AS ssr FROM o3)
    SELECT n, round(p / q / sqrt(ssr / (n - 4) / q), 6) + 0.0 AS t, p / q / sqrt(ssr / (n - 4) / q) < -2.86 AS stationary FROM g""")
def _(spark, d):
    t = linear.unit_root(pair(spark, d), "series_id", "date", "spread", 2)
    return r_all(frame(spark, [(t["n"], t["t"], t["stationary"])], "n long, t double, stationary boolean"))


@query("T01_half_life", f"""WITH {WEEKLY}, l AS (SELECT series_id, value AS x, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS b FROM weekly), s AS (SELECT series_id, count(*) AS n, regr_slope(x - b, b) AS slope FROM l WHERE b IS NOT NULL GROUP BY 1)
    SELECT series_id, CAST(n AS BIGINT) AS n, round(slope, 6) + 0.0 AS slope, round(CASE WHEN slope < 0 THEN -ln(2) / slope END, 5) + 0.0 AS half_life FROM s""")
def _(spark, d):
    return r_all(E.half_life(weekly(spark, d), "series_id", "date", "value"), 6, half_life=5)


@query("T02_mean_reversion", f"""WITH {WEEKLY}, l AS (SELECT series_id, value AS x, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS b FROM weekly)
    SELECT series_id, round(-regr_slope(x - b, b) * 52, 6) + 0.0 AS kappa, round(-regr_intercept(x - b, b) / regr_slope(x - b, b), 3) + 0.0 AS mean, round(sqrt(regr_syy(x - b, b) * (1 - regr_r2(x - b, b)) / (count(*) - 2)) * sqrt(52.0), 3) + 0.0 AS sigma FROM l WHERE b IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return r_all(simulate.mean_reversion(weekly(spark, d), "series_id", "date", "value", 52.0), 3, kappa=6)


@query("T03_drift_and_volatility", f"""WITH {WEEKLY}, l AS (SELECT series_id, date, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY date)) AS g, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM weekly)
    SELECT series_id, round(avg(g) * 52 + var_samp(g) * 52 / 2, 6) + 0.0 AS mu, round(stddev_samp(g) * sqrt(52.0), 6) + 0.0 AS sigma FROM l WHERE k <= 160 AND g IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return r_all(simulate.drift_and_volatility(weekly(spark, d), "series_id", "date", "value", 160, 52.0))


@query("T07_loss_tests", f"""WITH {PAIR}, l AS (SELECT row_number() OVER (ORDER BY date) AS i, (y - lag(y) OVER (ORDER BY date)) / 1e5 AS a, (y - lag(y, 2) OVER (ORDER BY date)) / 1e5 AS b FROM pair), d AS (SELECT i, a * a - b * b AS d FROM l WHERE b IS NOT NULL)
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(d) / sqrt(var_samp(d) / count(*)), 6) + 0.0 AS stat FROM d""")
def _(spark, d):
    w = _by()
    e = pair(spark, d).select("series_id", "date", (W.change("y", w) / 1e5).alias("a"), ((F.col("y") - F.lag("y", 2).over(w)) / 1e5).alias("b")).dropna()
    return r_all(E.loss_test_sample(e, "a", "b"))


@query("T17_crps", """WITH g AS (SELECT o_orderpriority AS k, o_totalprice / 1e5 AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice / 1e5, o_orderkey) AS i FROM orders)
    SELECT k, round(avg(abs(x - 2.0)) - sum((2 * i - count_ - 1) * x) / (any_value(count_) * any_value(count_)), 8) + 0.0 AS crps, round(avg(CAST(x <= 2.0 AS INTEGER)), 8) + 0.0 AS pit FROM (SELECT *, count(*) OVER (PARTITION BY k) AS count_ FROM g) GROUP BY 1""")
def _(spark, d):
    g = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") / 1e5).alias("x"), F.lit(2.0).alias("obs"))
    return r_all(E.crps(g, "k", "x", "obs"), 8)


@query("T18_regression_scores", f"""WITH {PAIR} SELECT CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((y - z) ** 2)), 4) + 0.0 AS rmse, round(avg(abs(y - z)), 4) + 0.0 AS mae, round(1 - sum((y - z) ** 2) / (count(*) * var_pop(y)), 6) + 0.0 AS r2 FROM pair""")
def _(spark, d):
    return r_all(E.regression_scores(pair(spark, d), "y", "z"), 4, r2=6)


@query("T18_classification_scores", """WITH t AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, 0.05 + (o_orderkey % 19) / 21.0 AS p FROM orders)
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 8) + 0.0 AS accuracy, round(sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) / sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 8) + 0.0 AS precision,
           round(sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) / sum(y), 8) + 0.0 AS recall, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) + 0.0 AS log_loss, round(avg((p - y) ** 2), 8) + 0.0 AS brier FROM t""")
def _(spark, d):
    t = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (0.05 + (F.col("o_orderkey") % 19) / 21.0).alias("p"))
    return r_all(E.classification_scores(t, "y", "p"), 8)


@query("M06_auc", """WITH t AS (SELECT o_orderstatus = 'F' AS y, o_totalprice AS p FROM orders), k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM t)
    SELECT round((sum(CASE WHEN y THEN r END) - CAST(count(*) FILTER (WHERE y) AS DOUBLE) * (count(*) FILTER (WHERE y) + 1) / 2) / (CAST(count(*) FILTER (WHERE y) AS DOUBLE) * count(*) FILTER (WHERE NOT y)), 8) + 0.0 AS auc FROM k""")
def _(spark, d):
    t = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("p"))
    return r_all(E.auc(t, "y", "p"), 8)


@query("M12_rank_correlation", f"""WITH {WEEKLY}, k AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY value) AS a, rank() OVER (PARTITION BY series_id ORDER BY n) + (count(*) OVER (PARTITION BY series_id, n) - 1) / 2.0 AS b FROM weekly)
    SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 8) + 0.0 AS ic FROM k GROUP BY 1""")
def _(spark, d):
    return r_all(E.rank_correlation(weekly(spark, d).withColumnRenamed("n", "m"), "series_id", "value", "m"), 8)


@query("H09_surprise_probability", "SELECT o_orderkey, round(CASE WHEN q < 1 THEN 0 WHEN q <= 2 THEN 0.1 + (q - 1) * 0.4 WHEN q <= 4 THEN 0.5 + (q - 2) / 2 * 0.4 ELSE 1 END, 8) + 0.0 AS p FROM (SELECT o_orderkey, o_totalprice / 1e5 AS q FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("q"))
    return o.select("o_orderkey", r(R.interpolate(F.col("q"), [(0.1, F.lit(1.0)), (0.5, F.lit(2.0)), (0.9, F.lit(4.0))]), 8).alias("p"))


@query("R24_survival", """WITH h AS (SELECT c_custkey, k, 0.01 + ((c_custkey * 7 + k * 3) % 20) / 100.0 AS h FROM customer, unnest(range(1, 14)) AS r(k))
    SELECT c_custkey, round(1 - exp(sum(CASE WHEN k <= 4 THEN ln(1 - h) ELSE 0 END)), 8) + 0.0 AS within4, round(exp(sum(CASE WHEN k <= 4 THEN ln(1 - h) ELSE 0 END)) - exp(sum(CASE WHEN k <= 8 THEN ln(1 - h) ELSE 0 END)), 8) + 0.0 AS first5_8, round(1 - exp(sum(CASE WHEN k BETWEEN 5 AND 8 THEN ln(1 - h) ELSE 0 END)), 8) + 0.0 AS any5_8 FROM h GROUP BY 1""")
def _(spark, d):
    h = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("k")).withColumn("hazard", 0.01 + ((F.col("c_custkey") * 7 + F.col("k") * 3) % 20) / 100.0)
    out = None
    for name, spec in (("within4", ("within", 4)), ("first5_8", ("interval", 5, 8)), ("any5_8", ("recurrent", 5, 8))):
        p = survival.timing_probability(h, "c_custkey", "k", spec).withColumnRenamed("probability", name)
        out = p if out is None else out.join(p, "c_custkey")
    return r_all(out, 8)


# --- models ---------------------------------------------------------------------------------------


def _vectors(spark, d):
    """Whole vectors; ``rest`` is all but the first element."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", "label", "embedding", F.col("embedding")[0].alias("x0"), F.slice("embedding", 2, 1000).alias("rest"))


_ELEMENTS = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query("M01_vector_moments", f"WITH {_ELEMENTS} SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 5) + 0.0 AS total FROM e AS a JOIN e AS b USING (vec_id) WHERE a.i <= b.i GROUP BY ALL")
def _(spark, d):
    return r_all(vectors.gram_entries(_vectors(spark, d), "embedding"), 5)


@query("M01_pca")
def _(spark, d):
    v = _vectors(spark, d)
    return r_all(vectors.project(v, "embedding", vectors.pca(v, "embedding", 3)).select("vec_id", "pc1", "pc2", "pc3"), 5)


@query("M04_M05_binary_models")
def _(spark, d):
    v = _vectors(spark, d).select("embedding", (F.col("label") % 2).alias("y")).persist()
    rows = [(link, k, float(c)) for link in ("logit", "cloglog") for k, c in enumerate(vectors.binary_model(v, "embedding", F.col("y"), link=link))]
    v.unpersist()
    return r_all(frame(spark, rows, "link string, k int, coef double"), 5)


@query("M05_group_rates", """WITH p AS (SELECT avg(CAST(l_returnflag = 'R' AS INT)) FILTER (l_quantity <= 25) AS a, avg(CAST(l_returnflag = 'R' AS INT)) FILTER (l_quantity > 25) AS b FROM lineitem)
    SELECT link, CAST(k AS INTEGER) AS k, round(coef, 6) + 0.0 AS coef FROM p, LATERAL (VALUES ('logit', 0, ln(a / (1 - a))), ('logit', 1, ln(b / (1 - b)) - ln(a / (1 - a))), ('cloglog', 0, ln(-ln(1 - a))), ('cloglog', 1, ln(-ln(1 - b)) - ln(-ln(1 - a)))) AS t(link, k, coef)""")
def _(spark, d):
    """One yes-or-no regressor: the fit is the groups' rates on the link's scale."""
    v = table(spark, d, "lineitem").select(F.array((F.col("l_quantity") > 25).cast("double")).alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y")).persist()
    rows = [(link, k, float(c)) for link in ("logit", "cloglog") for k, c in enumerate(vectors.binary_model(v, "x", F.col("y"), link=link, l2=0.0))]
    v.unpersist()
    return r_all(frame(spark, rows, "link string, k int, coef double"))


@query("M07_linear_models")
def _(spark, d):
    fits = vectors.linear_models(_vectors(spark, d), "rest", F.col("x0"))
    return r_all(frame(spark, [(n, k, float(c)) for n, f in fits.items() for k, c in enumerate(f)], "model string, k int, coef double"))


@query("M07_one_regressor", """WITH m AS (SELECT avg(embedding[1]::DOUBLE) AS my, avg(embedding[2]::DOUBLE) AS mx, count(*) AS n, var_pop(embedding[2]::DOUBLE) AS v, covar_pop(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS c FROM embeddings),
    b AS (SELECT model, my, mx, slope FROM m, LATERAL (VALUES ('ols', c / v), ('ridge', c * n / (v * n + 1)), ('lasso', sign(c) * greatest(abs(c) / sqrt(v) - 0.01, 0) / sqrt(v)), ('elastic_net', sign(c) * greatest(abs(c) / sqrt(v) - 0.005, 0) / 1.5 / sqrt(v))) AS t(model, slope))
    SELECT model, CAST(k AS INTEGER) AS k, round(CASE WHEN k = 0 THEN my - slope * mx ELSE slope END, 6) + 0.0 AS coef FROM b, (VALUES (0), (1)) AS s(k)""")
def _(spark, d):
    """With one regressor each of the four fits has a closed form."""
    fits = vectors.linear_models(_vectors(spark, d).withColumn("rest", F.slice("rest", 1, 1)), "rest", F.col("x0"))
    return r_all(frame(spark, [(n, k, float(c)) for n, f in fits.items() for k, c in enumerate(f)], "model string, k int, coef double"))


@query("T15_variance_inflation")
def _(spark, d):
    found = vectors.variance_inflation(_vectors(spark, d), "embedding")
    return r_all(frame(spark, [(k, float(v)) for k, v in enumerate(found)], "element int, vif double"))


@query("T15_two_elements", "WITH s AS (SELECT sum(embedding[1]::DOUBLE * embedding[2]) AS xy, sum(embedding[1]::DOUBLE ** 2) AS xx, sum(embedding[2]::DOUBLE ** 2) AS yy FROM embeddings) SELECT CAST(k AS INTEGER) AS element, round(1 / (1 - xy * xy / (xx * yy)), 8) + 0.0 AS vif FROM s, (VALUES (0), (1)) AS t(k)")
def _(spark, d):
    found = vectors.variance_inflation(_vectors(spark, d).withColumn("embedding", F.slice("embedding", 1, 2)), "embedding")
    return r_all(frame(spark, [(k, float(v)) for k, v in enumerate(found)], "element int, vif double"), 8)


@query("M08_boosted_trees")
def _(spark, d):
    return ml.tree_scores(_vectors(spark, d), "x0", "rest")


@query("M19_M20_text_clusters")
def _(spark, d):
    return ml.text_clusters(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", 4)


@query("M09_ordered_logit")
def _(spark, d):
    v = _vectors(spark, d).select("rest", F.when(F.col("x0") > 0.05, 2).when(F.col("x0") < -0.05, 0).otherwise(1).alias("y")).persist()
    slopes, cuts = vectors.ordered_model(v, "rest", F.col("y"), 3)
    v.unpersist()
    return r_all(frame(spark, [(k, float(x)) for k, x in enumerate([*cuts, *slopes])], "k int, value double"), 5)


@query("H08_ordered_probabilities")
def _(spark, d):
    """Each vector's class probabilities under the ordered model fitted to all."""
    v = _vectors(spark, d).select("vec_id", "rest", F.when(F.col("x0") > 0.05, 2).when(F.col("x0") < -0.05, 0).otherwise(1).alias("y")).persist()
    scored = vectors.ordered_probabilities(v, "rest", *vectors.ordered_model(v, "rest", F.col("y"), 3))
    return r_all(scored.select("vec_id", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)]), 5)


@query("M10_block_bootstrap")
def _(spark, d):
    return r_all(resampling.block_bootstrap(pair(spark, d), "series_id", "date", "spread", block=13, replicates=2000, seed=42))


@query("M14_purged_cross_validation")
def _(spark, d):
    return r_all(ml.combinatorial_ic(pair(spark, d), "date", "y", "z", 6, 2))


# --- simulation -------------------------------------------------------------------------------------


_MOTION = f"""{WEEKLY}, l AS (SELECT series_id, date, value, ln(value / lag(value) OVER w) AS g, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    m AS (SELECT series_id, avg(g) * 52 + var_samp(g) * 52 / 2 AS mu, stddev_samp(g) * sqrt(52) AS sigma, max(CASE WHEN k = 1 THEN value END) AS start FROM l WHERE k <= 160 GROUP BY 1)"""


def _motion(spark, d):
    """``series_id, start, mu, sigma``: each weekly series' last value, and drift and volatility of its last 160 weeks."""
    w = weekly(spark, d)
    last = w.groupBy("series_id").agg(F.max_by("value", "date").alias("start"))
    return simulate.drift_and_volatility(w, "series_id", "date", "value", 160, 52.0).join(last, "series_id")


@query("G01_closed_form_fan", f"""WITH {_MOTION} SELECT series_id, CAST(h AS INTEGER) AS step, {", ".join(f"round(ln(start * exp((mu - sigma ** 2 / 2) * h / 52.0 + {z} * sigma * sqrt(h / 52.0))), 6) + 0.0 AS ln_{q}" for q, z in (("q05", -1.6448536269514722), ("q50", 0.0), ("q95", 1.6448536269514722)))} FROM m, unnest(range(1, 31)) AS r(h)""")
def _(spark, d):
    fan = simulate.closed_form_fan(_motion(spark, d), "series_id", 30, 52.0)
    return fan.select("series_id", "step", *[r(F.log(q)).alias(f"ln_{q}") for q in ("q05", "q50", "q95")])


@query("G02_G03_paths")
def _(spark, d):
    """Ten thousand paths a series: variances fitted to its returns, carried to a stochastic variance around them."""
    g = simulate.garch(weekly(spark, d).select("series_id", "date", W.pct_change("value", _by()).alias("ret")), "series_id", "date", "ret").join(_motion(spark, d), "series_id")
    theta = F.col("long_run") ** 2 * 52
    p = g.select("series_id", "start", F.lit(0.0).alias("mu"), theta.alias("v0"), theta.alias("theta"), (F.greatest(1 - F.col("alpha") - F.col("beta"), F.lit(1e-4)) * 52).alias("kappa"), (F.col("alpha") * F.sqrt(2 * theta) * F.sqrt(F.lit(52.0))).alias("xi"), F.lit(-0.3).alias("rho"))
    return r_all(simulate.path_summary(simulate.heston_paths(p, "series_id", 10000, 30, 42, 52.0), "series_id"), 4)


@query("G04_desk_metrics")
def _(spark, d):
    return r_all(simulate.desk_metrics(simulate.gbm_paths(_motion(spark, d), "series_id", 10000, 30, 42, 52.0), "series_id", 1.05, 0.95), 4)


@query("G06_dispersion")
def _(spark, d):
    """Paths of each series' motion, spread by a fifth and tilted a little each step."""
    paths = C.dispersed(simulate.gbm_paths(_motion(spark, d), "series_id", 1000, 10, 7, 52.0), "series_id", "step", "value", 1.2, 0.001)
    return r_all(simulate.path_summary(paths, "series_id"), 4)


@query("T05_arima")
def _(spark, d):
    return r_all(arima.walk_forward(pair(spark, d), "series_id", "date", "spread", 60, ((1, 0), (0, 1), (1, 1), (0, 2))), 4)


@query("T08_regimes")
def _(spark, d):
    return _text_date(r_all(simulate.regimes(_zed(spark, d).where("z is not null").select("series_id", "date", "z"), "series_id", "date", "z"), 6))


@query("T09_garch")
def _(spark, d):
    return r_all(simulate.garch(weekly(spark, d).select("series_id", "date", (W.pct_change("value", _by())).alias("ret")), "series_id", "date", "ret"), 5)
