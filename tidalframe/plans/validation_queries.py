"""Out-of-sample studies, roll diagnostics and version comparison on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import relational as R
from ..operators import resampling
from ..operators import validation as V
from ..registry import query, r_all
from .analogues import PAIR, WEEKLY, pair, weekly


@query("M18_expanding_evaluation", f"""WITH {PAIR}, b AS (SELECT date, y / 1e5 AS y, lag(z / 1e5) OVER o AS x, lag(y / 1e5) OVER o AS before FROM pair WINDOW o AS (ORDER BY date)), c AS (SELECT * FROM b WHERE x IS NOT NULL AND y IS NOT NULL),
    f AS (SELECT *, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy FROM c WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT y, before, sy / n + (sxy - sx * sy / n) / (sxx - sx * sx / n) * (x - sx / n) AS p FROM f WHERE n >= 60)
    SELECT 'pair' AS series_id, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((y - p) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(y - p)), 6) + 0.0 AS mae, round(sqrt(avg((y - before) ** 2)), 6) + 0.0 AS naive_rmse, round(sqrt(avg((y - p) ** 2)) / sqrt(avg((y - before) ** 2)), 6) + 0.0 AS ratio, round(avg(CASE WHEN sign(p - before) = sign(y - before) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS direction FROM p""")
def _(spark, d):
    w = W.by("series_id", "date")
    b = pair(spark, d).select("series_id", "date", (F.col("y") / 1e5).alias("y"), F.lag(F.col("z") / 1e5).over(w).alias("x"), F.lag(F.col("y") / 1e5).over(w).alias("before"))
    return r_all(V.forecast_scores(V.expanding_forecasts(b, "series_id", "date", "y", "x", 60), "series_id", "y", "forecast", "before"))


@query("G05_rolling_origin_validation", f"""WITH {WEEKLY}, l AS (SELECT series_id, date, value, ln(value / lag(value) OVER w) AS r, lead(value, 6) OVER w AS later, row_number() OVER w AS k FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    s AS (SELECT *, count(r) OVER w AS n, stddev_samp(r) OVER w AS sd, avg(r) OVER w AS m FROM l WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 59 PRECEDING))
    SELECT series_id, CAST(count(*) AS BIGINT) AS origins, round(avg(CASE WHEN abs(ln(later / value)) <= 1.6448536269514722 * sd * sqrt(6) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS cover90, round(avg(CASE WHEN abs(ln(later / value)) <= 0.6744897501960817 * sd * sqrt(6) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS cover50,
        round(sqrt(avg((later - value) ** 2)), 4) + 0.0 AS rmse_flat, round(sqrt(avg((later - value * exp(6 * m)) ** 2)), 4) + 0.0 AS rmse_trend FROM s WHERE n = 60 AND k % 4 = 0 AND later IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return r_all(V.rolling_origin(weekly(spark, d).select("series_id", "date", "value"), "series_id", "date", "value"), rmse_flat=4, rmse_trend=4)


@query("R22_roll_diagnostics", f"""WITH {WEEKLY}, f AS (SELECT series_id, date, value AS p, value * 1.05 AS far, CAST(floor(date_diff('day', DATE '1990-01-05', date) / 91.0) AS INTEGER) AS c FROM weekly),
    l AS (SELECT *, lag(c) OVER w AS c1, lag(p) OVER w AS p1, lag(far) OVER w AS far1 FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date)), m AS (SELECT *, c1 IS NOT NULL AND c1 <> c AS roll, abs(p / p1 - 1) AS raw FROM l),
    u AS (SELECT *, CASE WHEN count(raw) OVER w >= 20 THEN quantile_cont(raw, 0.5) OVER w END AS usual, abs(p / CASE WHEN roll THEN far1 ELSE p1 END - 1) AS ret FROM m WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 62 PRECEDING))
    SELECT series_id, CAST(sum(CASE WHEN roll THEN 1 ELSE 0 END) AS BIGINT) AS rolls, round(sum(CASE WHEN roll THEN 1 ELSE 0 END) / greatest(max(year(date)) - min(year(date)), 1)::DOUBLE, 6) + 0.0 AS a_year, CAST(sum(CASE WHEN NOT roll AND raw > 2 * usual THEN 1 ELSE 0 END) AS BIGINT) AS jumps_off_rolls,
        CAST(sum(CASE WHEN roll AND c1 + 1 <> c THEN 1 ELSE 0 END) AS BIGINT) AS skips, round(avg(CASE WHEN roll THEN ret END), 8) + 0.0 AS on_rolls, round(avg(CASE WHEN NOT roll THEN ret END), 8) + 0.0 AS off_rolls FROM u GROUP BY 1""")
def _(spark, d):
    c = F.floor(F.date_diff("date", F.lit("1990-01-05").cast("date")) / 91.0).cast("int")
    f = weekly(spark, d).select("series_id", "date", F.col("value").alias("p"), (F.col("value") * 1.05).alias("far"), c.alias("c"), (c + 1).alias("next"))
    return r_all(V.roll_diagnostics(f, "series_id", "date", "p", "far", "c", "next", 2.0), on_rolls=8, off_rolls=8)


@query("H01_H02_version_comparison", f"""WITH {WEEKLY}, v AS (SELECT series_id, date, version, CASE WHEN version = 'v26' THEN CASE WHEN count(value) OVER a >= 13 THEN (value - avg(value) OVER a) / stddev_pop(value) OVER a END WHEN version = 'v13' THEN CASE WHEN count(value) OVER b >= 7 THEN (value - avg(value) OVER b) / stddev_pop(value) OVER b END ELSE CASE WHEN count(value) OVER c >= 26 THEN (value - avg(value) OVER c) / stddev_pop(value) OVER c END END AS z
        FROM weekly, (SELECT unnest(['v13', 'v26', 'v52']) AS version) WINDOW a AS (PARTITION BY series_id, version ORDER BY date ROWS 25 PRECEDING), b AS (PARTITION BY series_id, version ORDER BY date ROWS 12 PRECEDING), c AS (PARTITION BY series_id, version ORDER BY date ROWS 51 PRECEDING))
    SELECT v.series_id, v.version, CAST(count(*) AS BIGINT) AS n, round(corr(v.z, b.z), 8) + 0.0 AS corr, CAST(min(CASE WHEN v.z > 1.5 THEN v.date END) AS VARCHAR) AS first_crowded, CAST(min(CASE WHEN b.z > 1.5 THEN v.date END) - min(CASE WHEN v.z > 1.5 THEN v.date END) AS INTEGER) AS lead_days
    FROM v JOIN v AS b ON v.series_id = b.series_id AND v.date = b.date AND b.version = 'v26' WHERE v.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    w = W.by("series_id", "date")
    wide = weekly(spark, d).select("series_id", "date", W.rolling_z("value", w, 13, 7).alias("v13"), W.rolling_z("value", w, 26, 13).alias("v26"), W.rolling_z("value", w, 52, 26).alias("v52"))
    c = V.compare_versions(wide.unpivot(["series_id", "date"], ["v13", "v26", "v52"], "version", "z"), "series_id", "date", "version", "z", "v26", 1.5)
    return r_all(c.withColumn("first_crowded", F.col("first_crowded").cast("string")), 8)


@query("M17_lag_weighted_regression")
def _(spark, d):
    p = pair(spark, d).select("series_id", "date", (F.col("y") / 1e5).alias("y"), (F.col("z") / 1e5).alias("z"))
    k = R.last_k(p, ["series_id"], "date", "z", 8).where("lags is not null")
    fit = V.lag_weighted_regression(k.select("y", "lags"), "y", "lags", 8)
    rows = [("n", float(fit["n"])), ("intercept", float(fit["coef"][0])), ("slope", float(fit["coef"][1])), ("r2", float(fit["r2"])), *[(f"weight{i}", float(v)) for i, v in enumerate(fit["weights"])]]
    return r_all(spark.createDataFrame(rows, "name string, value double"), 4)


@query("R22_roll_leak_test")
def _(spark, d):
    """Are spliced returns larger on quarterly rolls than on other weeks?"""
    w = W.by("series_id", "date")
    c = F.floor(F.date_diff("date", F.lit("1990-01-05").cast("date")) / 91.0)
    f = weekly(spark, d).select("series_id", "date", "value", c.alias("c")).withColumn("ret", F.col("value") / F.lag("value").over(w) - 1).withColumn("roll", F.col("c") != F.lag("c").over(w))
    return r_all(resampling.roll_leak_test(f, "series_id", "date", "ret", F.col("roll")), 5)
