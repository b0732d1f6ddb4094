"""Rolling-origin validation of fans (G05) over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import windows as W
from ..operators import fan_validation as V
from ..registry import query, r_all
from .analogues import DAILY, daily

HORIZON, LOOK, TREND = 30, 500, 160


def _scores(spark, d):
    """Trailing means of sixty days, from a series' five hundredth day: first Fridays are the events, the level's trailing score is the crowding."""
    w = W.by("series_id", "date")
    df = daily(spark, d).withColumn("value", F.avg("value").over(W.frame(w, 60))).withColumn("z", W.rolling_z("value", w, 250, 60))
    event = F.col("date") == dates.first_friday(F.trunc("date", "month"))
    found = V.origins(df, "series_id", "date", "value", event=event, crowding=F.col("z"), horizon=HORIZON, look=LOOK, trend=TREND)
    return V.score_origins(found, horizon=HORIZON, trend=TREND)


@query("G05_fan_validation")
def _(spark, d):
    return r_all(V.variant_board(_scores(spark, d)).withColumnRenamed("_key", "series_id"), 4)


@query("G05_origin_scores")
def _(spark, d):
    out = _scores(spark, d).withColumnRenamed("_key", "series_id").withColumn("origin", F.date_format("origin", "yyyy-MM-dd"))
    return r_all(out, 4)


@query("G05_drift_board", f"""WITH {DAILY}, smooth AS (SELECT series_id, date, avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS 59 PRECEDING) AS value FROM daily), l AS (SELECT series_id, date, value AS y, ln(value / lag(value) OVER w) AS r, lead(value, 30) OVER w AS later, row_number() OVER w - 1 AS i FROM smooth WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    s AS (SELECT *, avg(r) OVER a AS ma, stddev_samp(r) OVER a AS sa, avg(r) OVER b AS mb, stddev_samp(r) OVER b AS sb FROM l WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS 159 PRECEDING), b AS (PARTITION BY series_id ORDER BY date ROWS 499 PRECEDING)),
    e AS (SELECT series_id, date, name, y * exp(m * 30) - later AS error, y - later AS flat, CAST(later > y AS INT) AS up FROM s, LATERAL (VALUES ('trend', ma + sa ** 2 / 2), ('zero', 0.0), ('shrunk50', (ma + sa ** 2 / 2) / 2), ('long', mb + sb ** 2 / 2)) AS t(name, m) WHERE i >= 501 AND (i - 501) % 30 = 0 AND later IS NOT NULL),
    g AS (SELECT series_id, name, count(*) AS origins, sqrt(avg(error ** 2)) AS rmse, avg(up) AS base_rate, avg(error ** 2 - flat ** 2) / (stddev_pop(error ** 2 - flat ** 2) / sqrt(count(*))) AS dm FROM e GROUP BY ALL)
    SELECT series_id, name, origins, round(rmse, 4) + 0.0 AS rmse, round(base_rate, 6) + 0.0 AS base_rate, round(CASE WHEN name <> 'zero' AND origins >= 10 THEN dm END, 6) + 0.0 AS dm, row_number() OVER (PARTITION BY series_id ORDER BY rmse, name) = 1 AS winner FROM g""")
def _(spark, d):
    return r_all(V.drift_board(_scores(spark, d)).withColumnRenamed("_key", "series_id").drop("brier", "dm_p"), 6, rmse=4)
