"""Tail bands (M11, H20) over the weekly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import latent, tails
from ..registry import query, r, r_all
from .analogues import WEEKLY, weekly

#: Values are reported over pi: means of cents tie when rounded.
_ROLLING = f"""WITH {WEEKLY}, k AS (SELECT series_id, date, x / pi() AS v, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM weekly WHERE x IS NOT NULL),
    b AS (SELECT *, {", ".join(f'CASE WHEN i > 52 THEN quantile_cont(v, {q}) OVER f END AS "q{q:g}"' for q in tails.LEVELS)} FROM k WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS 103 PRECEDING))"""


def _values(spark, d):
    return weekly(spark, d).select("series_id", "date", (F.col("x") / F.pi()).alias("v"))


@query("M11_rolling_bands", f"""{_ROLLING} SELECT series_id, CAST(date AS VARCHAR) AS date, round(v, 6) + 0.0 AS v, {", ".join(f'round("q{q:g}", 6) + 0.0 AS "q{q:g}"' for q in tails.LEVELS)} FROM b""")
def _(spark, d):
    out = tails.rolling_bands(_values(spark, d), "series_id", "date", "v", tail="empirical")
    return out.select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), *[r(F.col(f"`{c}`")).alias(c) for c in ("v", *map(tails.band, tails.LEVELS))])


@query("M11_band_coverage", f"""{_ROLLING}, u AS (SELECT series_id, v, level, band FROM b, LATERAL (VALUES {", ".join(f'({q}, "q{q:g}")' for q in tails.LEVELS)}) AS t(level, band) WHERE band IS NOT NULL),
    g AS (SELECT series_id, CAST(level AS DOUBLE) AS level, count(*) AS n, avg(CASE WHEN level >= 0.5 THEN CAST(v > band AS INT) ELSE CAST(v < band AS INT) END) AS rate, CAST(CASE WHEN level >= 0.5 THEN 1 - level ELSE level END AS DOUBLE) AS nominal FROM u GROUP BY ALL)
    SELECT series_id, level, n, round(rate, 8) + 0.0 AS breach_rate, round(nominal, 8) + 0.0 AS nominal, rate BETWEEN nominal / 2 AND nominal * 2 AS well_calibrated FROM g""")
def _(spark, d):
    bands = tails.rolling_bands(_values(spark, d), "series_id", "date", "v", tail="empirical")
    return r_all(tails.coverage(bands, "series_id", "v"), 8)


@query("M11_tail_models")
def _(spark, d):
    """Bands by Pareto tails (two hundred weeks) and by kernel density, side by side."""
    out = None
    for tail, window in (("gpd", 200), ("kde", 104)):
        part = tails.rolling_bands(_values(spark, d), "series_id", "date", "v", tail=tail, window=window).withColumn("tail", F.lit(tail))
        out = part if out is None else out.unionByName(part)
    return out.select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "tail", *[r(F.col(f"`{c}`"), 5).alias(c) for c in ("v", *map(tails.band, tails.LEVELS))])


@query("M11_resampled_bands")
def _(spark, d):
    return r_all(tails.resampled_bands(_values(spark, d), "series_id", "date", "v", window=200, draws=400), 5)


@query("H20_break_bands")
def _(spark, d):
    """Resampled bands of the weeks since each series' break, restated on their own scale."""
    whole, z, k = W.by("series_id", "date"), F.abs(F.col("z")), W.Window.partitionBy("series_id")
    df = weekly(spark, d).select("series_id", "date", ((F.col("value") - F.avg("value").over(k)) / F.stddev_pop("value").over(k)).alias("z"))
    df = df.withColumn("chance", F.avg(F.when(z > 1, 1.0).otherwise(0.0)).over(whole.rowsBetween(-3, 0)))
    since = latent.break_response(df, "series_id", "date", "z", z > 2.8, F.col("chance")).where("date >= broke_at")
    return r_all(tails.resampled_bands(since, "series_id", "date", "restated", tail="kde", draws=200), 5)
