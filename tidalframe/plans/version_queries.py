"""The ten versions side by side (H01, H02, M21, Y04) and their scorecard (M15), by desk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import validation as V
from ..operators import versions
from ..registry import query, r_all, table

_DESKS = """p AS (SELECT 'desk' || (l_suppkey % 2) AS desk, CAST(l_shipdate AS DATE) + CAST((12 - isodow(l_shipdate)) % 7 AS INTEGER) AS date, CASE WHEN l_linenumber <= 3 THEN 'front' ELSE 'long' END AS instrument, CASE WHEN l_quantity <= 25 THEN 'asset' ELSE 'lev' END AS category,
        CAST(sum(CASE WHEN l_partkey % 2 = 1 THEN CAST(round(l_quantity) AS BIGINT) ELSE -CAST(round(l_quantity) AS BIGINT) END) AS DOUBLE) AS net, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS oi FROM lineitem GROUP BY ALL),
    w AS (SELECT desk, date, sum(net) AS level, (coalesce(sum(CASE WHEN category = 'asset' AND instrument = 'front' THEN net END), 0) - coalesce(sum(CASE WHEN category = 'asset' AND instrument = 'long' THEN net END), 0) + coalesce(sum(CASE WHEN category = 'lev' AND instrument = 'front' THEN net END), 0) - coalesce(sum(CASE WHEN category = 'lev' AND instrument = 'long' THEN net END), 0)) / 2 AS curve,
        coalesce(sum(CASE WHEN category = 'asset' THEN net END), 0) AS cat_asset, coalesce(sum(CASE WHEN category = 'lev' THEN net END), 0) AS cat_lev FROM p GROUP BY ALL),
    o AS (SELECT desk, date, sum(oi) AS oi FROM (SELECT desk, date, instrument, max(oi) AS oi FROM p GROUP BY ALL) GROUP BY ALL)"""


def _inputs(spark, d):
    """Weekly net quantities of two desks, each of two categories in a front and a long instrument; the mean price is the target."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice")
    q = F.round("l_quantity").cast("long")
    desk, date = F.concat(F.lit("desk"), (F.col("l_suppkey") % 2).cast("string")).alias("desk"), dates.week_ending_friday(F.to_date("l_shipdate")).alias("date")
    p = li.groupBy(desk, date, F.when(F.col("l_linenumber") <= 3, "front").otherwise("long").alias("instrument"), F.when(F.col("l_quantity") <= 25, "asset").otherwise("lev").alias("category"))
    p = p.agg(F.sum(F.when(F.col("l_partkey") % 2 == 1, q).otherwise(-q)).cast("double").alias("net"), F.sum(q).cast("double").alias("oi"))
    price = li.groupBy(desk, date).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*") / 100).alias("price"))
    return versions.inputs(p, "desk", "date", "instrument", "category", "net", "oi", scoring=["asset", "lev"], front=["front"], long=["long"], extra=price)


def _text(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("H01_version_inputs", f"WITH {_DESKS} SELECT desk, CAST(date AS VARCHAR) AS date, level, curve, oi, cat_asset, cat_lev FROM w JOIN o USING (desk, date)")
def _(spark, d):
    return _text(_inputs(spark, d).table.select("desk", "date", "level", "curve", "oi", "cat_asset", "cat_lev"))


@query("M21_stochastic_version", f"""WITH {_DESKS}, c AS (SELECT desk, date, CASE WHEN count(*) OVER a >= 26 AND max(level) OVER a > min(level) OVER a THEN 100 * (level - min(level) OVER a) / (max(level) OVER a - min(level) OVER a) END AS s,
        CASE WHEN count(*) OVER b >= 78 AND max(level) OVER b > min(level) OVER b THEN 100 * (level - min(level) OVER b) / (max(level) OVER b - min(level) OVER b) END AS l FROM w WINDOW a AS (PARTITION BY desk ORDER BY date ROWS 51 PRECEDING), b AS (PARTITION BY desk ORDER BY date ROWS 155 PRECEDING))
    SELECT desk, CAST(date AS VARCHAR) AS date, round(CASE WHEN s IS NULL THEN l WHEN l IS NULL THEN s ELSE (s + l) / 2 END, 6) + 0.0 AS value FROM c""")
def _(spark, d):
    return r_all(_text(versions.BUILDERS["v2"](_inputs(spark, d), versions.PARAMETERS)))


@query("H02_all_versions")
def _(spark, d):
    """Every version of every desk, the eleventh being a builder that fails: it leaves the others alone."""
    builders = versions.BUILDERS | {"broken": lambda inp, p: inp.table.select(inp.key, inp.date, F.raise_error(F.lit("no data")).cast("double").alias("value"))}
    rows, _ = versions.build_all(_inputs(spark, d), builders=builders)
    return r_all(_text(rows.withColumnRenamed("value", "z")), 4)


@query("H02_version_leads")
def _(spark, d):
    """First crowded week of each version and its lead over the production version."""
    rows, _ = versions.build_all(_inputs(spark, d))
    out = V.compare_versions(versions.comparable(rows), "desk", "date", "version", "z", "v0", 1.5)
    return r_all(out.withColumn("first_crowded", F.col("first_crowded").cast("string")), 4)


@query("M15_version_frontier")
def _(spark, d):
    inp = _inputs(spark, d)
    rows, _ = versions.build_all(inp)
    return r_all(versions.frontier(rows, inp, inp.table.select("desk", "date", "price"), "price"), 3)
