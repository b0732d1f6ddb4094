"""Series and panels from the driver's star tables, each with the SQL that makes the same.

Money is summed in whole cents and quantities as integers, so both engines see
equal doubles whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..registry import table


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, date, value, n, x``: mean order price a priority and week; ``x`` has gaps."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    g = o.groupBy(F.col("o_orderpriority").alias("series_id"), dates.week_ending_friday(F.to_date("o_orderdate")).alias("date")).agg(F.sum(cents).alias("c"), F.count("*").alias("n"))
    return g.select("series_id", "date", (F.col("c") / F.col("n") / 100).alias("value"), "n").withColumn("x", F.when(F.col("n") % 7 != 0, F.col("value")))


WEEKLY = """weekly AS (
    SELECT *, CASE WHEN n % 7 <> 0 THEN value END AS x FROM (
        SELECT o_orderpriority AS series_id,
               CAST(o_orderdate AS DATE) + CAST((12 - isodow(o_orderdate)) % 7 AS INTEGER) AS date,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value, count(*) AS n
        FROM orders GROUP BY ALL))"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, date, value``: mean order price a priority and day."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    g = o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"), F.count("*").alias("n"))
    return g.select("series_id", "date", (F.col("c") / F.col("n") / 100).alias("value"))


DAILY = """daily AS (
    SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value
    FROM orders GROUP BY ALL)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, month, value``: mean order price a priority and month (its last day)."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    g = o.groupBy(F.col("o_orderpriority").alias("series_id"), F.last_day(F.to_date("o_orderdate")).alias("month")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"), F.count("*").alias("n"))
    return g.select("series_id", "month", (F.col("c") / F.col("n") / 100).alias("value"), "n")


MONTHLY = """monthly AS (
    SELECT o_orderpriority AS series_id, last_day(CAST(o_orderdate AS DATE)) AS month,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value, count(*) AS n
    FROM orders GROUP BY ALL)"""


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, date, y, z, spread``: two weekly legs on common dates."""
    w = weekly(spark, sf_dir)
    a = w.where("series_id = '1-URGENT'").select("date", F.col("value").alias("y"))
    b = w.where("series_id = '2-HIGH'").select("date", F.col("value").alias("z"))
    return a.join(b, "date").select(F.lit("pair").alias("series_id"), "date", "y", "z", (F.col("y") - F.col("z")).alias("spread"))


PAIR = f"""{WEEKLY}, pair AS (
    SELECT 'pair' AS series_id, date, a.value AS y, b.value AS z, a.value - b.value AS spread
    FROM (SELECT * FROM weekly WHERE series_id = '1-URGENT') AS a JOIN (SELECT * FROM weekly WHERE series_id = '2-HIGH') AS b USING (date))"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, instrument, category, net, open_interest``: weekly net quantity by ship mode analogue."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_linestatus", "l_returnflag", "l_quantity", "l_linenumber")
    q = F.round(F.col("l_quantity")).cast("long")
    return li.groupBy(dates.week_ending_friday(F.to_date("l_shipdate")).alias("date"), F.col("l_linestatus").alias("instrument"), F.col("l_returnflag").alias("category")).agg(
        F.sum(F.when(F.col("l_linenumber") % 2 == 1, q).otherwise(-q)).cast("double").alias("net"), F.sum(q).cast("double").alias("open_interest")
    )


POSITIONS = """positions AS (
    SELECT CAST(l_shipdate AS DATE) + CAST((12 - isodow(l_shipdate)) % 7 AS INTEGER) AS date, l_linestatus AS instrument, l_returnflag AS category,
           CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN CAST(round(l_quantity) AS BIGINT) ELSE -CAST(round(l_quantity) AS BIGINT) END) AS DOUBLE) AS net,
           CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS open_interest
    FROM lineitem GROUP BY ALL)"""
