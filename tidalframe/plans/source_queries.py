"""File sources read back from files of their own shapes, sinks, and further compositions.

Each source query writes a table in the shape that a feed delivers, one file a
series, into the shared folder, and reads it through the adapter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, scalars
from ..functions import windows as W
from ..operators import folds
from ..operators import relational as R
from ..operators.survival import build_panel
from ..registry import query, r, r_all, table
from ..session import shared_folder
from ..sources import files
from ..streaming import feeds
from .analogues import MONTHLY, WEEKLY, monthly, weekly
from .model_queries import LEXICON

#: The priorities of the orders table, which name the series.
SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LONG = f"WITH {WEEKLY} SELECT series_id AS series, CAST(date AS VARCHAR) AS date, round(value / pi(), 6) + 0.0 AS value_pi FROM weekly"
_SCORED = """w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS ws FROM conversations),
    t AS (SELECT conv_id, turn, len(ws) AS n, list_sum(list_transform(ws, lambda x: CASE x WHEN 'the' THEN 1.0::DOUBLE WHEN 'of' THEN -0.5 WHEN 'tion' THEN 2.0 WHEN 'der' THEN -1.0 WHEN 'les' THEN 0.25 ELSE 0.0 END)) AS t FROM w),
    s AS (SELECT conv_id, turn, CASE WHEN n > 0 THEN greatest(-7.5, least(7.5, t / n * 100)) ELSE 0 END AS s FROM t)"""


def _by():
    return W.by("series_id", "date")


def _points(df: DataFrame) -> DataFrame:
    """On an irrational scale: means of cents tie when rounded."""
    return df.select("series", F.col("date").cast("string").alias("date"), r(F.col("value") / F.lit(3.141592653589793)).alias("value_pi"))


def _one_file_a_series(df: DataFrame, body, path: str) -> None:
    """``body`` of a series' points, in order, as the text of one file; a series of weeks is small."""
    points = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("p"))
    points.select("series_id", body(F.col("p")).alias("value")).write.partitionBy("series_id").text(path)


@query("S04_S16_wide_series", _LONG)
def _(spark, d):
    path = shared_folder(spark)
    weekly(spark, d).groupBy(F.col("date").alias("Date")).pivot("series_id", SERIES).agg(F.first("value")).write.option("header", True).csv(path)
    return _points(files.wide_csv(spark, path))


@query("S05_S14_keyed_csv", _LONG)
def _(spark, d):
    path = shared_folder(spark)
    weekly(spark, d).select(F.col("series_id").alias("KEY"), F.col("date").alias("TIME_PERIOD"), F.col("value").alias("OBS_VALUE")).write.option("header", True).csv(path)
    return _points(files.sdmx_csv(spark, path))


@query("S07_preamble_series", _LONG)
def _(spark, d):
    path = shared_folder(spark)
    line = lambda x: F.concat(x["date"].cast("string"), F.lit(","), x["value"].cast("string"))
    body = lambda p: F.concat(F.lit("TERMS\nof use\n\nOBSERVATIONS\ndate,"), F.col("series_id"), F.lit("\n"), F.array_join(F.transform(p, line), "\n"))
    _one_file_a_series(weekly(spark, d), body, path)
    return _points(files.preamble_csv(spark, path, "OBSERVATIONS"))


@query("S08_S11_json_series", _LONG)
def _(spark, d):
    path = shared_folder(spark)
    _one_file_a_series(weekly(spark, d), lambda p: F.to_json(F.struct(F.transform(p, lambda x: F.struct(x["date"].cast("string").alias("data"), x["value"].cast("string").alias("valor"))).alias("value"))), path)
    out = None
    for s in SERIES:
        one = files.json_observations(spark, f"{path}/series_id={s}", "value", "data", "valor", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return _points(out)


@query("S23_positional_json", _LONG)
def _(spark, d):
    path = shared_folder(spark)

    def body(p):
        observations = F.map_from_entries(F.transform(p, lambda x, k: F.struct(k.cast("string"), F.array(x["value"]))))
        data = F.array(F.struct(F.create_map(F.lit("0:0"), F.struct(observations.alias("observations"))).alias("series")))
        ids = F.transform(p, lambda x: F.struct(x["date"].cast("string").alias("id")))
        return F.to_json(F.struct(data.alias("dataSets"), F.struct(F.struct(F.array(F.struct(ids.alias("values"))).alias("observation")).alias("dimensions")).alias("structure")))

    _one_file_a_series(weekly(spark, d), body, path)
    out = None
    for s in SERIES:
        one = files.sdmx_json(spark, f"{path}/series_id={s}", s)
        out = one if out is None else out.unionByName(one)
    return _points(out)


@query("S09_S12_projected_scan", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'F'")
def _(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderstatus") == "F"))
    return o.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("date"), "o_totalprice")


@query("S13_fallback_with_note", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -1.0 END AS price, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS source FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return files.first_of([o.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("price")), o.select("o_orderkey", F.lit(-1.0).alias("price"))], ["o_orderkey"])


@query("S15_missing_source", f"WITH {WEEKLY} SELECT series_id AS series, CAST(count(*) AS BIGINT) AS n FROM weekly GROUP BY 1")
def _(spark, d):
    path = shared_folder(spark)
    weekly(spark, d).groupBy(F.col("date").alias("Date")).pivot("series_id", SERIES).agg(F.first("value")).write.option("header", True).csv(path)
    both = [files.or_empty(lambda p=p: files.wide_csv(spark, p), spark) for p in (path, f"{path}-absent")]
    return both[0].unionByName(both[1]).groupBy("series").agg(F.count("*").alias("n"))


@query("S17_string_csv", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, d):
    path = shared_folder(spark)
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    p.union(p.where("p_size < 10")).write.option("header", True).csv(path)
    typed = spark.read.option("header", True).csv(path).select(F.col("p_partkey").try_cast("long").alias("p_partkey"), F.col("p_size").try_cast("int").alias("p_size"), F.col("p_retailprice").try_cast("double").alias("p_retailprice"))
    return files.keep_one(typed, ["p_partkey"], [F.col("p_size"), F.col("p_retailprice")])


@query("S18_chunked_pulls", "SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderkey")
    cuts = [None, "1994-06-30", "1997-06-30", None]
    out = None
    for a, b in zip(cuts, cuts[1:], strict=False):  # chunks share their border days
        chunk = o.where((F.lit(True) if a is None else F.col("date") >= a) & (F.lit(True) if b is None else F.col("date") <= b))
        out = chunk if out is None else out.union(chunk)
    return files.keep_one(out, ["o_custkey", "date"], [F.desc("o_orderkey")]).withColumn("date", F.col("date").cast("string"))


@query("S19_feed_items", "SELECT 'item ' || event_id AS headline, 'http://x/' || event_id AS url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    name, when = F.concat(F.lit("item "), F.col("event_id").cast("string")), F.col("ts").cast("timestamp")
    link = F.concat(F.lit("http://x/"), F.col("event_id").cast("string"))
    rss = F.concat(F.lit("<rss><item><title><![CDATA["), name, F.lit("]]></title><link>"), link, F.lit("</link><pubDate>"), F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), name, F.lit('</title><link href="'), link, F.lit('"/><updated>'), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry></feed>"))
    docs = e.select(F.when(F.col("event_id") % 2 == 0, rss).otherwise(atom).alias("doc"))
    return files.feed_items(docs, "doc", F.lit("feed")).select("headline", "url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("S26_K01_cache_first", f"WITH {WEEKLY} SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(max(value), 9) + 0.0 AS top FROM weekly GROUP BY 1")
def _(spark, d):
    path = shared_folder(spark)
    files.cached(spark, path, lambda: weekly(spark, d))

    def never() -> DataFrame:
        raise AssertionError("the cache is there")

    return files.cached(spark, path, never).groupBy("series_id").agg(F.count("*").alias("n"), r(F.max("value"), 9).alias("top"))


@query("K02_K03_json_results", f"WITH {WEEKLY} SELECT series_id, round(max(value), 9) + 0.0 AS top, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM weekly GROUP BY 1")
def _(spark, d):
    path = shared_folder(spark)
    nested = weekly(spark, d).groupBy("series_id").agg(F.struct(F.max("value").alias("top"), F.struct(F.count("*").alias("n"), F.sum(F.col("x").isNull().cast("long")).alias("gaps")).alias("counts")).alias("summary"))
    files.write_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("series_id", r("summary.top", 9).alias("top"), F.col("summary.counts.n").alias("n"), F.col("summary.counts.gaps").alias("gaps"))


@query("K07_X04_appended_feed", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(spark, d):
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    base = shared_folder(spark)
    feeds.append_feed(e.select("event_id", "event_type"), f"{base}/out", f"{base}/ck").awaitTermination()
    back = spark.read.schema("event_id long, event_type string").json(f"{base}/out")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("J12_trailing_year_count", """WITH ev AS (SELECT o_custkey AS issuer, CAST(floor(date_diff('day', DATE '1995-01-03', CAST(o_orderdate AS DATE)) / 7.0) AS INTEGER) AS wk, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-03' GROUP BY ALL)
    SELECT a.issuer, a.wk, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS before FROM (SELECT issuer, wk FROM ev QUALIFY wk > min(wk) OVER (PARTITION BY issuer)) AS a LEFT JOIN ev AS b ON a.issuer = b.issuer AND b.wk BETWEEN a.wk - 52 AND a.wk - 1 GROUP BY ALL""")
def _(spark, d):
    day = F.to_date("o_orderdate")
    ev = table(spark, d, "orders").where(day >= "1995-01-03").groupBy(F.col("o_custkey").alias("issuer"), dates.week_index_monday(day, "1995-01-03").alias("wk")).agg(F.count("*").alias("n"))
    return build_panel(ev, "issuer", "wk", "n").where("y = 1").select("issuer", "wk", F.col("issues_trailing_52w").alias("before"))


@query("J15_low_frequency_fill", f"WITH {WEEKLY}, {MONTHLY} SELECT m.series_id, CAST(m.month AS VARCHAR) AS month, round(w.value, 8) + 0.0 AS value FROM monthly AS m ASOF LEFT JOIN weekly AS w ON m.series_id = w.series_id AND m.month >= w.date")
def _(spark, d):
    grid = monthly(spark, d).select("series_id", F.col("month").alias("date"))
    found = R.asof(grid, weekly(spark, d).select("series_id", "date", "value"), "date", ["series_id"], ["value"])
    return found.select("series_id", F.col("date").cast("string").alias("month"), r("value", 8).alias("value"))


@query("A27_backtest", f"""WITH {WEEKLY}, z AS (SELECT series_id, date, value, CASE WHEN n % 3 = 0 THEN 1 WHEN n % 3 = 1 THEN -1 ELSE 0 END AS pos FROM weekly),
    p AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS p, coalesce(value - lag(value) OVER w, 0) AS ch FROM z WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    t AS (SELECT *, abs(p - coalesce(lag(p) OVER w, 0)) AS turn FROM p WINDOW w AS (PARTITION BY series_id ORDER BY date)), l AS (SELECT *, p * ch - turn * 50 AS pnl FROM t),
    c AS (SELECT *, sum(pnl) OVER w AS cum FROM l WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, cum - max(cum) OVER w AS dd FROM c WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))
    SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(sum(pnl), 3) + 0.0 AS total, round(avg(pnl) / stddev_pop(pnl) * sqrt(52), 6) + 0.0 AS sharpe, round(avg(CASE WHEN p <> 0 THEN CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS hit, round(min(dd), 3) + 0.0 AS max_drawdown, CAST(sum(turn) AS BIGINT) AS turnover FROM dd GROUP BY 1""")
def _(spark, d):
    w = weekly(spark, d).withColumn("pos", F.when(F.col("n") % 3 == 0, 1).when(F.col("n") % 3 == 1, -1).otherwise(0))
    m = R.backtest(w.select("series_id", "date", "value", "pos"), "series_id", "date", "pos", "value", 50.0, 52.0)
    return m.select("series_id", "n", r("total", 3).alias("total"), r("sharpe").alias("sharpe"), r("hit").alias("hit"), r("max_drawdown", 3).alias("max_drawdown"), F.col("turnover").cast("long").alias("turnover"))


@query("L01_global_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.global_row_number(o, [F.col("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("L06_seeded_controls", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) <= 50")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    return R.top_by(o, "o_orderpriority", [F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), F.col("o_orderkey")], 50).select("o_orderpriority", "o_orderkey")


@query("F06_polynomial_lags", f"""WITH {WEEKLY}, l AS (SELECT series_id, date, row_number() OVER w AS i, value AS v0, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(value, 3) OVER w AS v3, lag(value, 4) OVER w AS v4, lag(value, 5) OVER w AS v5 FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, CAST(date AS VARCHAR) AS date, round((v0 + v1 + v2 + v3 + v4 + v5) / pi(), 6) + 0.0 AS z0, round((-2.5 * v0 - 1.5 * v1 - 0.5 * v2 + 0.5 * v3 + 1.5 * v4 + 2.5 * v5) / pi(), 6) + 0.0 AS z1, round((6.25 * v0 + 2.25 * v1 + 0.25 * v2 + 0.25 * v3 + 2.25 * v4 + 6.25 * v5) / pi(), 6) + 0.0 AS z2 FROM l WHERE i >= 6""")
def _(spark, d):
    k = R.last_k(weekly(spark, d).select("series_id", "date", "value"), ["series_id"], "date", "value", 6).where("lags is not null")
    z = scalars.polynomial_lags("lags", 6, 2)
    # On an irrational scale: sums of cents tie when rounded.
    return k.select("series_id", F.col("date").cast("string").alias("date"), *[r(c / F.lit(3.141592653589793)).alias(f"z{p}") for p, c in enumerate(z)])


@query("F12_M23_scored_segments", f"WITH {_SCORED} SELECT conv_id, turn, round(s / pi(), 6) + 0.0 AS score, round(greatest(-1, least(1, -s / 2)) / pi(), 6) + 0.0 AS tone FROM s")
def _(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", scalars.word_score("text", LEXICON).alias("s"))
    tone = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("s") / 2))
    return s.select("conv_id", "turn", r(F.col("s") / F.lit(3.141592653589793)).alias("score"), r(tone / F.lit(3.141592653589793)).alias("tone"))


@query("F15_extracted_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '(19|20)[0-9][0-9]', 0) AS year FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", r"(19|20)[0-9][0-9]", 0).alias("year"))


@query("D05_cycle_roll_dates", """WITH t AS (SELECT DISTINCT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date FROM orders), m AS (SELECT DISTINCT date_trunc('month', date)::DATE AS first FROM t WHERE month(date) % 3 = 0)
    SELECT s.series_id, CAST(first AS VARCHAR) AS first, CAST((SELECT min(date) FROM t WHERE t.series_id = s.series_id AND t.date >= m.first) AS VARCHAR) AS roll FROM (SELECT DISTINCT series_id FROM t) AS s, m""")
def _(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).distinct()
    # The cycle's months are a calendar: a few rows, whatever the number of orders.
    months = days.where(F.month("date") % 3 == 0).select(F.trunc("date", "MM").alias("first")).distinct()
    grid = months.select("first", F.explode(F.array(*[F.lit(s) for s in SERIES])).alias("series_id")).join(days.select("series_id").distinct(), "series_id", "left_semi").withColumn("date", F.col("first"))
    found = R.asof(grid, days.withColumn("roll", F.col("date")), "date", ["series_id"], ["roll"], direction="forward")
    return found.select("series_id", F.col("first").cast("string").alias("first"), F.col("roll").cast("string").alias("roll"))


@query("Y01_rolling_apply", f"""WITH {WEEKLY} SELECT series_id, CAST(date AS VARCHAR) AS date, CASE WHEN count(*) OVER w = 13 THEN round((max(value) OVER w - min(value) OVER w) / pi(), 6) + 0.0 END AS spread FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 12 PRECEDING)""")
def _(spark, d):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(spread=pdf["value"].rolling(13).apply(lambda x: (x.max() - x.min()) / 3.141592653589793, raw=True))

    out = folds.grouped(weekly(spark, d).select("series_id", "date", "value"), "series_id", "date", {"spread": "double"}, f)
    return out.select("series_id", F.col("date").cast("string").alias("date"), F.when(~F.isnan("spread"), r("spread")).alias("spread"))


@query("Y03_group_mode", "SELECT l_suppkey, l_quantity AS mode FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.min_by("l_quantity", F.struct(-F.col("n"), "l_quantity")).alias("mode"))


@query("H06_monthly_lag", f"WITH {WEEKLY}, m AS (SELECT series_id, last_day(date) AS month, arg_max(value, date) AS v FROM weekly GROUP BY ALL) SELECT series_id, CAST(month AS VARCHAR) AS month, round(lag(v) OVER (PARTITION BY series_id ORDER BY month), 8) + 0.0 AS previous FROM m")
def _(spark, d):
    m = weekly(spark, d).groupBy("series_id", F.last_day("date").alias("month")).agg(F.max_by("value", "date").alias("v"))
    return m.select("series_id", F.col("month").cast("string").alias("month"), r(F.lag("v").over(Window.partitionBy("series_id").orderBy("month")), 8).alias("previous"))


@query("H12_predictive_distribution", f"""WITH {WEEKLY}, e AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS e FROM weekly)
    SELECT series_id, CAST(count(e) AS BIGINT) AS n, round(avg(CASE WHEN e < -20000 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS p_miss, round(avg(CASE WHEN e > 20000 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS p_beat, round(quantile_cont(e, 0.1) / pi(), 5) + 0.0 AS low, round(quantile_cont(e, 0.5) / pi(), 5) + 0.0 AS mid, round(quantile_cont(e, 0.9) / pi(), 5) + 0.0 AS high FROM e WHERE e IS NOT NULL GROUP BY 1""")
def _(spark, d):
    e = weekly(spark, d).select("series_id", W.change("value", _by()).alias("e")).where("e is not null")
    pi = F.lit(3.141592653589793)
    return e.groupBy("series_id").agg(
        F.count("e").alias("n"), r(F.avg((F.col("e") < -20000).cast("double")), 8).alias("p_miss"), r(F.avg((F.col("e") > 20000).cast("double")), 8).alias("p_beat"),
        *[r(F.percentile("e", F.lit(p)) / pi, 5).alias(n) for p, n in ((0.1, "low"), (0.5, "mid"), (0.9, "high"))],
    )


@query("H13_quadratic_design", f"WITH {WEEKLY}, k AS (SELECT series_id, date, (row_number() OVER (PARTITION BY series_id ORDER BY date) - 1) / (count(*) OVER (PARTITION BY series_id) - 1.0::DOUBLE) AS t FROM weekly) SELECT series_id, CAST(date AS VARCHAR) AS date, round(t, 8) + 0.0 AS t1, round(t * t, 8) + 0.0 AS t2 FROM k")
def _(spark, d):
    t = (F.row_number().over(_by()) - 1) / (F.count("*").over(Window.partitionBy("series_id")) - 1)
    return r_all(weekly(spark, d).select("series_id", F.col("date").cast("string").alias("date"), t.alias("t1"), (t * t).alias("t2")), 8)
