"""Sources and streams over the star tables: batch forms with SQL, and the streams run to their end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import windows as W
from ..registry import query, r, r_all, table
from ..session import shared_folder
from ..sources import files, polled, tables
from ..streaming import feeds


@query("S01_nearest_tenor", """WITH w AS (SELECT unnest([2.0, 5.0, 10.0]) AS wanted), c AS (SELECT p_brand, wanted, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand, wanted ORDER BY abs(p_size - wanted), p_size, p_retailprice) AS k FROM (SELECT p_brand, p_size, min(p_retailprice) AS p_retailprice FROM part GROUP BY ALL), w WHERE abs(p_size - wanted) <= 0.5)
    SELECT p_brand, CAST(wanted AS DOUBLE) AS wanted, round(p_retailprice, 4) + 0.0 AS value FROM c WHERE k = 1""")
def _(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("tenor")).agg(F.min("p_retailprice").alias("value"))
    return r_all(files.nearest_tenor(p, ["p_brand"], "tenor", "value", [2.0, 5.0, 10.0]), 4)


@query("S02_dedupe_keep_last", "SELECT o_custkey, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"))
    return files.keep_one(o, ["o_custkey"], [F.desc("date"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("S06_first_success", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'a' END, 'b') AS name, CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END AS source FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return files.first_of([c.where("c_acctbal > 5000").select("c_custkey", F.lit("a").alias("name")), c.select("c_custkey", F.lit("b").alias("name"))], ["c_custkey"])


@query("S10_wide_to_long", "SELECT l_returnflag, category, CAST(sum(net) AS BIGINT) AS net FROM (SELECT l_returnflag, 'a' AS category, l_quantity - l_linenumber AS net FROM lineitem UNION ALL SELECT l_returnflag, 'b', l_linenumber - l_suppkey FROM lineitem) GROUP BY ALL")
def _(spark, d):
    n = files.net_positions(table(spark, d, "lineitem"), ["l_returnflag"], {"a": ("l_quantity", "l_linenumber"), "b": ("l_linenumber", "l_suppkey")})
    return n.groupBy("l_returnflag", "category").agg(F.sum("net").cast("long").alias("net"))


@query("S20_news_dedupe", "SELECT md5(coalesce(url, html)) AS id, CAST(min(page_id) AS BIGINT) AS first FROM pages GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("id", F.md5(F.coalesce("url", "html")))
    return files.keep_one(p, ["id"], [F.col("page_id")]).select("id", F.col("page_id").alias("first"))


@query("S21_html_texts", r"""WITH e AS (SELECT page_id, unnest(x) AS b, generate_subscripts(x, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|a|span|title)\b[^>]*>(.*?)</', 1) AS x FROM pages)),
    t AS (SELECT page_id, k, trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM e), d AS (SELECT page_id, text, min(k) AS k FROM t WHERE length(text) BETWEEN 20 AND 500 GROUP BY ALL)
    SELECT page_id, CAST(count(text) AS INTEGER) AS n, md5(coalesce(string_agg(text, chr(10) ORDER BY k), '')) AS digest FROM pages LEFT JOIN d USING (page_id) GROUP BY page_id""")
def _(spark, d):
    return files.html_texts(table(spark, d, "pages").select("page_id", "html"), "html").select("page_id", F.size("texts").alias("n"), F.md5(F.array_join("texts", "\n")).alias("digest"))


@query("S22_speaker_segments", """WITH p AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS t FROM documents) SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM p WHERE trim(t, ' ') <> '' AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) >= 3 GROUP BY 1""")
def _(spark, d):
    s = files.speaker_segments(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 3)
    return s.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("X02_feed_dedupe", "SELECT event_type, CAST(count(DISTINCT CAST(user_id AS VARCHAR)) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    base = shared_folder(spark)
    feed = e.select("ts", "event_type", F.concat_ws(":", "event_type", "user_id").alias("text"))
    seen = feeds.run_once(feeds.first_seen(feed, "40 days"), f"{base}/out", f"{base}/ck")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"))


@query("X11_tumbling_windows", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY ALL")
def _(spark, d):
    w = feeds.windowed(table(spark, d, "events"), "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r("mean").alias("mean"))


@query("X12_sliding_windows", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)) AS VARCHAR) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) + 0.0 AS mean FROM events, unnest(range(0, 3)) AS r(k) GROUP BY ALL")
def _(spark, d):
    w = feeds.windowed(table(spark, d, "events"), "3 hours", "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r("mean").alias("mean"))


@query("X13_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) + 0.0 AS total, CAST(date_trunc('second', min(ts)) AS VARCHAR) AS start FROM s GROUP BY user_id, k""")
def _(spark, d):
    s = feeds.sessions(table(spark, d, "events"), "6 hours")
    return s.select("user_id", "n", r("total", 4).alias("total"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("X07_tick_state", """SELECT event_type AS source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value AS price, lag(value) OVER w AS previous, round((value - lag(value) OVER w) * 100, 6) + 0.0 AS change
    FROM events WHERE value > 0 WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)""")
def _(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    base = shared_folder(spark)
    t = feeds.ticks(e.select(F.col("event_type").alias("source"), "ts", F.col("value").alias("price")))
    return feeds.run_once(t, f"{base}/out", f"{base}/ck").select("source", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "price", "previous", r("change").alias("change"))


@query("X03_live_barometer", """WITH RECURSIVE x AS (SELECT event_type AS meeting, ts, least(value, 100) AS x FROM events WHERE value IS NOT NULL),
    k AS (SELECT *, row_number() OVER o AS i, 1 / (1 / 180.0::DOUBLE + row_number() OVER o / 120.0::DOUBLE) AS v, (57 / 180.0::DOUBLE + sum(x) OVER o / 120.0::DOUBLE) / (1 / 180.0::DOUBLE + row_number() OVER o / 120.0::DOUBLE) AS m FROM x WINDOW o AS (PARTITION BY meeting ORDER BY ts, x ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT meeting, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d, 0 AS alert FROM (SELECT DISTINCT meeting FROM x)
        UNION ALL SELECT meeting, i, CASE WHEN u > 15 THEN 0 ELSE u END, CASE WHEN u <= 15 AND d > 15 THEN 0 ELSE d END, CASE WHEN u > 15 THEN 1 WHEN d > 15 THEN -1 ELSE 0 END
        FROM (SELECT k.meeting, k.i, greatest(0, u + (x - m) - 3) AS u, greatest(0, d - (x - m) - 3) AS d FROM s JOIN k ON k.meeting = s.meeting AND k.i = s.i + 1))
    SELECT k.meeting, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(x, 6) + 0.0 AS x, round(m * sqrt(2), 6) + 0.0 AS mean_root2, round(sqrt(v), 6) + 0.0 AS sd, alert FROM s JOIN k ON k.meeting = s.meeting AND k.i = s.i""")
def _(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    base = shared_folder(spark)
    b = feeds.live_barometer(e.select(F.col("event_type").alias("meeting"), "ts", F.least("value", F.lit(100.0)).alias("x")))
    b = feeds.run_once(b, f"{base}/out", f"{base}/ck")
    # On an irrational scale: means of cents tie when rounded.
    return r_all(b.withColumn("mean_root2", F.col("mean") * 2**0.5).drop("mean").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 6)


_TEXTS = r"""SELECT DISTINCT page_id, text FROM (SELECT page_id, trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|a|span|title)\b[^>]*>(.*?)</', 1)), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages) WHERE length(text) BETWEEN 20 AND 500"""


@query("Y08_lateral_texts", _TEXTS)
def _(spark, d):
    """Texts of pages by a table function, with LATERAL."""
    tables.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("pages_of_y08")
    return spark.sql("SELECT p.page_id, t.text FROM pages_of_y08 AS p, LATERAL page_texts(p.html) AS t")


@query("Y08_table_texts", f"SELECT page_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({_TEXTS}) GROUP BY 1")
def _(spark, d):
    """The same by an Arrow table function of the whole table."""
    tables.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("pages_of_y08")
    rows = spark.sql("SELECT key AS page_id, text FROM page_texts_of(TABLE(SELECT page_id, html FROM pages_of_y08))")
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("X01_polled_feeds", "WITH e AS (SELECT event_type AS source, row_number() OVER (PARTITION BY event_type ORDER BY event_id) % 3 AS c, event_id FROM events) SELECT source, CASE WHEN c = 1 THEN 'spare' ELSE 'main' END AS endpoint, CAST(c AS INTEGER) AS cycle, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM e GROUP BY ALL")
def _(spark, d):
    """Events as polled feeds of a source each, in three cycles of which the second's first endpoint is dead: read by a stream in two runs."""
    polled.register(spark)
    base = shared_folder(spark)
    w = W.by("event_type", "event_id")
    e = table(spark, d, "events").select("event_type", "event_id", (F.row_number().over(w) % 3).alias("c"))
    item = F.concat(F.lit("<item><title>"), F.col("event_id").cast("string"), F.lit("</title></item>"))
    cycles = e.groupBy("event_type", "c").agg(F.array_join(F.collect_list(item), "").alias("body"))

    def store(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for source, c, body in pdf.itertuples(index=False):
                polled.store(base + "/feeds", source, f"{c:06d}", {"main.xml": "moved" if c == 1 else body, "spare.xml": body})
            yield pdf[["event_type"]]

    out = None
    for part in ("c < 2", "c >= 2"):
        cycles.where(part).mapInPandas(store, "event_type string").count()
        stream = spark.readStream.format("polled_feeds").option("path", base + "/feeds").option("endpoints", "main,spare").load()
        out = feeds.run_once(stream, f"{base}/out", f"{base}/ck")
    return out.groupBy("source", F.regexp_replace("endpoint", "[.]xml$", "").alias("endpoint"), F.col("cycle").cast("int").alias("cycle")).agg(F.count("*").alias("n"), F.sum(F.col("headline").cast("long")).alias("total"))
