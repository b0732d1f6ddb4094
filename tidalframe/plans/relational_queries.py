"""Projections, joins, aggregations, limits and set operations (P*, J*, A*, L*, U*) on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, scalars
from ..functions import windows as W
from ..operators import relational as R
from ..registry import query, r, r_all, table
from .analogues import DAILY, MONTHLY, PAIR, POSITIONS, WEEKLY, daily, monthly, pair, positions, weekly


def _by(*keys: str):
    return W.by(list(keys) or ["series_id"], "date")


def _text_date(df, name="date"):
    return df.withColumn(name, F.col(name).cast("string"))


# --- projections and predicates ----------------------------------------------


@query("P01_validate", "SELECT l_returnflag AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    return R.validate(g, {"k": "string", "n": "long"}, ["k"])


@query("P02_build_market", f"WITH {PAIR} SELECT CAST(date AS VARCHAR) AS date, round(y, 8) + 0.0 AS y, round(z, 8) + 0.0 AS z, round(spread, 6) + 0.0 AS spread FROM pair WHERE (SELECT count(*) FROM pair) >= 56")
def _(spark, d):
    p = pair(spark, d)
    n = p.groupBy("series_id").agg(F.count("*").alias("rows")).where("rows >= 56").select("series_id")
    return _text_date(p.join(F.broadcast(n), "series_id", "left_semi").select("date", r("y", 8).alias("y"), r("z", 8).alias("z"), r("spread").alias("spread")))


@query("P03_transforms", f"""WITH {MONTHLY} SELECT series_id, CAST(month AS VARCHAR) AS date, round(value - lag(value) OVER w, 6) + 0.0 AS diff, round(value / lag(value) OVER w - 1, 8) + 0.0 AS pct,
    round(value / lag(value, 12) OVER w - 1, 8) + 0.0 AS yoy, round(ln(value) - ln(lag(value) OVER w), 8) + 0.0 AS log_diff FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY month)""")
def _(spark, d):
    m, w = monthly(spark, d).withColumnRenamed("month", "date"), _by()
    cols = [r(W.change("value", w)).alias("diff"), r(W.pct_change("value", w), 8).alias("pct"), r(W.pct_change("value", w, 12), 8).alias("yoy"), r(F.log("value") - F.lag(F.log("value")).over(w), 8).alias("log_diff")]
    return _text_date(m.select("series_id", "date", *cols))


@query("P05_log_returns", f"""WITH {DAILY}, p AS (SELECT * FROM daily WHERE value > 200000)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY date)), 8) + 0.0 AS ret FROM p""")
def _(spark, d):
    p = daily(spark, d).where("value > 200000")
    return _text_date(p.select("series_id", "date", r(F.log("value") - F.lag(F.log("value")).over(_by()), 8).alias("ret")))


@query("P06_publication_cutoff", f"WITH {DAILY} SELECT series_id, CAST(count(*) AS BIGINT) AS n, CAST(max(date) AS VARCHAR) AS last FROM daily WHERE date <= DATE '1998-06-12' GROUP BY 1")
def _(spark, d):
    cutoff = dates.add_business_days(F.lit("1998-06-17").cast("date"), -3)
    return daily(spark, d).where(F.col("date") <= cutoff).groupBy("series_id").agg(F.count("*").alias("n"), F.max("date").cast("string").alias("last"))


@query("P07_typed_projection", """SELECT o_orderkey, ln(1 + greatest(o_totalprice, 0)) IS NOT NULL AS has_log, round(ln(1 + greatest(o_totalprice, 0)), 8) + 0.0 AS log_amount,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 END AS rank, coalesce(o_orderstatus IN ('F', 'O'), false) AS final FROM orders""")
def _(spark, d):
    rank = F.create_map(*[F.lit(x) for k in (1, 2, 3) for x in (str(k), k)])[F.substring("o_orderpriority", 1, 1)]
    log = F.log1p(F.greatest(F.col("o_totalprice"), F.lit(0.0)))
    return table(spark, d, "orders").select("o_orderkey", log.isNotNull().alias("has_log"), r(log, 8).alias("log_amount"), rank.alias("rank"), F.coalesce(F.col("o_orderstatus").isin("F", "O"), F.lit(False)).alias("final"))


@query("P09_lenient_numbers", "SELECT event_type, CAST(count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k.try_cast("double")).alias("n"), F.sum(k.try_cast("long")).alias("total"))


@query("P10_slice", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'")
def _(spark, d):
    return table(spark, d, "orders").where(F.to_date("o_orderdate").between("1996-02-01", "1997-01-31")).agg(F.count("*").alias("n"))


@query("P11_temporal_split", "SELECT CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1997-12-31' THEN 'train' WHEN CAST(o_orderdate AS DATE) <= DATE '1999-12-31' THEN 'test' ELSE 'live' END AS part, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, d):
    day = F.to_date("o_orderdate")
    part = F.when(day <= "1997-12-31", "train").when(day <= "1999-12-31", "test").otherwise("live")
    return table(spark, d, "orders").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("P12_keyword_gate", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lower(text) LIKE '%tion%' OR lower(text) LIKE '%ñas%' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").where(scalars.any_word("text", ["tion", "ñas"])).groupBy("source").agg(F.count("*").alias("n"))


@query("P13_exclusion_mask", f"WITH {MONTHLY} SELECT series_id, CAST(count(*) AS BIGINT) AS n FROM monthly WHERE NOT (month BETWEEN DATE '1996-02-01' AND DATE '1996-08-31') GROUP BY 1")
def _(spark, d):
    return monthly(spark, d).where(~F.col("month").between("1996-02-01", "1996-08-31")).groupBy("series_id").agg(F.count("*").alias("n"))


@query("P14_last_complete_month", f"""WITH {MONTHLY}, a AS (SELECT *, avg(n) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM monthly)
    SELECT series_id, CAST(min(month) AS VARCHAR) AS first_thin FROM a WHERE n < 0.8 * m GROUP BY 1""")
def _(spark, d):
    m = F.avg("n").over(W.by("series_id", "month").rowsBetween(-3, -1))
    return monthly(spark, d).withColumn("m", m).where("n < 0.8 * m").groupBy("series_id").agg(F.min("month").cast("string").alias("first_thin"))


@query("P15_to_z", f"WITH {WEEKLY}, s AS (SELECT series_id, stddev_pop(value) AS sd FROM weekly GROUP BY 1) SELECT series_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN abs(sd - 1) > 0.1 THEN value / sd ELSE value END, 6) + 0.0 AS z FROM weekly JOIN s USING (series_id)")
def _(spark, d):
    w = weekly(spark, d)
    s = w.groupBy("series_id").agg(F.stddev_pop("value").alias("sd"))
    return _text_date(w.join(s, "series_id").select("series_id", "date", r(F.when(F.abs(F.col("sd") - 1) > 0.1, F.col("value") / F.col("sd")).otherwise(F.col("value"))).alias("z")))


@query("P16_ladder", "SELECT CASE WHEN c_acctbal >= 7500 THEN 'extreme' WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'normal' ELSE 'negative' END AS label, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(spark, d):
    label = scalars.ladder("c_acctbal", [(7500.0, "extreme"), (5000.0, "high"), (0.0, "normal")], "negative")
    return table(spark, d, "customer").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("P17_surprise_labels", f"WITH {MONTHLY}, s AS (SELECT value - lag(value) OVER (PARTITION BY series_id ORDER BY month) AS e FROM monthly) SELECT CASE WHEN e > 5000 THEN 2 WHEN e < -5000 THEN 0 ELSE 1 END AS label, CAST(count(*) AS BIGINT) AS n FROM s WHERE e IS NOT NULL GROUP BY 1")
def _(spark, d):
    e = monthly(spark, d).withColumn("e", W.change("value", W.by("series_id", "month"))).where("e is not null")
    return e.groupBy(F.when(F.col("e") > 5000, 2).when(F.col("e") < -5000, 0).otherwise(1).alias("label")).agg(F.count("*").alias("n"))


@query("P18_forward_label", f"WITH {WEEKLY} SELECT series_id, CAST(date AS VARCHAR) AS date, CASE WHEN lead(value, 4) OVER w IS NOT NULL THEN CAST(lead(value, 4) OVER w > value AS INTEGER) END AS label FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)")
def _(spark, d):
    ahead = F.lead("value", 4).over(_by())
    return _text_date(weekly(spark, d).select("series_id", "date", F.when(ahead.isNotNull(), (ahead > F.col("value")).cast("int")).alias("label")))


@query("P19_shock_type", f"""WITH {PAIR}, c AS (SELECT sign(y - lag(y) OVER w) AS a, sign(z - lag(z) OVER w) AS b FROM pair WINDOW w AS (ORDER BY date))
    SELECT CASE WHEN a = b THEN 'demand' ELSE 'supply' END AS kind, CAST(count(*) AS BIGINT) AS n FROM c WHERE a <> 0 AND b <> 0 GROUP BY 1""")
def _(spark, d):
    w = _by()
    c = pair(spark, d).select(F.signum(W.change("y", w)).alias("a"), F.signum(W.change("z", w)).alias("b")).where("a != 0 and b != 0")
    return c.groupBy(F.when(F.col("a") == F.col("b"), "demand").otherwise("supply").alias("kind")).agg(F.count("*").alias("n"))


@query("P20_resolve_signal", f"WITH {POSITIONS} SELECT CAST(date AS VARCHAR) AS date, sum(CASE WHEN category IN ('A', 'R') THEN net ELSE 0 END) AS net, round(100 * sum(CASE WHEN category IN ('A', 'R') THEN net ELSE 0 END) / nullif(sum(open_interest), 0), 6) + 0.0 AS pct FROM positions GROUP BY date")
def _(spark, d):
    chosen = F.sum(F.when(F.col("category").isin("A", "R"), F.col("net")).otherwise(0.0))
    return _text_date(positions(spark, d).groupBy("date").agg(chosen.alias("net"), r(F.try_divide(100 * chosen, F.sum("open_interest"))).alias("pct")))


# --- joins and alignment -------------------------------------------------------


@query("J01_align", f"""WITH {WEEKLY}, s AS (SELECT CASE WHEN series_id < '3' THEN 'a' ELSE 'b' END AS entity, series_id, date, value FROM weekly WHERE n % 5 <> 0),
    g AS (SELECT d.date, k.entity, k.series_id, s.value FROM (SELECT DISTINCT date FROM s) AS d CROSS JOIN (SELECT DISTINCT entity, series_id FROM s) AS k LEFT JOIN s ON s.date = d.date AND s.series_id = k.series_id),
    f AS (SELECT date, entity, series_id, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS value FROM g)
    SELECT CAST(date AS VARCHAR) AS date, entity, series_id, round(value, 8) + 0.0 AS value FROM f WHERE date IN (SELECT date FROM f WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity) = 2)""")
def _(spark, d):
    s = weekly(spark, d).where("n % 5 != 0").select(F.when(F.col("series_id") < "3", "a").otherwise("b").alias("entity"), "series_id", "date", "value")
    out = R.align([s.where("entity = 'a'"), s.where("entity = 'b'")], "entity", "date", "value", series="series_id", limit=1)
    return _text_date(out.select("date", "entity", "series_id", r("value", 8).alias("value")))


@query("J02_inner_align", f"WITH {PAIR} SELECT CAST(count(*) AS BIGINT) AS n, round(corr(y, z), 8) + 0.0 AS corr FROM pair")
def _(spark, d):
    return pair(spark, d).agg(F.count("*").alias("n"), r(F.corr("y", "z"), 8).alias("corr"))


@query("J03_asof_backward", "SELECT e.event_id, round(p.value, 8) + 0.0 AS price FROM (SELECT * FROM events WHERE event_type = 'click') AS e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) AS p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(spark, d):
    e = table(spark, d, "events")
    found = R.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value"), "ts", ["user_id"], ["value"])
    return found.select("event_id", r("value", 8).alias("price"))


@query("J05_publication_shift", f"""WITH {DAILY}, s AS (SELECT series_id, date + CASE isodow(date) WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 5 END AS known, value FROM daily),
    u AS (SELECT series_id, CAST(known AS DATE) AS known, arg_max(value, value) AS value FROM s GROUP BY ALL)
    SELECT w.series_id, CAST(w.date AS VARCHAR) AS date, round(u.value, 8) + 0.0 AS value FROM daily AS w ASOF LEFT JOIN u ON w.series_id = u.series_id AND w.date >= u.known""")
def _(spark, d):
    x = daily(spark, d)
    known = x.select("series_id", dates.add_business_days("date", 3).alias("date"), "value")
    return _text_date(R.asof(x.select("series_id", "date"), known, "date", ["series_id"], ["value"]).select("series_id", "date", r("value", 8).alias("value")))


@query("J06_dimension_and_series_join", "SELECT n_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    # nation is a fixed dimension of the star schema: Spark broadcasts it by its size.
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("J07_multiway_left", "SELECT c_custkey, n_name, r_name, coalesce(o.n, 0) AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) AS o ON o_custkey = c_custkey")
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("orders"))


@query("J09_semi", "SELECT CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("J10_last_k", f"""WITH {WEEKLY}, k AS (SELECT *, list(x) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l FROM weekly WHERE x IS NOT NULL)
    SELECT series_id, CAST(date AS VARCHAR) AS date, CASE WHEN len(l) = 4 THEN round(l[4], 8) + 0.0 END AS newest, CASE WHEN len(l) = 4 THEN round(l[1], 8) + 0.0 END AS oldest FROM k""")
def _(spark, d):
    k = R.last_k(weekly(spark, d), ["series_id"], "date", "x", 4)
    return _text_date(k.select("series_id", "date", r(F.col("lags")[0], 8).alias("newest"), r(F.col("lags")[3], 8).alias("oldest")))


def _events(spark, d):
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").where(day >= "1995-01-03")
    return o.groupBy(F.col("o_custkey").alias("issuer"), dates.week_index_monday(day, "1995-01-03").alias("wk")).agg(F.count("*").alias("n"))


@query("R23_issuer_week_grid", """WITH ev AS (SELECT o_custkey AS issuer, CAST(floor(date_diff('day', DATE '1995-01-03', CAST(o_orderdate AS DATE)) / 7.0) AS INTEGER) AS wk, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-03' GROUP BY ALL),
    span AS (SELECT issuer, min(wk) AS a FROM ev GROUP BY 1), top AS (SELECT max(wk) AS b FROM ev), g AS (SELECT issuer, a, CAST(w AS INTEGER) AS wk FROM span, top, unnest(range(a, b + 1)) AS r(w)),
    f AS (SELECT g.issuer, g.wk, g.a, e.n, max(CASE WHEN e.n > 0 THEN g.wk END) OVER (PARTITION BY g.issuer ORDER BY g.wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, sum(e.n) OVER (PARTITION BY g.issuer ORDER BY g.wk ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS trail
        FROM g LEFT JOIN ev AS e ON e.issuer = g.issuer AND e.wk = g.wk)
    SELECT issuer, wk, CASE WHEN n > 0 THEN 1 ELSE 0 END AS y, least(wk - prev, 260) AS weeks_since_last, CAST(coalesce(trail, 0) AS BIGINT) AS issues_trailing_52w FROM f WHERE wk > a""")
def _(spark, d):
    from ..operators.survival import build_panel

    return build_panel(_events(spark, d), "issuer", "wk", "n").select("issuer", "wk", "y", "weeks_since_last", "issues_trailing_52w")


@query("R23_issuer_week_grid_whole", """WITH ev AS (SELECT o_custkey AS issuer, CAST(floor(date_diff('day', DATE '1995-01-03', CAST(o_orderdate AS DATE)) / 7.0) AS INTEGER) AS wk, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-03' GROUP BY ALL),
    span AS (SELECT issuer, min(wk) AS a FROM ev GROUP BY 1), top AS (SELECT max(wk) AS b FROM ev), g AS (SELECT issuer, a, CAST(w AS INTEGER) AS wk FROM span, top, unnest(range(a, b + 1)) AS r(w)),
    f AS (SELECT g.issuer, g.wk, g.a, e.n, max(CASE WHEN e.n > 0 THEN g.wk END) OVER (PARTITION BY g.issuer ORDER BY g.wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, sum(e.n) OVER (PARTITION BY g.issuer ORDER BY g.wk ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS trail
        FROM g LEFT JOIN ev AS e ON e.issuer = g.issuer AND e.wk = g.wk)
    SELECT issuer, wk, CASE WHEN n > 0 THEN 1 ELSE 0 END AS y, least(wk - prev, 260) AS weeks_since_last, CAST(coalesce(trail, 0) AS BIGINT) AS issues_trailing_52w FROM f WHERE wk > a""")
def _(spark, d):
    from ..operators.survival import build_panel

    return build_panel(_events(spark, d), "issuer", "wk", "n").select("issuer", "wk", "y", "weeks_since_last", "issues_trailing_52w")


@query("J13_asof_forward", "SELECT e.event_id, round(p.value, 8) + 0.0 AS price FROM (SELECT * FROM events WHERE event_type = 'click') AS e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) AS p ON e.user_id = p.user_id AND e.ts <= p.ts")
def _(spark, d):
    e = table(spark, d, "events")
    found = R.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value"), "ts", ["user_id"], ["value"], direction="forward")
    return found.select("event_id", r("value", 8).alias("price"))


@query("J11_asof_strict", "SELECT e.event_id, p.prev AS previous_id FROM events AS e LEFT JOIN (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) AS p USING (event_id)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return R.asof(e, e.withColumnRenamed("event_id", "previous_id"), "ts", ["user_id"], ["previous_id"], strict=True).select("event_id", "previous_id")


@query("J14_reindex", f"WITH {WEEKLY} SELECT CAST(a.date AS VARCHAR) AS date, round(b.x, 8) + 0.0 AS other FROM weekly AS a LEFT JOIN weekly AS b ON a.date = b.date AND b.series_id = '2-HIGH' WHERE a.series_id = '1-URGENT'")
def _(spark, d):
    w = weekly(spark, d)
    b = w.where("series_id = '2-HIGH'").select("date", F.col("x").alias("other"))
    return _text_date(w.where("series_id = '1-URGENT'").select("date").join(b, "date", "left").select("date", r("other", 8).alias("other")))


@query("J16_event_day_flag", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, isodow(o_orderdate) = 5 AND day(o_orderdate) <= 7 AS nfp, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    months = o.select(F.trunc("date", "MM").alias("m")).distinct().select(dates.first_friday("m").alias("date"), F.lit(True).alias("is"))
    return _text_date(o.join(months, "date", "left").groupBy("date", F.coalesce("is", F.lit(False)).alias("nfp")).agg(F.count("*").alias("n")))


@query("J18_year_distance", f"""WITH {MONTHLY}, v AS (SELECT year(month) AS y, month(month) AS m, avg(value) AS v FROM monthly GROUP BY ALL)
    SELECT CAST(a.y AS INTEGER) AS a, CAST(b.y AS INTEGER) AS b, round(sqrt(sum((a.v - b.v) ** 2)), 4) + 0.0 AS distance FROM v AS a JOIN v AS b ON a.m = b.m AND a.y < b.y GROUP BY ALL""")
def _(spark, d):
    v = monthly(spark, d).groupBy(F.year("month").alias("y"), F.month("month").alias("m")).agg(F.avg("value").alias("v"))
    a, b = v.select("m", F.col("y").alias("a"), F.col("v").alias("va")), v.select("m", F.col("y").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "m").where("a < b").groupBy("a", "b").agg(r(F.sqrt(F.sum(F.pow(F.col("va") - F.col("vb"), F.lit(2)))), 4).alias("distance"))


@query("J19_parameter_cross", f"WITH {PAIR} SELECT CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM pair, (SELECT unnest([1, 2, 5]) AS k) WHERE abs(spread) > k * 20000 GROUP BY 1")
def _(spark, d):
    # The parameters are a list in the plan, exploded in place: no join.
    return pair(spark, d).select("spread", F.explode(F.array(*[F.lit(k) for k in (1, 2, 5)])).alias("k")).where("abs(spread) > k * 20000").groupBy("k").agg(F.count("*").alias("n"))


# --- aggregations ---------------------------------------------------------------


@query("A01_category_pivot", f"WITH {POSITIONS} SELECT CAST(date AS VARCHAR) AS date, sum(CASE WHEN category = 'A' THEN net END) AS A, sum(CASE WHEN category = 'N' THEN net END) AS N, sum(CASE WHEN category = 'R' THEN net END) AS R FROM positions GROUP BY date")
def _(spark, d):
    return _text_date(positions(spark, d).groupBy("date").pivot("category", ["A", "N", "R"]).agg(F.sum("net")))


@query("A03_weighted_tilt", f"WITH {POSITIONS} SELECT CAST(date AS VARCHAR) AS date, round(sum(net * open_interest) / nullif(sum(open_interest), 0), 6) + 0.0 AS tilt FROM positions GROUP BY date")
def _(spark, d):
    return _text_date(positions(spark, d).groupBy("date").agg(r(F.try_divide(F.sum(F.col("net") * F.col("open_interest")), F.sum("open_interest"))).alias("tilt")))


@query("A04_value_times_tenor", "SELECT l_linestatus AS k, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("k")).agg(F.sum(F.col("l_quantity").cast("long") * F.col("l_linenumber")).alias("v"))


@query("A06_board_levels", f"WITH {POSITIONS} SELECT instrument, category, CAST(grouping(instrument) * 2 + grouping(category) AS INTEGER) AS lvl, sum(net) AS net FROM positions GROUP BY GROUPING SETS ((instrument, category), (instrument), ())")
def _(spark, d):
    positions(spark, d).createOrReplaceTempView("tf_positions")
    return spark.sql("SELECT instrument, category, CAST(grouping(instrument) * 2 + grouping(category) AS INT) AS lvl, sum(net) AS net FROM tf_positions GROUP BY GROUPING SETS ((instrument, category), (instrument), ())")


@query("A07_resample", f"WITH {DAILY}, m AS (SELECT series_id, last_day(date) AS month, arg_max(value, date) AS last, CASE WHEN count(value) >= 5 THEN sum(value) END AS total, avg(value) AS mean FROM daily GROUP BY ALL) SELECT series_id, CAST(month AS VARCHAR) AS date, round(last, 8) + 0.0 AS last, round(total / pi(), 4) + 0.0 AS total, round(mean / pi(), 5) + 0.0 AS mean FROM m")
def _(spark, d):
    g = daily(spark, d).groupBy("series_id", F.last_day("date").alias("date")).agg(F.max_by("value", "date").alias("last"), F.when(F.count("value") >= 5, F.sum("value") / F.pi()).alias("total"), (F.avg("value") / F.pi()).alias("mean"))
    return _text_date(r_all(g, last=8, total=4, mean=5))


@query("A08_issuer_static", """WITH m AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2)
    SELECT o_custkey, m.o_orderpriority AS kind, round(quantile_cont(o_totalprice, 0.5), 6) + 0.0 AS median, CAST(count(*) AS BIGINT) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first FROM orders JOIN m USING (o_custkey) WHERE m.k = 1 GROUP BY 1, 2""")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.mode("o_orderpriority", True).alias("kind"), r(F.percentile("o_totalprice", F.lit(0.5))).alias("median"), F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).cast("string").alias("first"))


@query("A09_rates_by_level", "SELECT l_shipmode_ AS issuer, g, CAST(grouping(l_shipmode_) * 2 + grouping(g) AS INTEGER) AS lvl, CAST(count(*) AS BIGINT) AS n, round(avg(y), 8) + 0.0 AS rate FROM (SELECT l_suppkey % 20 AS l_shipmode_, l_suppkey % 5 AS g, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) GROUP BY GROUPING SETS ((l_shipmode_, g), (g), ())")
def _(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("issuer"), (F.col("l_suppkey") % 5).alias("g"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    li.createOrReplaceTempView("tf_rates")
    return spark.sql("SELECT issuer, g, CAST(grouping(issuer) * 2 + grouping(g) AS INT) AS lvl, count(*) AS n, round(avg(y), 8) + 0.0D AS rate FROM tf_rates GROUP BY GROUPING SETS ((issuer, g), (g), ())")


_REGIME = "CASE WHEN z > 1 THEN 'long' WHEN z < -1 THEN 'short' ELSE 'neutral' END"


@query("A10_conditional_outcomes", f"""WITH {WEEKLY}, z AS (SELECT *, CASE WHEN count(value) OVER f >= 13 THEN (value - avg(value) OVER f) / stddev_pop(value) OVER f END AS z FROM weekly WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    o AS (SELECT z, {', '.join(f'lead(value, {h}) OVER w - value AS c{h}' for h in (4, 8, 13))} FROM z WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    u AS ({' UNION ALL '.join(f'SELECT {h} AS h, z, c{h} AS c FROM o' for h in (4, 8, 13))})
    SELECT h, {_REGIME} AS regime, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS p_up, round(avg(c), 4) + 0.0 AS mean FROM u WHERE z IS NOT NULL AND c IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    w = _by()
    z = weekly(spark, d).withColumn("z", W.rolling_z("value", w, 26, 13))
    hs = (4, 8, 13)
    z = z.select("z", *[(F.lead("value", h).over(w) - F.col("value")).alias(f"c{h}") for h in hs])
    u = z.select("z", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"c{h}").alias("c")) for h in hs])).alias("p")).select("z", "p.*").where("z is not null and c is not null")
    regime = F.when(F.col("z") > 1, "long").when(F.col("z") < -1, "short").otherwise("neutral")
    return u.groupBy("h", regime.alias("regime")).agg(F.count("*").alias("n"), r(F.avg((F.col("c") > 0).cast("double")), 8).alias("p_up"), r(F.avg("c"), 4).alias("mean"))


@query("A12_latest_read", f"WITH {WEEKLY} SELECT series_id, round(arg_max(x, date), 8) + 0.0 AS x, CAST(max(date) AS VARCHAR) AS date FROM weekly WHERE x IS NOT NULL GROUP BY 1")
def _(spark, d):
    return _text_date(R.latest(weekly(spark, d), ["series_id"], "date", "x").select("series_id", r("x", 8).alias("x"), "date"))


@query("A13_calibration_bins", "SELECT least(CAST(floor(l_discount * 100) AS INTEGER), 9) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS realised FROM lineitem GROUP BY 1")
def _(spark, d):
    b = F.least(F.floor(F.col("l_discount") * 100).cast("int"), F.lit(9))
    return table(spark, d, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r(F.avg((F.col("l_returnflag") == "R").cast("double")), 8).alias("realised"))


@query("A14_decile_calibration", "WITH t AS (SELECT o_totalprice AS p, o_orderstatus = 'F' AS y, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS decile FROM orders) SELECT CAST(decile AS INTEGER) AS decile, round(avg(p), 3) + 0.0 AS predicted, round(avg(CAST(y AS DOUBLE)), 8) + 0.0 AS realised, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return r_all(R.decile_calibration(o, "p", "y", "o_orderkey"), predicted=3, realised=8)


@query("A15_binned_hazards", "SELECT CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 4) + 0.0 AS mean FROM part GROUP BY 1")
def _(spark, d):
    b = F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 25, 1).when(F.col("p_size") <= 40, 2).otherwise(3)
    return table(spark, d, "part").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), r(F.avg("p_retailprice"), 4).alias("mean"))


_Z26 = "CASE WHEN count(value) OVER f >= 13 THEN (value - avg(value) OVER f) / stddev_pop(value) OVER f END"
_ZED = f"z AS (SELECT *, {_Z26} AS z FROM weekly WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))"


def _zed(spark, d):
    return weekly(spark, d).withColumn("z", W.rolling_z("value", _by(), 26, 13))


@query("A16_responsiveness", f"WITH {WEEKLY}, {_ZED} SELECT series_id, CAST(min(CASE WHEN z > 1.5 THEN date END) AS VARCHAR) AS first_flag, round(avg(CASE WHEN z IS NOT NULL THEN CAST(abs(z) > 1.5 AS INTEGER) END), 8) + 0.0 AS share_extreme FROM z GROUP BY 1")
def _(spark, d):
    z = F.col("z")
    return _zed(spark, d).groupBy("series_id").agg(F.min(F.when(z > 1.5, F.col("date"))).cast("string").alias("first_flag"), r(F.avg((F.abs(z) > 1.5).cast("double")), 8).alias("share_extreme"))


@query("A17_extreme_episodes", f"""WITH {WEEKLY}, {_ZED}, s AS (SELECT *, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 END AS side FROM z),
    b AS (SELECT *, CASE WHEN lag(side) OVER w IS NOT DISTINCT FROM side AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY date) AS run FROM b)
    SELECT series_id, side, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS "end", CAST(count(*) AS BIGINT) AS weeks, round(arg_max(z, abs(z)), 6) + 0.0 AS peak FROM g WHERE side IS NOT NULL GROUP BY series_id, run, side""")
def _(spark, d):
    e = R.episodes(_zed(spark, d), "series_id", "date", "z", 1.0)
    return e.select("series_id", "side", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "weeks", r("peak").alias("peak"))


@query("A20_summary_quantiles", f"WITH {WEEKLY} SELECT series_id, {', '.join(f'round(quantile_cont(value, {q}), 4) + 0.0 AS q{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))}, round(avg(value), 4) + 0.0 AS mean FROM weekly GROUP BY 1")
def _(spark, d):
    qs = (0.1, 0.25, 0.5, 0.75, 0.9)
    return weekly(spark, d).groupBy("series_id").agg(*[r(F.percentile("value", F.lit(q)), 4).alias(f"q{int(q * 100)}") for q in qs], r(F.avg("value"), 4).alias("mean"))


@query("A21_seasonal_panel", f"WITH {MONTHLY} SELECT series_id, CAST(year(month) AS INTEGER) AS year, {', '.join(f'round(avg(CASE WHEN month(month) = {m} THEN value END), 8) + 0.0 AS m{m}' for m in range(1, 13))} FROM monthly GROUP BY 1, 2")
def _(spark, d):
    p = monthly(spark, d).withColumn("m", F.month("month")).groupBy("series_id", F.year("month").alias("year")).pivot("m", list(range(1, 13))).agg(F.avg("value"))
    return p.select("series_id", "year", *[r(F.col(str(m)), 8).alias(f"m{m}") for m in range(1, 13)])


@query("A22_seasonality_strength", f"""WITH {MONTHLY}, g AS (SELECT series_id, CAST(month(month) AS INTEGER) AS m, avg(value) AS v FROM monthly GROUP BY ALL)
    SELECT series_id, round(stddev_samp(v), 4) + 0.0 AS strength, arg_max(m, v) AS best, arg_min(m, v) AS worst, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1""")
def _(spark, d):
    g = monthly(spark, d).groupBy("series_id", F.month("month").alias("m")).agg(F.avg("value").alias("v"))
    return g.groupBy("series_id").agg(r(F.stddev_samp("v"), 4).alias("strength"), F.max_by("m", "v").alias("best"), F.min_by("m", "v").alias("worst"), F.count("*").alias("n"))


@query("A23_monthly_shares", f"""WITH {MONTHLY}, y AS (SELECT CAST(year(month) AS INTEGER) AS y, CAST(month(month) AS INTEGER) AS m, sum(n) AS n FROM monthly GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY y) AS share FROM y)
    SELECT m, round(quantile_cont(share, 0.5), 8) + 0.0 AS median_share FROM s GROUP BY 1""")
def _(spark, d):
    from pyspark.sql import Window

    y = monthly(spark, d).groupBy(F.year("month").alias("y"), F.month("month").alias("m")).agg(F.sum("n").alias("n"))
    s = y.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))
    return s.groupBy("m").agg(r(F.percentile("share", F.lit(0.5)), 8).alias("median_share"))


@query("A24_difference_in_differences", f"""WITH {MONTHLY}, s AS (SELECT series_id, year(month) AS y, sum(CASE WHEN month(month) IN (6, 7) THEN n ELSE 0 END) / sum(n) AS share FROM monthly WHERE year(month) <= 2000 GROUP BY ALL),
    b AS (SELECT series_id, avg(CASE WHEN y = 2000 THEN share END) - quantile_cont(CASE WHEN y < 2000 THEN share END, 0.5) AS dev FROM s GROUP BY 1)
    SELECT round(avg(CASE WHEN series_id < '3' THEN dev END) - avg(CASE WHEN series_id >= '3' THEN dev END), 8) + 0.0 AS did FROM b""")
def _(spark, d):
    y = F.year("month")
    s = monthly(spark, d).where(y <= 2000).groupBy("series_id", y.alias("y")).agg((F.sum(F.when(F.month("month").isin(6, 7), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    b = s.groupBy("series_id").agg((F.avg(F.when(F.col("y") == 2000, F.col("share"))) - F.percentile(F.when(F.col("y") < 2000, F.col("share")), F.lit(0.5))).alias("dev"))
    return b.agg(r(F.avg(F.when(F.col("series_id") < "3", F.col("dev"))) - F.avg(F.when(F.col("series_id") >= "3", F.col("dev"))), 8).alias("did"))


@query("A26_trailing_windows", """WITH t AS (SELECT max(ts) AS now FROM events), w AS (SELECT unnest([1, 7, 30]) AS days)
    SELECT CAST(days AS INTEGER) AS days, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value > 60) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE value < 40) AS BIGINT) AS low FROM events, t, w WHERE ts > now - to_days(CAST(days AS INTEGER)) GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events")
    # One number: the table's last time.
    now = e.agg(F.max("ts").alias("now"))
    j = e.join(F.broadcast(now)).select("ts", "value", "now", F.explode(F.array(*[F.lit(k) for k in (1, 7, 30)])).alias("days"))
    j = j.where(F.col("ts") > F.col("now") - F.make_dt_interval("days"))
    return j.groupBy("days").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 60, 1)).alias("high"), F.count(F.when(F.col("value") < 40, 1)).alias("low"))


@query("A29_distinct", "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS pairs FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type").distinct()
    return e.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("pairs"))


@query("A30_bias_corrected_moments", f"WITH {WEEKLY} SELECT series_id, round(skewness(value), 6) + 0.0 AS skew, round(kurtosis(value), 6) + 0.0 AS kurt FROM weekly GROUP BY 1")
def _(spark, d):
    n = F.count("value")
    skew = F.skewness("value") * F.sqrt(n * (n - 1.0)) / (n - 2)
    kurt = (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1.0) * F.kurtosis("value") + 6)
    return weekly(spark, d).groupBy("series_id").agg(r(skew).alias("skew"), r(kurt).alias("kurt"))


# --- sorts, limits, sets -----------------------------------------------------------


@query("L02_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("L03_latest_per_key", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 40")
def _(spark, d):
    return R.top_by(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 40).select("event_type", "event_id")


@query("L05_best_with_gate", f"WITH {WEEKLY}, s AS (SELECT series_id, stddev_pop(value) AS sd, count(*) AS n FROM weekly GROUP BY 1) SELECT coalesce(arg_min(series_id, sd) FILTER (WHERE n > 1000000), arg_min(series_id, sd)) AS best FROM s")
def _(spark, d):
    s = weekly(spark, d).groupBy("series_id").agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    gated = F.min_by(F.when(F.col("n") > 1000000, F.col("series_id")), F.when(F.col("n") > 1000000, F.col("sd")))
    return s.agg(F.coalesce(gated, F.min_by("series_id", "sd")).alias("best"))


@query("U01_union_all", "SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


@query("U02_union_distinct", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(o_orderdate AS DATE) FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def _(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate")).union(table(spark, d, "lineitem").select(F.to_date("l_shipdate"))).distinct().agg(F.count("*").alias("n"))


@query("U03_intersect", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(o_orderdate AS DATE) FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def _(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate")).intersect(table(spark, d, "lineitem").select(F.to_date("l_shipdate"))).agg(F.count("*").alias("n"))


@query("U04_except", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
