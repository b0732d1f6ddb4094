"""Inventory rows that had an operator but no query of their own: sheets, indicators, named functions, staged models, injected feeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import folds, indicators, ml, registries, staged, vectors
from ..operators import relational as R
from ..registry import query, r, r_all, table
from ..session import shared_folder
from ..sources import files
from ..streaming import feeds
from .analogues import DAILY, PAIR, POSITIONS, WEEKLY, daily, pair, positions, weekly
from .likelihood_queries import XS, panel
from .model_queries import LEXICON, _vectors


def _text(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols or ("date",)})


def _w():
    return W.by("series_id", "date")


# --- sources -----------------------------------------------------------------------------------


@query("S03_spot_sheet", """WITH c AS (SELECT p_brand AS sheet, CAST(p_size AS VARCHAR) AS years, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_partkey AS VARCHAR) END AS cell FROM part WHERE regexp_matches(p_brand, '^Brand#[12]')),
    v AS (SELECT sheet, TRY_CAST(years AS DOUBLE) AS tenor, min(TRY_CAST(cell AS DOUBLE)) AS value FROM c GROUP BY ALL), w AS (SELECT unnest([2.25, 5.0, 10.0, 49.6]) AS wanted),
    j AS (SELECT sheet, wanted, value, row_number() OVER (PARTITION BY sheet, wanted ORDER BY abs(tenor - wanted), tenor) AS k FROM v, w WHERE abs(tenor - wanted) <= 0.5 AND value IS NOT NULL) SELECT sheet, CAST(wanted AS DOUBLE) AS wanted, value FROM j WHERE k = 1""")
def _(spark, d):
    """Sheets picked by name, cells of text read as numbers where they are such, the nearest maturity within half a year."""
    cell = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_partkey").cast("string"))
    c = table(spark, d, "part").where(F.col("p_brand").rlike("^Brand#[12]")).select(F.col("p_brand").alias("sheet"), F.col("p_size").cast("string").try_cast("double").alias("tenor"), cell.try_cast("double").alias("value"))
    return files.nearest_tenor(c.groupBy("sheet", "tenor").agg(F.min("value").alias("value")), ["sheet"], "tenor", "value", [2.25, 5.0, 10.0, 49.6])


@query("S25_all_indicators", f"""WITH {WEEKLY}, {DAILY}, {POSITIONS}, i AS (
        SELECT 'retail' AS indicator, instrument AS k, date, sum(net) AS v, 156 AS n FROM positions GROUP BY ALL UNION ALL SELECT 'financing', series_id, date, CAST(n AS DOUBLE), 156 FROM weekly
        UNION ALL SELECT 'demand', series_id, date, CASE WHEN lag(value, 20) OVER w <> 0 THEN value / lag(value, 20) OVER w - 1 END, 252 FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    f AS (SELECT * FROM i WHERE v IS NOT NULL),
    z AS (SELECT indicator, k, date, v, CASE WHEN n = 156 THEN CASE WHEN count(v) OVER a >= 78 AND stddev_pop(v) OVER a > 0 THEN (v - avg(v) OVER a) / stddev_pop(v) OVER a END ELSE CASE WHEN count(v) OVER b >= 126 AND stddev_pop(v) OVER b > 0 THEN (v - avg(v) OVER b) / stddev_pop(v) OVER b END END AS z FROM f
        WINDOW a AS (PARTITION BY indicator, k ORDER BY date ROWS 155 PRECEDING), b AS (PARTITION BY indicator, k ORDER BY date ROWS 251 PRECEDING)),
    l AS (SELECT *, row_number() OVER (PARTITION BY indicator, k ORDER BY date DESC) AS r FROM z WHERE z IS NOT NULL),
    g AS (SELECT n.indicator, k.k FROM (SELECT unnest(['retail', 'financing', 'demand', 'missing']) AS indicator) AS n, (SELECT DISTINCT k FROM i) AS k)
    SELECT g.indicator, g.k AS key, CAST(date AS VARCHAR) AS date, round(v / pi(), 6) + 0.0 AS value, round(z, 6) + 0.0 AS z, CASE WHEN z IS NULL THEN 'n/a' WHEN g.indicator = 'financing' THEN CASE WHEN z > 1 THEN 'elevated leverage' WHEN z < -1 THEN 'light leverage' ELSE 'normal' END WHEN z > 1 THEN 'bear' WHEN z < -1 THEN 'bull' ELSE 'neutral' END AS read, z IS NOT NULL AS available
    FROM g LEFT JOIN l ON l.indicator = g.indicator AND l.k = g.k AND r = 1""")
def _(spark, d):
    """Small holders' net positions, financing, price momentum, and a source that is not there."""
    retail = positions(spark, d).groupBy(F.col("instrument").alias("key"), "date").agg(F.sum("net").alias("v"))
    weeks, days = weekly(spark, d).withColumnRenamed("series_id", "key"), daily(spark, d).withColumnRenamed("series_id", "key")
    parts = [
        indicators.latest_reading(retail, "retail", "key", "date", "v", 156),
        indicators.latest_reading(weeks, "financing", "key", "date", F.col("n").cast("double"), 156, indicators.leverage_reading),
        indicators.latest_reading(days, "demand", "key", "date", W.pct_change("value", W.by("key", "date"), 20), 252), None,
    ]
    keys = retail.select("key").unionByName(weeks.select("key"))
    out = indicators.all_indicators(parts, ["retail", "financing", "demand", "missing"], keys, "key")
    return _text(r_all(out.withColumn("value", F.col("value") / F.pi())))


@query("H05_vendor_panel", """WITH l AS (SELECT l_suppkey AS k, l_returnflag AS c, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS q FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL),
    s AS (SELECT l_suppkey AS k, l_returnflag AS c, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS q FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL), o AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS q FROM lineitem GROUP BY ALL)
    SELECT l.k AS supplier, l.c AS category, CAST(l.date AS VARCHAR) AS date, l.q - s.q AS net, o.q AS open_interest FROM l JOIN s USING (k, c, date) JOIN o USING (k, date)""")
def _(spark, d):
    """Long, short and open interest as three tables of (key, date, value): inner joins, net is long less short."""
    li, q = table(spark, d, "lineitem"), F.sum(F.round("l_quantity").cast("long")).cast("double")
    k = [F.col("l_suppkey").alias("supplier"), F.to_date("l_shipdate").alias("date")]
    part = lambda odd, name: li.where(F.col("l_linenumber") % 2 == odd).groupBy(*k, F.col("l_returnflag").alias("category")).agg(q.alias(name))
    both = part(1, "l").join(part(0, "s"), ["supplier", "date", "category"]).join(li.groupBy(*k).agg(F.count("*").cast("double").alias("open_interest")), ["supplier", "date"])
    return _text(both.select("supplier", "category", "date", (F.col("l") - F.col("s")).alias("net"), "open_interest"))


# --- features and inputs ----------------------------------------------------------------------


@query("H04_review_inputs", f"""WITH {POSITIONS}, t AS (SELECT date, sum(net) FILTER (category IN ('A', 'R')) AS level, sum(open_interest) AS oi FROM positions GROUP BY 1)
    SELECT CAST(date AS VARCHAR) AS date, level, oi, round(level / (oi / 1e6), 4) + 0.0 AS share, level - lag(level) OVER (ORDER BY date) AS flow FROM t""")
def _(spark, d):
    """The review's duration signal, open interest, their ratio and the signal's change."""
    p = positions(spark, d).groupBy("date").agg(F.sum(F.when(F.col("category").isin("A", "R"), F.col("net"))).alias("level"), F.sum("open_interest").alias("oi")).withColumn("k", F.lit("all"))
    return _text(p.select("date", "level", "oi", r(F.try_divide("level", F.col("oi") / 1e6), 4).alias("share"), W.change("level", W.by("k", "date")).alias("flow")))


@query("H07_lags_of_many", f"""WITH {WEEKLY}, l AS (SELECT series_id, date, list(x) OVER (PARTITION BY series_id ORDER BY date ROWS 2 PRECEDING) AS l FROM weekly WHERE x IS NOT NULL)
    SELECT CAST(date AS VARCHAR) AS date, {", ".join(f"round(max(CASE WHEN series_id = '{s}' AND len(l) = 3 THEN l[{3 - k}] END) / pi(), 6) + 0.0 AS {n}_{k}" for s, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low")) for k in range(3))} FROM l WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY date""")
def _(spark, d):
    """Three regressors' last three values, side by side by date: one pass over all regressors, then a pivot."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    lags = R.last_k(weekly(spark, d).where(F.col("series_id").isin(*names)), ["series_id"], "date", "x", 3)
    wide = lags.groupBy("date").agg(*[r(F.max(F.when(F.col("series_id") == s, F.col("lags")[k])) / F.pi()).alias(f"{n}_{k}") for s, n in names.items() for k in range(3)])
    return _text(wide)


@query("H18_variance_presets", f"""WITH {WEEKLY}, v AS (SELECT series_id, var_pop(value / 1e5) AS v FROM weekly GROUP BY 1) SELECT series_id, preset, round(v * o, 8) + 0.0 AS obs, round(v * l, 8) + 0.0 AS level, round(v * s, 8) + 0.0 AS slope FROM v, (VALUES ('responsive', 0.30, 0.02, 0.05), ('smooth', 0.30, 0.02, 0.0005)) AS p(preset, o, l, s)""")
def _(spark, d):
    return r_all(folds.preset_variances(weekly(spark, d).withColumn("v", F.col("value") / 1e5), "series_id", "v"), 8)


@query("H15_word_attribution", f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')) AS term FROM documents), v(term, weight) AS (VALUES {", ".join(f"('{t}', {x})" for t, x in LEXICON.items())}),
    t AS (SELECT term, count(*) * weight AS total FROM w JOIN v USING (term) GROUP BY term, weight), k AS (SELECT *, row_number() OVER (PARTITION BY total > 0 ORDER BY abs(total) DESC, term) AS place FROM t) SELECT term, total > 0 AS up, CAST(place AS INTEGER) AS place, CAST(total AS DOUBLE) AS total FROM k WHERE place <= 8""")
def _(spark, d):
    """What each scored word adds over the corpus, the eight largest of each sign; the lexicon is a table that is joined."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))).alias("term"))
    lexicon = spark.createDataFrame(list(LEXICON.items()), "term string, weight double")
    total = words.groupBy("term").agg(F.count("*").alias("n")).join(lexicon, "term").select("term", (F.col("n") * F.col("weight")).alias("total")).withColumn("up", F.col("total") > 0)
    return R.top_by(total, "up", [F.desc(F.abs("total")), F.col("term")], 8).select("term", "up", "place", "total")


# --- models -----------------------------------------------------------------------------------


@query("M18_staged_evaluation")
def _(spark, d):
    """The next week of each priority from four regressors: cross-validation, test, refit."""
    w = _w()
    x = weekly(spark, d).select("series_id", "date", (F.col("value") / 1e5).alias("y"), (F.lag("value").over(w) / 1e5).alias("last"), (F.lag("value", 2).over(w) / 1e5).alias("before"), F.lag("n").over(w).cast("double").alias("n"), (F.avg("value").over(w.rowsBetween(-26, -1)) / 1e5).alias("mean"))
    out = staged.staged_evaluation(x, "series_id", "date", "y", ["last", "before", "n", "mean"])
    return r_all(out.select("series_id", "stage", "n", "rmse", "mae", "naive_rmse", "direction", "ratio", "passed", F.element_at("coef", 1).alias("constant"), F.element_at("coef", -1).alias("on_mean")), 5)


@query("M03_independent_component")
def _(spark, d):
    """Of each status' priorities the independent component nearest their mean, by week."""
    wide = panel(spark, d).dropna(subset=XS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("date")
        x = p[XS].to_numpy(float)
        if len(x) < 30:
            return pd.DataFrame(columns=["status", "date", "value"])
        z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        s = (z - z.mean(0)) @ ml.fast_ica(np.cov(z.T), z, 3).T
        corr = np.array([np.corrcoef(c, z.mean(1))[0, 1] for c in s.T])
        k = int(np.abs(corr).argmax())
        return pd.DataFrame({"status": p["status"], "date": p["date"], "value": s[:, k] * np.sign(corr[k])})

    return _text(r_all(wide.groupBy("status").applyInPandas(run, "status string, date date, value double"), 4))


@query("H10_importances")
def _(spark, d):
    """Of the vectors' elements in a forest for three classes of the first, and its classes' mean probabilities."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = _vectors(spark, d).select("vec_id", array_to_vector("rest").alias("features"), F.when(F.col("x0") > 0.05, 2).when(F.col("x0") < -0.05, 0).otherwise(1).alias("label"))
    fit = RandomForestClassifier(numTrees=20, maxDepth=4, seed=7).fit(v)
    gains = [("importance", k, float(x)) for k, x in enumerate(fit.featureImportances.toArray())]
    p = fit.transform(v).select(F.posexplode(vector_to_array("probability")).alias("k", "p")).groupBy("k").agg(F.avg("p").alias("value"))
    return r_all(spark.createDataFrame(gains, "kind string, k int, value double").unionByName(p.select(F.lit("probability").alias("kind"), "k", "value")), 5)


# --- functions by name ----------------------------------------------------------------------------


@query("Y04_transform_registry", f"""WITH {WEEKLY}, c AS (SELECT series_id, date, ln(value) AS l FROM weekly), g AS (SELECT series_id, date, l - lag(l) OVER (PARTITION BY series_id ORDER BY date) AS g FROM c)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN count(g) OVER w >= 26 AND stddev_pop(g) OVER w > 0 THEN greatest(-3, least(3, (g - avg(g) OVER w) / stddev_pop(g) OVER w)) END, 6) + 0.0 AS value FROM g WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 51 PRECEDING)""")
def _(spark, d):
    return _text(r_all(registries.pipeline(weekly(spark, d).select("series_id", "date", "value"), ["log", "change", "z52", "clip3"], "series_id", "date", "value")))


@query("Y05_estimator_registry", f"""WITH {WEEKLY}, l AS (SELECT series_id, value / pi() AS v, lag(value / pi()) OVER w AS b, row_number() OVER w - 1 AS i FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)), g AS (SELECT series_id, avg(v) AS mean, median(v) AS median, regr_slope(v, i) AS trend, corr(v, b) AS persistence FROM l GROUP BY 1)
    SELECT series_id, estimator, round(value, 5) + 0.0 AS value FROM (UNPIVOT g ON mean, median, trend, persistence INTO NAME estimator VALUE value)""")
def _(spark, d):
    v = weekly(spark, d).select("series_id", "date", (F.col("value") / F.pi()).alias("v"))
    return r_all(registries.estimate(v, list(registries.ESTIMATORS), "series_id", "date", "v"), 5)


@query("Y06_models_by_features", f"""WITH {WEEKLY}, x AS (SELECT series_id, value / 1e5 AS y, lag(value / 1e5) OVER w AS a, CAST(n AS DOUBLE) AS b FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    s AS (SELECT series_id, 'last' AS features, y, a AS x FROM x WHERE a IS NOT NULL UNION ALL SELECT series_id, 'count', y, b FROM x), g AS (SELECT series_id, features, count(*) AS n, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(x, y) AS c FROM s GROUP BY ALL)
    SELECT series_id, model, features, n, round(sqrt(CASE model WHEN 'mean' THEN vy WHEN 'ols' THEN vy - c * c / vx ELSE vy - 2 * c * c / (vx + 1) + vx * (c / (vx + 1)) ** 2 END), 6) + 0.0 AS rmse FROM g, (VALUES ('mean'), ('ols'), ('ridge')) AS m(model)""")
def _(spark, d):
    x = weekly(spark, d).select("series_id", (F.col("value") / 1e5).alias("y"), (F.lag("value").over(_w()) / 1e5).alias("last"), F.col("n").cast("double").alias("count"))
    return r_all(registries.tournament(x, "series_id", "y", ["mean", "ols", "ridge"], {"last": ["last"], "count": ["count"]}))


@query("Y07_statistic_registry")
def _(spark, d):
    out = None
    for name in registries.STATISTICS:
        part = registries.bootstrap(weekly(spark, d), name, "series_id", "date", "value").withColumn("statistic", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return r_all(out, 3)


# --- streams ------------------------------------------------------------------------------------


@query("Y09_callbacks", "SELECT event_type, count(*) AS n, round(max(value), 6) + 0.0 AS highest FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, d):
    """A callback for each micro-batch of a stream: it sees each price once and stores what it makes of them."""
    base = shared_folder(spark)
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    on_price = lambda batch: batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("highest"))
    seen = feeds.with_callback(e.where("value is not null").select("event_type", "value"), on_price, f"{base}/out", f"{base}/ck")
    return seen.groupBy("event_type").agg(F.sum("n").alias("n"), r(F.max("highest")).alias("highest"))


@query("X06_simulated_feed", "SELECT role, count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM (SELECT DISTINCT role, text FROM conversations WHERE length(trim(text)) >= 10) GROUP BY 1")
def _(spark, d):
    """Messages injected as JSON lines, as a live feed has them, and read by the feed's stream: short ones go, repeated ones count once."""
    base = shared_folder(spark)
    c = table(spark, d, "conversations").where("text is not null")
    feeds.inject(c.select(F.lit("2026-01-01 00:00:00").cast("timestamp").alias("timestamp"), F.col("turn").cast("int").alias("chunk_index"), F.concat_ws("|", "role", "text").alias("text")), f"{base}/feed")
    lines = feeds.parse_feed(feeds.tail(spark, f"{base}/feed"), 1)
    seen = feeds.run_once(feeds.first_seen(lines, "1 hour"), f"{base}/out", f"{base}/ck")
    split = seen.select(F.split("text", r"\|", 2)[0].alias("role"), F.split("text", r"\|", 2)[1].alias("text")).where(F.length(F.trim("text")) >= 10)
    return split.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length(F.trim("text"))).alias("chars"))
