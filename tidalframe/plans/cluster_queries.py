"""Clusters of years (M20) and components of texts (M19)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import text_components as T
from ..registry import query, r_all, table

#: A short list; callers pass their own.
STOP = ("the", "and", "of", "to", "in", "is", "it", "that", "for", "on", "at", "with", "as", "are", "this", "be")

_SHAPES = """s AS (SELECT o_orderpriority AS series_id, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE month(o_orderdate) <= 7 GROUP BY ALL),
    t AS (SELECT series_id, y, sum(n) AS total FROM s GROUP BY ALL), x AS (SELECT t.series_id, t.y, g.m, coalesce(s.n, 0) / t.total AS v FROM t, (SELECT unnest(range(1, 8)) AS m) AS g LEFT JOIN s ON s.series_id = t.series_id AND s.y = t.y AND s.m = g.m)"""


def _years(spark, d):
    """Each year's shares of its orders by month, up to July, as the last year has no more."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).where("m <= 7")
    return C.shapes(o.groupBy("series_id", "y", "m").agg(F.count("*").cast("double").alias("n")), ["series_id", "y"], F.col("m"), "n", 7)


@query("M20_ward_tree")
def _(spark, d):
    return r_all(C.trees(_years(spark, d), "series_id", "y", "shape"))


@query("M20_silhouette_scan")
def _(spark, d):
    return r_all(C.scan(_years(spark, d), "series_id", "y", "shape"))


@query("M20_era_silhouettes", f"""WITH {_SHAPES}, p AS (SELECT a.series_id, a.y AS ya, b.y AS yb, sqrt(sum((a.v - b.v) ** 2)) AS d FROM x AS a JOIN x AS b ON a.series_id = b.series_id AND a.m = b.m WHERE a.y <> b.y GROUP BY ALL),
    m AS (SELECT series_id, ya, ya < 1998 AS la, yb < 1998 AS lb, avg(d) AS d FROM p GROUP BY ALL), o AS (SELECT series_id, ya, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS other FROM m GROUP BY ALL)
    SELECT series_id, CAST(ya AS INTEGER) AS y, round(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 8) + 0.0 AS silhouette FROM o""")
def _(spark, d):
    """Years before and from 1998 on as two clusters."""
    return r_all(C.labelled_silhouettes(_years(spark, d).withColumn("era", F.col("y") < 1998), "series_id", "y", "era", "shape"), 8)


def _weights(spark, d):
    return T.tf_idf(table(spark, d, "conversations"), ["conv_id", "turn"], "text", features=200, stop=STOP)


@query("M19_tf_idf", f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '\\w\\w+'), lambda t: t NOT IN ({", ".join(f"'{s}'" for s in STOP)})) AS w FROM conversations WHERE text IS NOT NULL),
    e AS (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM w),
    tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM w),
    v AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS place FROM (SELECT term, sum(tf) AS many, count(*) AS df FROM tf GROUP BY 1 ORDER BY many DESC, term LIMIT 200)),
    g AS (SELECT conv_id, turn, term, place, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term), n)
    SELECT conv_id, turn, term, CAST(place AS INTEGER) AS place, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)), 8) + 0.0 AS weight FROM g""")
def _(spark, d):
    return r_all(_weights(spark, d), 8)


@query("M19_text_components")
def _(spark, d):
    """Texts by thirty components, and five clusters of those."""
    rows = T.sparse_rows(_weights(spark, d), ["conv_id", "turn"]).persist()
    scored = T.scores(rows, T.components(rows, 200, 30)).withColumn("features", array_to_vector("scores"))
    out = KMeans(k=5, seed=42, predictionCol="cluster").fit(scored).transform(scored)
    return r_all(out.select("conv_id", "turn", "cluster", *[F.col("scores")[k].alias(f"c{k + 1}") for k in range(3)]), 4)
