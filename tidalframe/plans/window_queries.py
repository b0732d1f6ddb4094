"""Window operators (W*) over the weekly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..registry import query, r, r_all
from .analogues import MONTHLY, PAIR, POSITIONS, WEEKLY, monthly, pair, positions, weekly

def _by():
    return W.by("series_id", "date")


def out(df, *cols, n: int = 6):
    return r_all(df.select("series_id", "date", *cols), n).withColumn("date", F.col("date").cast("string"))


def sql(cols: dict[str, str], n: int = 26, source: str = "weekly", ctes: str = WEEKLY, digits: int = 6, more: str = "") -> str:
    """Columns over a frame ``f`` of the last ``n`` rows, and ``w`` unframed."""
    listed = ", ".join(f"round({e}, {digits}) + 0.0 AS {c}" for c, e in cols.items())
    return f"""WITH {ctes} SELECT series_id, CAST(date AS VARCHAR) AS date, {listed} FROM {source}
        WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), w AS (PARTITION BY series_id ORDER BY date){more}"""


Z = "CASE WHEN count(x) OVER f >= {m} AND stddev_pop(x) OVER f > 0 THEN (x - avg(x) OVER f) / stddev_pop(x) OVER f END"


@query("W01_rolling_zscore", sql({"z": Z.format(m=13)}))
def _(spark, d):
    return out(weekly(spark, d), W.rolling_z("x", _by(), 26).alias("z"))


@query("W02_bollinger", sql({k: f"CASE WHEN count(value) OVER f >= 26 THEN (avg(value) OVER f {s}) / pi() END" for k, s in (("mid", ""), ("upper", "+ 2 * stddev_pop(value) OVER f"), ("lower", "- 2 * stddev_pop(value) OVER f"))}, digits=4))
def _(spark, d):
    return out(weekly(spark, d), *[(e / F.pi()).alias(k) for k, e in W.bollinger("value", _by(), 26).items()], n=4)


@query("W03_zscore_center", sql({"z": "CASE WHEN count(value) OVER f >= 26 AND stddev_pop(value) OVER f > 0 THEN (value - 250000.0) / stddev_pop(value) OVER f END"}))
def _(spark, d):
    return out(weekly(spark, d), W.rolling_z("value", _by(), 26, 26, center=250000.0).alias("z"))


@query("W04_rolling_percentile", sql({"share": "CASE WHEN count(x) OVER f >= 13 AND x IS NOT NULL THEN CAST(len(list_filter(list(x) OVER f, lambda v: v < x)) AS DOUBLE) / count(*) OVER f END"}))
def _(spark, d):
    return out(weekly(spark, d), W.below_share("x", _by(), 26).alias("share"))


@query("W05_forward_fill", f"""WITH {WEEKLY} SELECT series_id, CAST(date AS VARCHAR) AS date,
    round(last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 8) + 0.0 AS bounded,
    round(last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) + 0.0 AS unbounded FROM weekly""")
def _(spark, d):
    return out(weekly(spark, d), W.forward_fill("x", _by(), 1).alias("bounded"), W.forward_fill("x", _by()).alias("unbounded"), n=8)


@query("W07_cot_index", sql({"idx": "CASE WHEN count(x) OVER f >= 13 AND max(x) OVER f > min(x) OVER f THEN 100.0 * (x - min(x) OVER f) / (max(x) OVER f - min(x) OVER f) END"}))
def _(spark, d):
    return out(weekly(spark, d), W.cot_index("x", _by(), 26).alias("idx"))


_V = "greatest(-0.999, least(0.999, 2 * (x - min(x) OVER f) / (max(x) OVER f - min(x) OVER f) - 1))"


@query("W08_fisher", sql({"fish": f"CASE WHEN count(x) OVER f >= 13 AND max(x) OVER f > min(x) OVER f AND x IS NOT NULL THEN 0.5 * ln((1 + {_V}) / (1 - {_V})) END"}))
def _(spark, d):
    return out(weekly(spark, d), F.when(F.col("x").isNotNull(), W.fisher("x", _by(), 26)).alias("fish"))


@query("W09_robust_mad_z", f"""WITH {WEEKLY}, m AS (SELECT *, CASE WHEN count(x) OVER f >= 13 THEN quantile_cont(x, 0.5) OVER f END AS med FROM weekly
        WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    a AS (SELECT *, abs(x - med) AS away FROM m),
    s AS (SELECT *, CASE WHEN count(away) OVER f >= 13 THEN 1.4826 * quantile_cont(away, 0.5) OVER f END AS scale FROM a
        WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN scale > 0 THEN (x - med) / scale END, 6) + 0.0 AS z FROM s""")
def _(spark, d):
    return out(W.robust_z(weekly(spark, d), "x", "z", _by(), 26), "z")


_N = "len(list_filter(list(x) OVER f, lambda v: v {op} x))"


@query("W10_rank_flavours", sql({
    "v7": f"CASE WHEN count(x) OVER f >= 13 AND x IS NOT NULL THEN CAST({_N.format(op='<=')} AS DOUBLE) / count(x) OVER f END",
    "v9": f"CASE WHEN count(x) OVER f >= 26 - 9 AND x IS NOT NULL THEN 2 * CAST({_N.format(op='<=')} AS DOUBLE) / count(x) OVER f - 1 END",
    "v8": f"CASE WHEN count(x) OVER f >= 13 AND x IS NOT NULL THEN ({_N.format(op='<')} + 0.5 * {_N.format(op='=')}) / count(x) OVER f END"}))
def _(spark, d):
    return out(weekly(spark, d), W.argsort_rank("x", _by(), 26, 13).alias("v7"), W.signed_rank("x", _by(), 26, 17).alias("v9"), W.mid_rank("x", _by(), 26, 13).alias("v8"))


@query("W11_lags_and_changes", sql({f"d{k}": f"value - lag(value, {k}) OVER w" for k in (1, 4, 12)} | {"p13": "CASE WHEN lag(value, 13) OVER w <> 0 THEN value / lag(value, 13) OVER w - 1 END", "ahead": "lead(value, 4) OVER w"}, digits=8))
def _(spark, d):
    return out(weekly(spark, d), *[W.change("value", _by(), k).alias(f"d{k}") for k in (1, 4, 12)], W.pct_change("value", _by(), 13).alias("p13"), F.lead("value", 4).over(_by()).alias("ahead"), n=8)


@query("W12_rolling_beta", sql({"beta": "CASE WHEN count(*) OVER f >= 26 THEN regr_slope(y, z) OVER f END"}, ctes=PAIR, source="pair"))
def _(spark, d):
    return out(pair(spark, d), W.rolling_beta("y", "z", _by(), 26).alias("beta"))


@query("W13_realised_volatility", f"""WITH {WEEKLY}, c AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS ch FROM weekly)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN count(ch) OVER f >= 21 THEN stddev_samp(ch) OVER f * sqrt(52.0) END, 4) + 0.0 AS vol FROM c
    WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return out(weekly(spark, d).withColumn("ch", W.change("value", _by())), W.volatility("ch", _by(), 21, yearly=52.0).alias("vol"), n=4)


@query("W14_equity_and_drawdown", f"""WITH {WEEKLY}, c AS (SELECT *, coalesce(value / lag(value) OVER w - 1, 0.0) / 100 AS ret FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    e AS (SELECT *, sum(ret) OVER u AS cum, exp(sum(ln(1 + ret)) OVER u) AS lev FROM c WINDOW u AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(cum, 6) + 0.0 AS cum, round(cum - max(cum) OVER u, 6) + 0.0 AS drawdown, round(lev, 6) + 0.0 AS lev FROM e
    WINDOW u AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    df = weekly(spark, d).withColumn("ret", F.coalesce(W.pct_change("value", _by()), F.lit(0.0)) / 100).withColumn("cum", W.running_sum("ret", _by()))
    return out(df, "cum", (F.col("cum") - W.running_max("cum", _by())).alias("drawdown"), W.level("ret", _by()).alias("lev"))


@query("W15_lead_lag_correlation", f"""WITH {PAIR}, k AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM pair)
    SELECT CAST(h AS INTEGER) AS h, count(*) AS n, round(corr(a.z, b.y - a.y), 6) + 0.0 AS corr
    FROM k AS a, (SELECT unnest(range(-6, 7)) AS h) AS hs JOIN k AS b ON b.i = a.i + h WHERE h <> 0 GROUP BY h""")
def _(spark, d):
    from ..operators.relational import lead_lag

    return r_all(lead_lag(pair(spark, d), "series_id", "date", "z", "y", 6).select("h", "n", "corr"))


@query("W16_crossings", f"""WITH {WEEKLY}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS v FROM weekly),
    l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM m WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, count(*) AS n, CAST(sum(CASE WHEN a * v < 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero, CAST(sum(CASE WHEN (a - 20000.0) * (v - 20000.0) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS high,
           CAST(sum(CASE WHEN (v - a) * (b - v) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS turns,
           round(52.0 * sum(CASE WHEN a * v < 0 THEN 1 ELSE 0 END) / count(*), 6) + 0.0 AS yearly,
           round((sum(CASE WHEN (v - a) * (b - v) < 0 THEN 1 ELSE 0 END) - 2.0 * (count(*) - 2) / 3) / sqrt((16.0 * count(*) - 29) / 90), 6) + 0.0 AS turns_z
    FROM l GROUP BY series_id""")
def _(spark, d):
    from ..operators.relational import crossing_metrics

    df = weekly(spark, d)
    mean = df.groupBy("series_id").agg(F.avg("value").alias("m"))
    v = df.join(mean, "series_id").withColumn("v", F.col("value") - F.col("m"))
    return r_all(crossing_metrics(v, "series_id", "date", "v", {"zero": 0.0, "high": 20000.0}, 52.0))


@query("W17_rice_budget", f"""WITH {WEEKLY}, c AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS ch FROM weekly)
    SELECT series_id, round(count(ch) / pi() * sqrt(var_pop(ch) / nullif(var_pop(value), 0)), 6) + 0.0 AS expected FROM c GROUP BY series_id""")
def _(spark, d):
    c = weekly(spark, d).withColumn("ch", W.change("value", _by()))
    rate = F.sqrt(F.try_divide(F.var_pop("ch"), F.var_pop("value")))
    return r_all(c.groupBy("series_id").agg((F.count("ch") / F.pi() * rate).alias("expected")))


_PZ = "CASE WHEN count(net) OVER f >= 13 AND stddev_pop(net) OVER f > 0 THEN (net - avg(net) OVER f) / stddev_pop(net) OVER f END"


@query("W18_breadth_dispersion", f"""WITH {POSITIONS}, z AS (SELECT date, {_PZ} AS z FROM positions WINDOW f AS (PARTITION BY instrument, category ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
    SELECT CAST(date AS VARCHAR) AS date, count(z) AS n, round(avg(CASE WHEN z IS NOT NULL THEN sign(z) * CASE WHEN abs(z) > 1 THEN 1 ELSE 0 END END), 6) + 0.0 AS breadth,
           round(stddev_pop(z), 6) + 0.0 AS dispersion FROM z GROUP BY date""")
def _(spark, d):
    z = positions(spark, d).withColumn("z", W.rolling_z("net", W.by(["instrument", "category"], "date"), 26, 13))
    side = F.signum("z") * F.when(F.abs("z") > 1, 1).otherwise(0)
    return r_all(z.groupBy(F.col("date").cast("string").alias("date")).agg(F.count("z").alias("n"), F.avg(side).alias("breadth"), F.stddev_pop("z").alias("dispersion")))


@query("W19_roll_outliers", f"""WITH {WEEKLY}, c AS (SELECT *, abs(value / lag(value) OVER w - 1) AS a FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    m AS (SELECT *, CASE WHEN count(a) OVER f >= 10 THEN quantile_cont(a, 0.5) OVER f END AS med FROM c WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(a, 6) + 0.0 AS a, round(med, 6) + 0.0 AS med FROM m WHERE a > 3 * med""")
def _(spark, d):
    c = weekly(spark, d).withColumn("a", F.abs(W.pct_change("value", _by())))
    return out(c.withColumn("med", W.median("a", _by(), 63, 10)).where("a > 3 * med"), "a", "med")


@query("W20_ar1_consensus", f"""WITH {MONTHLY}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY month) AS before FROM monthly),
    q AS (SELECT *, CASE WHEN before IS NOT NULL THEN value END AS y_, before AS z_ FROM l),
    s AS (SELECT *, covar_samp(y_, z_) OVER p / (var_pop(z_) OVER p + 1e-10) AS slope, avg(y_) OVER p AS my, avg(z_) OVER p AS mz,
                 count(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING) AS n_
          FROM q WINDOW p AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 35 PRECEDING AND 1 PRECEDING))
    SELECT series_id, CAST(month AS VARCHAR) AS date, round(CASE WHEN n_ >= 24 THEN my - slope * mz + slope * z_ END, 4) + 0.0 AS forecast FROM s""")
def _(spark, d):
    m = monthly(spark, d).withColumnRenamed("month", "date")
    return out(W.ar1_forecast(m, "value", "forecast", _by()), "forecast", n=4)


_FFD = W.ffd_weights(0.4, 10)


@query("W21_fractional_difference", sql({"ffd": "CASE WHEN count(value) OVER f >= 10 THEN " + " + ".join(f"({v!r}) * lag(value, {k}) OVER w" if k else "value" for k, v in enumerate(_FFD)) + " END"}, n=10, digits=4))
def _(spark, d):
    return out(weekly(spark, d), W.fractional_difference("value", _by(), 0.4, 10).alias("ffd"), n=4)


@query("W22_dense_months", f"""WITH {MONTHLY}, span AS (SELECT series_id, min(month) AS a, max(month) AS b FROM monthly WHERE n % 5 <> 0 GROUP BY 1),
    dense AS (SELECT series_id, last_day(CAST(m AS DATE)) AS month FROM span, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS r(m))
    SELECT series_id, CAST(d.month AS VARCHAR) AS date, coalesce(n, 0) AS n FROM dense AS d LEFT JOIN (SELECT * FROM monthly WHERE n % 5 <> 0) AS m USING (series_id, month)""")
def _(spark, d):
    from ..operators.relational import dense_months

    return dense_months(monthly(spark, d).where("n % 5 <> 0"), "series_id", "month", "n").select("series_id", F.col("month").cast("string").alias("date"), "n")


@query("W23_top_shifts", f"""WITH {WEEKLY}, c AS (SELECT series_id, date, value - lag(value, 3) OVER (PARTITION BY series_id ORDER BY date) AS shift FROM weekly),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(shift) DESC, date) AS place FROM c WHERE abs(shift) > 5)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(shift, 4) + 0.0 AS shift, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10""")
def _(spark, d):
    from ..operators.relational import top_by

    c = weekly(spark, d).withColumn("shift", W.change("value", _by(), 3)).where("abs(shift) > 5")
    return out(top_by(c, "series_id", [F.desc(F.abs("shift")), F.col("date")], 10, "place"), "shift", "place", n=4)


_C = "CASE WHEN count({0}) OVER f >= 13 AND stddev_pop({0}) OVER f > 0 THEN ({0} - avg({0}) OVER f) / stddev_pop({0}) OVER f END"


@query("W24_feature_panel", f"""WITH {POSITIONS}, g AS (SELECT date, category AS series_id, sum(net) AS lvl, sum(CASE WHEN instrument = 'O' THEN net ELSE 0 END) - sum(CASE WHEN instrument = 'F' THEN net ELSE 0 END) AS curve FROM positions GROUP BY ALL),
    h AS (SELECT *, lvl - lag(lvl, 4) OVER (PARTITION BY series_id ORDER BY date) AS flow FROM g)
    SELECT series_id, CAST(date AS VARCHAR) AS date, {', '.join(f'round({_C.format(c)}, 6) + 0.0 AS {c}_z' for c in ('lvl', 'flow', 'curve'))} FROM h
    WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    long = F.when(F.col("instrument") == "O", F.col("net")).otherwise(0.0)
    short = F.when(F.col("instrument") == "F", F.col("net")).otherwise(0.0)
    g = positions(spark, d).groupBy("date", F.col("category").alias("series_id")).agg(F.sum("net").alias("lvl"), (F.sum(long) - F.sum(short)).alias("curve"))
    g = g.withColumn("flow", W.change("lvl", _by(), 4))
    return out(g, *[W.rolling_z(c, _by(), 26, 13).alias(f"{c}_z") for c in ("lvl", "flow", "curve")])


@query("W25_curve_crowding", f"""WITH {POSITIONS}, z AS (SELECT date, {_PZ} AS z FROM (SELECT date, category, sum(net) AS net FROM positions GROUP BY ALL) WINDOW f AS (PARTITION BY category ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    m AS (SELECT 'all' AS series_id, date, avg(z) AS x FROM z GROUP BY date HAVING count(z) > 0)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(x, 6) + 0.0 AS mean_z, round({Z.format(m=13)}, 5) + 0.0 AS again_z FROM m
    WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    c = positions(spark, d).groupBy("date", "category").agg(F.sum("net").alias("net"))
    z = c.withColumn("z", W.rolling_z("net", W.by("category", "date"), 26, 13)).groupBy("date").agg(F.avg("z").alias("x")).where("x is not null").withColumn("series_id", F.lit("all"))
    return out(z, r("x").alias("mean_z"), r(W.rolling_z("x", _by(), 26, 13), 5).alias("again_z"))


@query("W26_predictive_features", f"""WITH {PAIR}, c AS (SELECT *, {_C.format('y')} AS yz, {_C.format('z')} AS zz FROM pair WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, yz - lag(yz) OVER w AS step, y - lag(y) OVER w AS dy FROM c WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(yz, 6) + 0.0 AS composite, round(step, 6) + 0.0 AS step, round(abs(yz), 6) + 0.0 AS size, round(zz, 6) + 0.0 AS yield_z,
           round(spread, 4) + 0.0 AS slope, round(CASE WHEN count(dy) OVER g >= 13 THEN stddev_samp(dy) OVER g END, 4) + 0.0 AS vol FROM e
    WINDOW g AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    p = pair(spark, d).withColumn("yz", W.rolling_z("y", _by(), 26, 13)).withColumn("zz", W.rolling_z("z", _by(), 26, 13)).withColumn("dy", W.change("y", _by()))
    return out(p, r("yz").alias("composite"), r(W.change("yz", _by())).alias("step"), r(F.abs("yz")).alias("size"), r("zz").alias("yield_z"), r("spread", 4).alias("slope"), r(W.volatility("dy", _by(), 26, 13), 4).alias("vol"))
