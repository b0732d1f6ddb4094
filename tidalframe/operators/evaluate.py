"""Scores, tests and calibration as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..session import written


def regression_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    sse, n = F.sum(e * e), F.count(e)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(n.alias("n"), F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(sse, n * F.var_pop(y))).alias("r2"))


def classification_scores(df: DataFrame, y: str, p: str, at: float = 0.5) -> DataFrame:
    """Binary labels against probabilities: accuracy, precision, recall, log loss, Brier."""
    t, c = F.col(y).cast("double"), (F.col(p) >= at).cast("double")
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(
        F.count("*").alias("n"), F.avg((t == c).cast("double")).alias("accuracy"), F.try_divide(F.sum(t * c), F.sum(c)).alias("precision"), F.try_divide(F.sum(t * c), F.sum(t)).alias("recall"),
        F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"), F.avg((F.col(p) - t) ** 2).alias("brier"),
    )


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve: pairs won, ties half. Counted over distinct scores, so no global sort of rows.

    The running count needs an order over distinct scores: they are dealt by
    range and written once, so that the counts inside and before a range are of
    the same ranges; only range totals meet in one task.
    """
    g = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg"))
    part = written(g.repartitionByRange("_p").withColumn("_k", F.spark_partition_id()))
    inside = part.withColumn("_low", F.coalesce(F.sum("_neg").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = part.groupBy("_k").agg(F.sum("_neg").alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_k", "_before")
    j = inside.join(F.broadcast(before), "_k")
    won = F.sum(F.col("_pos") * (F.col("_low") + F.col("_before") + 0.5 * F.col("_neg")))
    return j.agg(F.try_divide(won, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"))


def rank_correlation(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Spearman's correlation a key."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        d = d.withColumn(f"_r_{c}", F.rank().over(Window.partitionBy(key).orderBy(c)) + (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2)
    return d.groupBy(key).agg(F.count("*").alias("n"), F.corr(f"_r_{x}", f"_r_{y}").alias("ic"))


def loss_test_sample(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared-error difference over its standard error (sample variance, no lags)."""
    d = F.col(a) ** 2 - F.col(b) ** 2
    return df.agg(F.count(d).alias("n"), (F.avg(d) / F.sqrt(F.var_samp(d) / F.count(d))).alias("stat"))


def loss_test_weighted(df: DataFrame, key: str, order: str, a: str, b: str, lags: int) -> DataFrame:
    """The same with a Bartlett-weighted long-run population variance."""
    w = W.by(key, order)
    d = df.withColumn("_d", F.col(a) ** 2 - F.col(b) ** 2)
    mean = d.groupBy(key).agg(F.avg("_d").alias("_m"))
    e = d.join(mean, key).withColumn("_e", F.col("_d") - F.col("_m"))
    e = e.withColumns({f"_e{h}": F.lag("_e", h).over(w) for h in range(1, lags + 1)})
    n = F.count("_d")
    var = F.sum(F.col("_e") ** 2) / n
    for h in range(1, lags + 1):
        var = var + 2 * (1 - h / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_e{h}")), F.lit(0.0)) / n
    return e.groupBy(key).agg(n.alias("n"), (F.avg("_d") / F.sqrt(var / n)).alias("stat"))


def kupiec(df: DataFrame, breach: Column, rate: float) -> DataFrame:
    """Likelihood ratio that breaches come at ``rate``."""
    x, n = F.sum(breach.cast("double")), F.count(breach)
    p = F.least(F.greatest(x / n, F.lit(1e-12)), F.lit(1 - 1e-12))
    like = lambda q: x * F.log(q) + (n - x) * F.log(1 - q)
    return df.agg(n.alias("n"), x.alias("breaches"), (-2 * (like(F.lit(rate)) - like(p))).alias("lr"))


def crps(df: DataFrame, key: str, draw: str, observed: str) -> DataFrame:
    """Continuous ranked probability score of draws: mean distance less half the mean pair distance.

    The pair term is a weighted sum over sorted draws, so draws are never paired.
    """
    w = Window.partitionBy(key).orderBy(draw)
    d = df.withColumn("_i", F.row_number().over(w))
    m = F.count("*")
    pairs = F.sum((2 * F.col("_i") - 1) * F.col(draw)) - m * F.sum(draw)
    return d.groupBy(key).agg((F.avg(F.abs(F.col(draw) - F.col(observed))) - pairs / (m * m)).alias("crps"), F.avg((F.col(draw) <= F.col(observed)).cast("double")).alias("pit"))


def half_life(df: DataFrame, key: str, order: str, x: str, least: int = 30) -> DataFrame:
    """Half-life of mean reversion from the slope of changes on levels; infinite unless negative."""
    before = F.lag(x).over(W.by(key, order))
    d = df.where(F.col(x).isNotNull()).select(key, F.col(x).alias("_x"), before.alias("_b")).where("_b is not null")
    slope = F.regr_slope(F.col("_x") - F.col("_b"), F.col("_b"))
    life = F.when(slope < 0, -F.log(F.lit(2.0)) / slope).otherwise(F.lit(float("inf")))
    return d.groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, slope).alias("slope"), F.when(F.count("*") >= least, life).alias("half_life"))


def effective_bets(corr_mean: Column, n: Column) -> Column:
    """Independent bets among ``n`` of mean correlation: n over 1 + (n - 1) rho."""
    return F.try_divide(n, 1 + (n - 1) * corr_mean)
