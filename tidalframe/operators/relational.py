"""Relational operators over keyed, ordered tables: alignment, as-of joins, islands, calendars, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..session import written


class SchemaError(ValueError):
    """A table lacks a column, a row, or a unique key."""


def validate(df: DataFrame, columns: dict[str, str], key: list[str], *, may_be_empty: bool = False) -> DataFrame:
    """Required columns cast to their types (bad values null); one aggregate proves rows and key."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    typed = df.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()], *[c for c in df.columns if c not in columns])
    counts = typed.groupBy(*key).count().agg(F.count("*").alias("keys"), F.sum(F.col("count") - 1).alias("again")).first()
    if counts["keys"] == 0 and not may_be_empty:
        raise SchemaError("no rows")
    if counts["again"]:
        raise SchemaError(f"{counts['again']} rows repeat their key ({', '.join(key)})")
    return typed


def align(frames: list[DataFrame], entity: str, date: str, value: str, *, series: str, limit: int | None = None) -> DataFrame:
    """Long frames put on the union of all dates; values filled at most ``limit`` rows; dates kept where every entity has one.

    ``entity`` is the group that must be complete, ``series`` the finer key that is filled.
    """
    long = reduce(DataFrame.unionByName, frames)
    dates, names = long.select(date).distinct(), long.select(entity, series).distinct()
    # The grid is dates x series: its rows are the aligned table itself.
    grid = dates.join(names).join(long, [date, entity, series], "left")
    filled = grid.withColumn(value, W.forward_fill(value, W.by([entity, series], date), limit))
    each = filled.where(F.col(value).isNotNull()).groupBy(date).agg(F.countDistinct(entity).alias("_n"))
    total = names.agg(F.countDistinct(entity).alias("_all"))
    whole = each.join(F.broadcast(total), F.col("_n") == F.col("_all")).select(date)
    return filled.join(whole, date)


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], *, direction: str = "backward", strict: bool = False) -> DataFrame:
    """Each left row with the nearest right row at or before (after) it, by union and one window.

    Both sides are shuffled once by ``by``; nothing is paired. Right rows
    repeating a time: the one of largest values wins. ``strict`` leaves equal times out.
    """
    names = [f"_r_{v}" for v in values]
    a = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(n) for v, n in zip(values, names, strict=True)], F.lit(1).alias("_left"))
    b = right.select(*by, on, *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)], F.lit(0).alias("_left"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_row", F.when(F.col("_left") == 0, F.struct(*names)))
    forward = direction == "forward"
    # Of equal times, right rows come first; with ``strict`` last, so they aren't seen.
    order = [F.col(on).desc() if forward else F.col(on).asc(), F.col("_left").desc() if strict else F.col("_left").asc(), "_row"]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_left = 1")
    return found.select(*left.columns, *[F.col(f"_row.{n}").alias(v) for v, n in zip(values, names, strict=True)])


def last_k(df: DataFrame, key: list[str], order: str, value: str, k: int, out: str = "lags") -> DataFrame:
    """The last ``k`` known values at each row, newest first; null unless there are ``k``."""
    known = df.where(F.col(value).isNotNull())
    held = F.collect_list(value).over(W.by(key, order).rowsBetween(-(k - 1), 0))
    return known.withColumn(out, F.when(F.size(held) == k, F.reverse(held)))


def top_by(df: DataFrame, key: str | list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each key in a total order, with their places."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)


def latest(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The last known value of each key, and its time."""
    return df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def lead_lag(df: DataFrame, key: str, order: str, x: str, y: str, most: int) -> DataFrame:
    """``corr(x_t, y_{t+h} - y_t)`` for h in -most..most but 0: one pass, no self-join."""
    w = W.by(key, order)
    steps = [h for h in range(-most, most + 1) if h]
    moved = [((F.lead(y, h) if h > 0 else F.lag(y, -h)).over(w) - F.col(y)).alias(f"_b{k}") for k, h in enumerate(steps)]
    pairs = [F.struct(F.lit(h).alias("h"), F.col("a"), F.col(f"_b{k}").alias("b")) for k, h in enumerate(steps)]
    long = df.select(key, F.col(x).alias("a"), *moved).select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*").where("a is not null and b is not null")
    return long.groupBy(key, "h").agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr"))


def crossing_metrics(df: DataFrame, key: str, order: str, x: str, levels: dict[str, float], yearly: float) -> DataFrame:
    """Crossings of levels, turning points, and how far these are from what noise has."""
    w = W.by(key, order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    flags = df.select(key, *[W.crossings(x, w, at).alias(name) for name, at in levels.items()], F.when((F.col(x) - before) * (after - F.col(x)) < 0, 1).otherwise(0).alias("_turn"))
    n, first = F.count("*"), next(iter(levels))
    return flags.groupBy(key).agg(
        n.alias("n"), *[F.sum(c).alias(c) for c in levels], F.sum("_turn").alias("turns"), (yearly * F.sum(first) / n).alias("yearly"),
        ((F.sum("_turn") - 2.0 * (n - 2) / 3) / F.sqrt((16.0 * n - 29) / 90)).alias("turns_z"),
    )


def dense_months(df: DataFrame, key: str, month: str, value: str, fill: int = 0) -> DataFrame:
    """Every month end between a key's first and last, absent ones with ``fill``."""
    span = df.groupBy(key).agg(F.trunc(F.min(month), "MM").alias("a"), F.trunc(F.max(month), "MM").alias("b"))
    dense = span.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(key, F.last_day("m").alias(month))
    return dense.join(df.select(key, month, value), [key, month], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def islands(df: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """Runs of equal ``state``: ``key, run, state, start, end, rows``; null states break runs and make none."""
    w = W.by(key, order)
    s = df.withColumn("_s", state)
    s = s.withColumn("_new", F.when(F.lag("_s").over(w).eqNullSafe(F.col("_s")), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("_s is not null").drop("_new").withColumnRenamed("_s", "state")


def episodes(df: DataFrame, key: str, order: str, z: str, k: float) -> DataFrame:
    """Contiguous extremes: ``side, start, end, weeks, peak`` (the z of largest size)."""
    side = F.when(F.col(z) > k, 1).when(F.col(z) < -k, -1)
    runs = islands(df, key, order, side)
    return runs.groupBy(key, "run").agg(F.first("state").alias("side"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("weeks"), F.max_by(z, F.struct(F.abs(z), F.col(order))).alias("peak"))


def average_holding(df: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """Mean run length of nonzero positions, runs, and entries from flat."""
    runs = islands(df, key, order, F.when(F.col(position) != 0, F.col(position)))
    lengths = runs.groupBy(key, "run").agg(F.count("*").alias("n")).groupBy(key).agg(F.avg("n").alias("holding"), F.count("*").alias("runs"))
    before = F.coalesce(F.lag(position).over(W.by(key, order)), F.lit(0))
    entry = df.withColumn("_e", F.when((before == 0) & (F.col(position) != 0), 1).otherwise(0)).groupBy(key).agg(F.sum("_e").alias("entries"))
    return entry.join(lengths, key, "left")


def backtest(df: DataFrame, key: str, order: str, position: str, price: str, cost: float, yearly: float = 252.0) -> DataFrame:
    """Yesterday's position times today's change, less turnover times ``cost``; one metrics row a key."""
    w = W.by(key, order)
    p = F.coalesce(F.lag(position).over(w), F.lit(0))
    d = df.withColumn("_p", p.cast("double")).withColumn("_ch", F.coalesce(W.change(price, w), F.lit(0.0)))
    d = d.withColumn("_turn", F.abs(F.col("_p") - F.coalesce(F.lag("_p").over(w), F.lit(0.0))))
    d = d.withColumn("_pnl", F.col("_p") * F.col("_ch") - F.col("_turn") * cost).withColumn("_cum", W.running_sum("_pnl", w))
    d = d.withColumn("_dd", F.col("_cum") - W.running_max("_cum", w))
    sd = F.stddev_pop("_pnl")
    return d.groupBy(key).agg(
        F.count("*").alias("n"), F.sum("_pnl").alias("total"), F.when(sd > 0, F.avg("_pnl") / sd * F.sqrt(F.lit(yearly))).alias("sharpe"),
        F.avg(F.when(F.col("_p") != 0, (F.col("_pnl") > 0).cast("double"))).alias("hit"), F.min("_dd").alias("max_drawdown"), F.sum("_turn").alias("turnover"),
    )


def decile_calibration(df: DataFrame, p: str, y: str, tie: str, n: int = 10) -> DataFrame:
    """Mean prediction, realised rate and size of each prediction decile, first come in rank.

    Deciles by global rank: ranks come from a sort by range, offset by each
    partition's count, so no window without a key gathers all rows in one task.
    """
    ranked = global_row_number(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()), [F.col(p), F.col(tie)], "_i")
    total = ranked.agg(F.count("*").alias("_n"))
    q, rest = F.floor(F.col("_n") / n), F.col("_n") % n
    first = (q + 1) * rest
    tile = F.when(F.col("_i") <= first, F.floor((F.col("_i") - 1) / (q + 1))).otherwise(rest + F.floor((F.col("_i") - 1 - first) / F.greatest(q, F.lit(1)))) + 1
    return ranked.join(F.broadcast(total)).withColumn("decile", tile.cast("int")).groupBy("decile").agg(F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("realised"), F.count("*").alias("n"))


def global_row_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row numbers in one global order: rows dealt by range, written once, and one count a range.

    Both branches read the written ranges: a second shuffle may cut elsewhere.
    Equal rows in ``order`` fall into one range.
    """
    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = part.withColumn(out, F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = part.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return local.join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def interpolate(q: Column, knots: list[tuple[float, Column]]) -> Column:
    """Piecewise linear through (probability, value) knots: P(X <= q), 0 and 1 beyond them."""
    out = F.lit(1.0)
    for (p0, v0), (p1, v1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(q <= v1, F.when(v1 > v0, F.lit(p0) + (q - v0) / (v1 - v0) * (p1 - p0)).otherwise(F.lit(p1))).otherwise(out)
    return F.when(q < knots[0][1], 0.0).otherwise(out)
