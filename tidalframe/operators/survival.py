"""Discrete-time survival: panels of keys and weeks, hazards, survival curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


def build_panel(events: DataFrame, key: str, week: str, n: str, last: int | None = None, cap: int = 260, trailing: int = 52) -> DataFrame:
    """At-risk rows of every key, from the week after its first event to the ``last`` week.

    All columns are constant between a few weeks of a key: those of its events,
    the weeks after them and those where events leave the ``trailing`` weeks.
    Only these are shuffled, once by key, and windowed; the weeks between are
    made in place at the end, so no shuffle or sort holds the grid. ``y``,
    ``weeks_since_last`` (at most ``cap``) and the events of the ``trailing`` weeks before.
    """
    n_ = F.when(F.col(key).isNotNull(), F.col("_n")).otherwise(0)
    none = F.lit(None).cast(events.schema[week].dataType)

    def step(at: int, change: Column, event: Column, y: Column) -> Column:
        return F.struct((F.col(week) + at).alias("_p"), change.alias("_d"), event.alias("_e"), y.alias("_y"))

    counted = events.where(F.col(week).isNotNull()).groupBy(key, week).agg(F.coalesce(F.sum(n), F.lit(0)).alias("_n")).repartition(key)
    steps = F.array(
        step(0, F.lit(0) * n_, none, (n_ > 0).cast("int")),
        step(1, n_, F.when(n_ > 0, F.col(week)), F.lit(0)),
        step(trailing + 1, -n_, none, F.lit(0)),
    )
    points = counted.select(key, F.explode(steps).alias("_s")).groupBy(key, F.col("_s._p").alias("_p")).agg(F.sum("_s._d").alias("_d"), F.max("_s._e").alias("_e"), F.max("_s._y").alias("y"))
    w = W.by(key, "_p")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    spans = points.select(key, "_p", "y", F.sum("_d").over(so_far).alias("_t"), F.max("_e").over(so_far).alias("_e"), F.lead("_p").over(w).alias("_next"), F.row_number().over(w).alias("_k"))
    spans = spans.join(F.broadcast(events.agg(F.max(week).alias("_b")))) if last is None else spans.withColumn("_b", F.lit(last))
    # The first point is the first event's week, which is not at risk.
    spans = spans.withColumn("_to", F.least(F.col("_next") - 1, F.col("_b"))).where((F.col("_k") > 1) & (F.col("_p") <= F.col("_to")))
    out = spans.select(key, F.explode(F.sequence("_p", "_to")).alias(week), "_e", "_t", "y")
    return out.select(key, week, F.least(F.col(week) - F.col("_e"), F.lit(cap)).alias("weeks_since_last"), F.col("_t").alias(f"issues_trailing_{trailing}w"), "y")


def survival(df: DataFrame, key: str, step: str, hazard: str) -> DataFrame:
    """``survival``: the product of one minus hazard up to each step (steps from 1)."""
    return df.withColumn("survival", F.exp(F.sum(F.log1p(-F.col(hazard))).over(W.by(key, step).rowsBetween(Window.unboundedPreceding, 0))))


def timing_probability(curves: DataFrame, key: str, step: str, spec: tuple) -> DataFrame:
    """``('within', k)``, ``('interval', a, b)`` (first event in a..b) or ``('recurrent', a, b)`` (any event in a..b)."""
    h, s = F.col("hazard"), F.col(step)
    none = lambda lo, hi: F.exp(F.coalesce(F.sum(F.when(s.between(lo, hi), F.log1p(-h))), F.lit(0.0)))
    kind, *at = spec
    if kind == "within":
        p = 1 - none(1, at[0])
    elif kind == "interval":
        p = none(1, at[0] - 1) - none(1, at[1])
    elif kind == "recurrent":
        p = 1 - none(at[0], at[1])
    else:
        raise ValueError(f"unknown horizon {kind}")
    return curves.groupBy(key).agg(p.alias("probability"))


def within_horizon(h: Column | str, w, n: int) -> Column:
    """Chance of an event in the next ``n`` rows."""
    c = F.col(h) if isinstance(h, str) else h
    return 1 - F.exp(F.sum(F.log1p(-c)).over(w.rowsBetween(1, n)))
