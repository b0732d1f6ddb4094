from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.functions import dates, scalars
from tidalframe.functions import windows as W


def series(spark, values, key="a"):
    rows = [(key, dt.date(2024, 1, 1) + dt.timedelta(days=k), None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, d date, x double")


def column(df, name, order="d"):
    return [row[0] for row in df.orderBy(order).select(name).collect()]


VALUES = [3, None, 1, 2, 2, 5, None, 4, 4, 4, 4, 7]


def test_rolling_z_against_pandas(spark):
    w = W.by("k", "d")
    got = column(series(spark, VALUES).withColumn("z", W.rolling_z("x", w, 4, 2)), "z")
    s = pd.Series(VALUES, dtype=float)
    m, sd = s.rolling(4, min_periods=2).mean(), s.rolling(4, min_periods=2).std(ddof=0)
    want = ((s - m) / sd.where(sd > 1e-12)).tolist()
    assert [None if v is None else round(v, 9) for v in got] == [None if not np.isfinite(v) else round(v, 9) for v in want]


def test_ranks_on_one_window(spark):
    w = W.by("k", "d")
    df = series(spark, [3, 1, 2, 2]).withColumns({"below": W.below_share("x", w, 4, 4), "mid": W.mid_rank("x", w, 4, 4)})
    assert column(df, "below")[-1] == 0.25
    assert column(df, "mid")[-1] == 0.5


def test_fill_is_bounded_by_rows(spark):
    w = W.by("k", "d")
    df = series(spark, [1, None, None, 4]).withColumn("f", W.forward_fill("x", w, 1))
    assert column(df, "f") == [1.0, 1.0, None, 4.0]


@pytest.mark.parametrize("build", [
    lambda w: W.rolling_z("x", w, 4, 2), lambda w: W.cot_index("x", w, 4), lambda w: W.fisher("x", w, 4), lambda w: W.below_share("x", w, 4, 2), lambda w: W.mid_rank("x", w, 4, 2),
    lambda w: W.argsort_rank("x", w, 4, 2), lambda w: W.forward_fill("x", w), lambda w: W.volatility("x", w, 4, 2), lambda w: W.fractional_difference("x", w, 0.4, 3), lambda w: W.median("x", w, 3, 1),
])
def test_no_look_ahead(spark, build):
    w = W.by("k", "d")
    whole = column(series(spark, VALUES).withColumn("o", build(w)), "o")
    for cut in (5, 9):
        assert column(series(spark, VALUES[:cut]).withColumn("o", build(w)), "o") == whole[:cut]


def test_weeks_and_business_days(spark):
    days = [dt.date(2026, 7, 24) + dt.timedelta(days=k) for k in range(12)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    row = {r.d: r for r in df.select("d", dates.week_index_monday("d").alias("w"), dates.week_ending_friday("d").alias("f"), dates.add_business_days("d", 3).alias("p"), dates.add_business_days("d", -2).alias("m")).collect()}
    assert row[dt.date(2026, 7, 27)].w + 1 == row[dt.date(2026, 7, 28)].w
    assert row[dt.date(2026, 7, 25)].f == dt.date(2026, 7, 31) and row[dt.date(2026, 7, 31)].f == dt.date(2026, 7, 31)
    for x in days:
        assert row[x].p == (pd.Timestamp(x) + pd.offsets.BDay(3)).date()
        assert row[x].m == (pd.Timestamp(x) - pd.offsets.BDay(2)).date()


def test_bond_at_par(spark):
    b = scalars.par_bond(F.lit(10.0), F.lit(4.0))
    p, d, v = spark.range(1).select(b["price"], b["duration"], b["dv01"]).first()
    assert math.isclose(p, 1.0) and math.isclose(v, p * d * 1e-4)
    b = scalars.par_bond(F.lit(10.0), F.lit(0.04))
    assert math.isclose(spark.range(1).select(b["dv01"]).first()[0], v)


def test_duration_legs_add_up(spark):
    df = spark.createDataFrame([(1,), (0,), (-1,)], "s int")
    legs = scalars.duration_legs("s", F.lit(3))
    rows = df.select(legs["leg5"].alias("a"), legs["leg10"].alias("b")).collect()
    assert [r.a for r in rows] == [20.2, 15.0, 9.8]
    assert all(math.isclose(r.a + r.b, 30.0) for r in rows)


def test_weights_sum_to_one(spark):
    for w in (scalars.beta_weights(8, 1.5, 3.0), scalars.almon_weights(8, 0.1, -0.05)):
        assert math.isclose(sum(spark.range(1).select(w).first()[0]), 1.0)


def test_shrinkage_falls_back(spark):
    e = scalars.shrink(F.lit(None).cast("double"), F.lit(0), F.lit(None).cast("double"), F.lit(0), F.lit(0.3))
    assert math.isclose(spark.range(1).select(e).first()[0], 0.3)


def test_slope_of_newest_first_lags(spark):
    e = scalars.lag_slope(F.array(*[F.lit(float(v)) for v in (5, 4, 3, 2, 1)]), 5)
    assert spark.range(1).select(e).first()[0] < 0
