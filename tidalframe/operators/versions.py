"""Ten versions of a positioning composite, each a builder from one table of shared inputs, run side by side.

``inputs`` derives the shared table once: the level (sum of the scoring
categories), the curve (mean over them of front less long), open interest, each
category, and each cell of category and instrument. A builder maps it to ``key,
date, value``; positive is crowded long. ``build_all`` writes each version's rows
to the shared folder, so one that fails, even while it runs, leaves the others
alone, and comparisons read what was written.

Windows are partitioned by key; recursions and small decompositions take one
group a key. Everything but the fits' training rows is causal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..session import written
from . import folds, latent, state_space
from .folds import _null, grouped, known


@dataclass
class Inputs:
    """The shared table ``key, date, level, curve, oi``, categories and cells; the names of the last two."""

    table: DataFrame
    key: str
    date: str
    categories: list[str]
    cells: list[str]
    extra: list[str] = field(default_factory=list)

    @property
    def window(self):
        return W.by(self.key, self.date)


def inputs(positions: DataFrame, key: str, date: str, instrument: str, category: str, net: str, oi: str, *, scoring: list[str], front: list[str], long: list[str], extra: DataFrame | None = None) -> Inputs:
    """From ``key, date, instrument, category, net, oi`` (one row each): open interest counts an instrument once; missing cells are null.

    ``extra``: further columns by key and date, such as a price.
    """
    n, i, c = F.col(net), F.col(instrument), F.col(category)
    of = lambda cond: F.sum(F.when(cond, n))
    once = positions.groupBy(key, date, instrument).agg(F.max(oi).alias("_oi")).groupBy(key, date).agg(F.sum("_oi").alias("oi"))
    tilt = [F.coalesce(of((c == k) & i.isin(front)), F.lit(0.0)) - F.coalesce(of((c == k) & i.isin(long)), F.lit(0.0)) for k in scoring]
    instruments = [*front, *[x for x in long if x not in front]]
    cells = {f"cell_{k}_{x}": of((c == k) & (i == x)) for k in scoring for x in instruments}
    wide = positions.groupBy(key, date).agg(
        F.coalesce(of(c.isin(scoring)), F.lit(0.0)).alias("level"), (sum(tilt[1:], tilt[0]) / len(tilt)).alias("curve"), *[F.coalesce(of(c == k), F.lit(0.0)).alias(f"cat_{k}") for k in scoring], *[e.alias(name) for name, e in cells.items()]
    )
    table = wide.join(once, [key, date])
    if extra is not None:
        table = table.join(extra, [key, date], "left")
    return Inputs(table, key, date, [f"cat_{k}" for k in scoring], list(cells), [x for x in (extra.columns if extra is not None else []) if x not in (key, date)])


def _out(d: DataFrame, inp: Inputs, value) -> DataFrame:
    return d.select(inp.key, inp.date, (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"))


def _components(d: DataFrame, inp: Inputs, xs: list[str], pick: str, share: float = 0.6) -> DataFrame:
    """``value``: a score of the columns scaled and decomposed on the first ``share`` of a key's complete rows.

    ``pick``: the first component; those with an eigenvalue above 1 (the first at
    least) weighted by it; or the largest whose first two loadings are opposed
    (else the second). All are signed to go with the columns' mean, the opposed
    one with its first column. Fewer than ten training rows give nulls.
    """

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.column_stack([known(pdf[x])[0] for x in xs])
        whole = np.flatnonzero(np.isfinite(z).all(axis=1))
        train = z[whole[: int(len(whole) * share)]]
        out = np.full(len(z), np.nan)
        if len(train) >= 10 and (train.std(axis=0) > 0).all():
            u = (z[whole] - train.mean(axis=0)) / train.std(axis=0)
            values, vectors = np.linalg.eigh(np.cov(u[: len(train)].T).reshape(len(xs), -1))
            values, vectors = values[::-1], vectors[:, ::-1]
            if pick == "opposed":
                opposed = [k for k in range(len(xs)) if vectors[0, k] * vectors[1, k] < 0]
                k = max(opposed, key=lambda j: values[j]) if opposed else min(1, len(xs) - 1)
                out[whole] = u @ vectors[:, k] * (1.0 if vectors[0, k] >= 0 else -1.0)
            else:
                kept = [k for k in range(len(xs)) if k == 0 or values[k] > 1] if pick == "kaiser" else [0]
                score = u @ vectors[:, kept]
                mean = u.mean(axis=1)
                sign = np.where((score * (mean - mean.mean())[:, None]).sum(axis=0) < 0, -1.0, 1.0)
                out[whole] = score @ (sign * values[kept]) / values[kept].sum()
        return pdf.assign(value=out)

    return _null(grouped(d.select(inp.key, inp.date, *xs), inp.key, inp.date, {"value": "double"}, f), "value")


def _production(inp: Inputs, p: dict) -> DataFrame:
    """Rolling z of each category, their first component, rolling z of that."""
    zs = [f"_z{k}" for k in range(len(inp.categories))]
    d = inp.table.select(inp.key, inp.date, *[W.rolling_z(c, inp.window, p["z"]).alias(z) for c, z in zip(inp.categories, zs, strict=True)])
    return _out(_components(d, inp, zs, "first"), inp, W.rolling_z("value", inp.window, p["z"]))


def _kaiser(inp: Inputs, p: dict) -> DataFrame:
    """Levels, changes and curve as z; components kept by Kaiser's rule and weighted."""
    w, cols = inp.window, {}
    for k, c in enumerate(inp.categories):
        cols |= {f"_l{k}": W.rolling_z(c, w, p["z"]), f"_f{k}": W.rolling_z(F.col(f"_d{k}"), w, p["z"])}
    d = inp.table.withColumns({f"_d{k}": W.change(c, w) for k, c in enumerate(inp.categories)})
    d = d.select(inp.key, inp.date, *[e.alias(n) for n, e in cols.items()], W.rolling_z("curve", w, p["z"]).alias("_c"))
    return _out(_components(d, inp, [*cols, "_c"], "kaiser"), inp, "value")


def _cot(inp: Inputs, p: dict) -> DataFrame:
    """Mean of the short and the long stochastic of the level, 0 to 100."""
    short, long = (W.cot_index("level", inp.window, n) for n in (p["short"], p["long"]))
    known_ = short.isNotNull().cast("int") + long.isNotNull().cast("int")
    mean = F.try_divide(F.coalesce(short, F.lit(0.0)) + F.coalesce(long, F.lit(0.0)), known_)
    return _out(inp.table, inp, F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean))))


def _ewma(inp: Inputs, p: dict) -> DataFrame:
    """Exponentially weighted z of the level and z of its flow, 0.7 and 0.3."""
    d = inp.table.select(inp.key, inp.date, "level").withColumn("_flow", W.change("level", inp.window, p["flow"]))
    d = d.withColumn("_fz", W.rolling_z("_flow", inp.window, p["short"]))
    return _out(folds.ewma_z(d, inp.key, inp.date, "level", p["halflife"], "_e"), inp, 0.7 * F.col("_e") + 0.3 * F.col("_fz"))


def _slope(inp: Inputs, p: dict) -> DataFrame:
    """The component of the categories that tilts one against another, as a rolling z."""
    return _out(_components(inp.table, inp, inp.categories, "opposed"), inp, W.rolling_z("value", inp.window, p["z"]))


def _kalman(inp: Inputs, p: dict) -> DataFrame:
    """Distance of the level from its filtered trend in its own trailing deviation; variances are presets of the level's."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = known(pdf["level"])
        base = float(np.var(v[at])) if at.any() else 0.0
        out = np.full(len(v), np.nan)
        if base > 0:
            level, _, _ = folds.trend_filter(v, *(base * s for s in p["variances"]))
            out = v - level
        return pdf.assign(_gap=out)

    d = _null(grouped(inp.table.select(inp.key, inp.date, "level"), inp.key, inp.date, {"_gap": "double"}, f), "_gap")
    frame, whole = W.frame(inp.window, p["short"]), W.Window.partitionBy(inp.key)
    sd = F.greatest(F.stddev_pop("_gap").over(frame), 1e-6 * F.stddev_pop("level").over(whole))
    return _out(d, inp, W.enough(F.col("_gap"), frame, W.half(p["short"]), F.when(sd > 0, F.col("_gap") / sd)))


def _roofing(inp: Inputs, p: dict) -> DataFrame:
    """The level's band between two cut-off periods, as a rolling z."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = known(pdf["level"])
        out = np.full(len(v), np.nan)
        if at.sum() > 3:
            out[at] = folds.roofing(v[at], *p["band"])
        return pdf.assign(_osc=out)

    d = _null(grouped(inp.table.select(inp.key, inp.date, "level"), inp.key, inp.date, {"_osc": "double"}, f), "_osc")
    return _out(d, inp, W.rolling_z("_osc", inp.window, p["z"]))


def _breadth(inp: Inputs, p: dict) -> DataFrame:
    """Mean of the z of level, flow, acceleration and the cells' signed breadth."""
    w = inp.window
    d = inp.table.withColumn("_flow", W.change("level", w, p["flow"]))
    d = d.withColumn("_accel", W.change("_flow", w, p["flow"])).withColumns({f"_z{k}": W.rolling_z(c, w, p["z"]) for k, c in enumerate(inp.cells)})
    signs = [F.when(F.abs(f"_z{k}") > 1, F.signum(f"_z{k}")).otherwise(0.0) for k in range(len(inp.cells))]
    d = d.withColumn("_breadth", sum(signs[1:], signs[0]) / len(signs))
    parts = [W.rolling_z(x, w, p["z"]) for x in ("level", "_flow", "_accel", "_breadth")]
    d = d.select(inp.key, inp.date, *[e.alias(f"_p{k}") for k, e in enumerate(parts)])
    return _out(d, inp, _mean([f"_p{k}" for k in range(4)]))


def _surprise(inp: Inputs, p: dict) -> DataFrame:
    """How surprising the level's last step is, signed: ranks of its squared residual and of the jump's size."""
    w = inp.window
    d = inp.table.select(inp.key, inp.date, "level", F.abs(W.change("level", w)).alias("_jump"), (F.col("level") - F.avg("level").over(W.frame(w, p["short"] // 2))).alias("_resid"))
    return _out(latent.surprise_blend(d, inp.key, inp.date, "_resid", ["_jump"], p["short"], p["short"]), inp, "blend")


def _factor(inp: Inputs, p: dict) -> DataFrame:
    """The signed surprise of one latent factor behind the categories and the curve, fitted by likelihood."""
    out = state_space.likelihood_factor(inp.table, inp.key, inp.date, [*inp.categories, "curve"], rounds=p["rounds"])
    return _out(out, inp, "deviation")


def _mean(cols: list[str]):
    known_ = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0))), known_)


def blend(versions: DataFrame, inp: Inputs, parts: list[str], window: int) -> DataFrame:
    """Mean of the parts' trailing mid-ranks, centred: what those say together that can be built."""
    ranks = versions.where(F.col("version").isin(parts)).withColumn("_r", W.mid_rank("value", W.by([inp.key, "version"], inp.date), window, W.half(window)))
    return ranks.groupBy(inp.key, inp.date).agg((F.avg("_r") - 0.5).alias("value"))


PARAMETERS = {"z": 156, "short": 52, "long": 156, "flow": 13, "halflife": 26, "band": (10.0, 48.0), "variances": folds.PRESETS["smooth"], "rounds": 60}
BUILDERS: dict[str, Callable[[Inputs, dict], DataFrame]] = {"v0": _production, "v1": _kaiser, "v2": _cot, "v3": _ewma, "v4": _slope, "v5": _kalman, "v6": _roofing, "v7": _breadth, "v8": _surprise, "v10": _factor}
#: What the ninth version blends.
BLENDED = ["v6", "v7", "v8"]
#: Versions on 0 to 100; the others have no bound.
BOUNDED = ["v2"]


def build_all(inp: Inputs, params: dict | None = None, builders: dict[str, Callable[[Inputs, dict], DataFrame]] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``version, key, date, value`` of all versions that can be built, ``v9`` among them, and why the others could not."""
    p, done, failed = PARAMETERS | (params or {}), None, {}
    for name, build in (BUILDERS if builders is None else builders).items():
        try:
            rows = written(build(inp, p).select(F.lit(name).alias("version"), inp.key, inp.date, "value"))
        except (PySparkException, ValueError, KeyError, ArithmeticError, np.linalg.LinAlgError) as e:
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
            continue
        done = rows if done is None else done.unionByName(rows)
    if done is None:
        raise ValueError(f"no version can be built: {failed}")
    parts = [v for v in BLENDED if v not in failed and (builders is None or v in builders)]
    if parts:
        ninth = blend(done, inp, parts, p["short"]).select(F.lit("v9").alias("version"), inp.key, inp.date, "value")
        done = done.unionByName(written(ninth))
    return done, failed


def comparable(versions: DataFrame) -> DataFrame:
    """``z``: values of bounded versions about their middle, 25 points as one deviation."""
    return versions.withColumn("z", F.when(F.col("version").isin(BOUNDED), (F.col("value") - 50) / 25).otherwise(F.col("value")))


def frontier(versions: DataFrame, inp: Inputs, prices: DataFrame, y: str, *, base: str = "v0", horizon: int = 8) -> DataFrame:
    """The scorecard of each key's versions: crossings, turns, half-life, rank correlation with the change of ``y`` ahead,
    its rank correlation given the base's (the added one), and ``best``: no other version of the key has both more turns and a higher hit proxy.
    """
    z = comparable(versions).join(prices.select(inp.key, inp.date, y), [inp.key, inp.date]).withColumn("_id", F.concat_ws("|", inp.key, "version"))
    card = latent.scorecard(z, "_id", inp.date, "z", y, horizon=horizon)
    names = z.select("_id", inp.key, "version").distinct()
    card = card.join(names, "_id").drop("_id")
    ahead = F.lead(y, horizon).over(inp.window) - F.col(y)
    outcome = prices.select(inp.key, inp.date, ahead.alias("_y"))
    zero = comparable(versions).where(F.col("version") == base).select(inp.key, inp.date, F.col("z").alias("_b"))
    # Plain correlations on common rows: what the version says beyond the base.
    both = comparable(versions).join(zero, [inp.key, inp.date]).join(outcome, [inp.key, inp.date]).where("z is not null and _b is not null and _y is not null")
    r = {n: F.corr(a, b) for n, (a, b) in {"zy": ("z", "_y"), "by": ("_b", "_y"), "zb": ("z", "_b")}.items()}
    added = F.when(F.abs(r["zb"]) < 1 - 1e-9, (r["zy"] - r["by"] * r["zb"]) / F.sqrt((1 - r["by"] ** 2) * (1 - r["zb"] ** 2)))
    card = card.join(both.groupBy(inp.key, "version").agg(added.alias("added")), [inp.key, "version"], "left")
    points = F.collect_list(F.struct("turns_per_yr", "hit")).over(W.Window.partitionBy(inp.key))
    beaten = F.exists(points, lambda q: (q["turns_per_yr"] > F.col("turns_per_yr")) & (q["hit"] > F.col("hit")))
    return card.withColumn("best", F.col("hit").isNotNull() & ~F.coalesce(beaten, F.lit(False)))
