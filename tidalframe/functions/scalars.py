"""Scalar functions as column expressions: curves, bonds, lag weights, hazards, text, identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- yield curves and bonds -------------------------------------------------


def curve_loadings(tenor: Column | str, decay: float) -> dict[str, Column]:
    """Level, slope and curvature loadings of a three-factor curve; their limits at tenor 0."""
    t = _c(tenor) * decay
    slope = F.when(F.abs(t) < 1e-8, 1.0).otherwise((1 - F.exp(-t)) / t)
    return {"level": F.lit(1.0), "slope": slope, "curvature": F.when(F.abs(t) < 1e-8, 0.0).otherwise(slope - F.exp(-t))}


def decimal_yield(y: Column | str) -> Column:
    """A yield above 1 in size is in percent."""
    return F.when(F.abs(_c(y)) > 1, _c(y) / 100).otherwise(_c(y))


def par_bond(tenor: Column | str, y: Column | str, coupon: Column | str | None = None, frequency: int = 2, face: float = 1.0) -> dict[str, Column]:
    """Price, modified duration and value of a basis point of a bond (at par unless a coupon is given).

    Summed over the coupon dates in one expression; a bond has one date at least.
    """
    y = decimal_yield(y)
    c = y if coupon is None else decimal_yield(coupon)
    n = F.greatest(F.round(_c(tenor) * frequency), F.lit(1)).cast("int")
    dates, per = F.sequence(F.lit(1), n), 1 + y / frequency
    flow = lambda k: c / frequency + F.when(k == n, 1.0).otherwise(0.0)
    price = F.aggregate(dates, F.lit(0.0), lambda s, k: s + flow(k) / F.pow(per, k))
    timed = F.aggregate(dates, F.lit(0.0), lambda s, k: s + (k / frequency) * flow(k) / F.pow(per, k))
    duration = timed / price / per
    return {"price": price * face, "duration": duration, "dv01": price * face * duration * 1e-4}


def contract_dv01(tenor: Column | str, y: Column | str, notional: Column | str, fallback: float = 3.0) -> Column:
    """Value of a basis point of a contract; a missing yield counts as ``fallback`` percent."""
    return par_bond(tenor, F.coalesce(_c(y), F.lit(fallback)))["dv01"] * _c(notional)


def neutral_notional(notional: Column | str, dv01_a: Column | str, dv01_b: Column | str) -> Column:
    """The second leg's notional whose basis point offsets the first leg's."""
    return -_c(notional) * _c(dv01_a) / _c(dv01_b)


def duration_legs(signal: Column | str, markets: Column, target: float = 90.0, tilt: float = 0.35) -> dict[str, Column]:
    """Each market's share of the target duration, tilted between the legs by the signal.

    The halves of a market's budget move by ``signal * tilt``; rounding is half to even.
    """
    budget = F.lit(target) / markets
    short = budget / 2 * (1 + tilt * _c(signal))
    return {"total": budget, "leg5": F.bround(short, 1), "leg10": budget - F.bround(short, 1)}


# --- lag weights ------------------------------------------------------------


def _normalised(raw: Column) -> Column:
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raw, lambda v: v / total)


def beta_weights(k: int, a: Column | float, b: Column | float) -> Column:
    """Normalised beta-density weights over ``k`` lags."""
    a, b = (F.lit(v) if isinstance(v, (int, float)) else v for v in (a, b))
    grid = F.array(*[F.lit((i + 1) / (k + 1)) for i in range(k)])
    return _normalised(F.transform(grid, lambda u: F.pow(u, a - 1) * F.pow(1 - u, b - 1)))


def almon_weights(k: int, *coefficients: Column | float) -> Column:
    """Normalised exponential polynomial weights over lags 0..k-1."""
    cs = [F.lit(float(c)) if isinstance(c, (int, float)) else c for c in coefficients]

    def power(i: Column) -> Column:
        out = F.lit(0.0)
        for p, c in enumerate(cs, start=1):
            out = out + c * F.pow(i, F.lit(float(p)))
        return F.exp(out)

    return _normalised(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), power))


def polynomial_lags(lags: Column | str, k: int, degree: int) -> list[Column]:
    """Sums of lags times powers of the lag number (centred): an Almon design."""
    middle = (k - 1) / 2
    return [F.aggregate(F.zip_with(_c(lags), F.array(*[F.lit(float((i - middle) ** p)) for i in range(k)]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for p in range(degree + 1)]


def weighted(lags: Column | str, weights: Column) -> Column:
    return F.aggregate(F.zip_with(_c(lags), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def lag_slope(lags: Column | str, k: int) -> Column:
    """Least-squares slope over positions, position 0 being the newest."""
    middle = (k - 1) / 2
    scale = sum((i - middle) ** 2 for i in range(k))
    return weighted(lags, F.array(*[F.lit((i - middle) / scale) for i in range(k)]))


# --- hazards ----------------------------------------------------------------


def cloglog_inverse(eta: Column | str) -> Column:
    return 1 - F.exp(-F.exp(F.least(F.greatest(_c(eta), F.lit(-30.0)), F.lit(5.0))))


def expit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def shrink(rate: Column, n: Column, group_rate: Column, group_n: Column, overall: Column, k: float = 8.0) -> Column:
    """Two-level empirical Bayes blend; what is absent weighs nothing."""
    gn, n = F.coalesce(group_n, F.lit(0)), F.coalesce(n, F.lit(0))
    group = (gn * F.coalesce(group_rate, overall) + k * overall) / (gn + k)
    return (n * F.coalesce(rate, group) + k * group) / (n + k)


# --- text and identity --------------------------------------------------------


def plain_minus(s: Column | str) -> Column:
    """The mathematical minus sign as a hyphen, outer blanks gone."""
    return F.trim(F.translate(_c(s), "−", "-"))


#: Agency ratings from best to worst, as ordinals 1 to 22.
RATING_ORDER = [
    "AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C", "D",
]


def rating_notch(s: Column | str) -> Column:
    """Ordinal of the first word of a rating, null if it is none."""
    token = F.element_at(F.split(F.upper(plain_minus(s)), r"\s+"), 1)
    return F.create_map(*[F.lit(x) for k, v in enumerate(RATING_ORDER, start=1) for x in (v, k)])[token]


def fingerprint(*parts: Column | str) -> Column:
    """MD5 of the first part that is known."""
    return F.md5(F.coalesce(*[_c(p) for p in parts]))


def config_hash(**items: Column) -> Column:
    """Eight hex digits of the MD5 of the items as JSON in key order."""
    return F.substring(F.md5(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(items.items())]))), 1, 8)


def any_word(text: Column | str, words: list[str]) -> Column:
    """Whether any of ``words`` occurs in the lower-cased text."""
    low = F.lower(_c(text))
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def direction(text: Column | str, up: list[str], down: list[str]) -> Column:
    """+1, 0 or -1: substrings of ``up`` against word beginnings of ``down``."""
    low = F.lower(_c(text))
    ups = sum((F.regexp_count(low, F.lit(w)) for w in up), F.lit(0))
    downs = sum((F.regexp_count(low, F.lit(rf"\b{w}")) for w in down), F.lit(0))
    return F.signum((ups - downs).cast("double")).cast("int")


def word_score(text: Column | str, weights: dict[str, float], clip: float = 7.5) -> Column:
    """Sum of the words' weights for each word, times 100, clipped; 0 without words, null for a null text.

    The words are bound once by the outer lambda: without it the expression
    behind ``words`` would be evaluated for their number and again for their sum.
    """
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))
    known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])

    def score(words: Column) -> Column:
        held = F.filter(words, lambda w: w.isin(*weights))
        total = F.aggregate(held, F.lit(0.0), lambda s, w: s + known[w])
        return F.when(F.size(words) > 0, F.least(F.lit(clip), F.greatest(F.lit(-clip), total / F.size(words) * 100))).otherwise(0.0)

    return F.transform(F.array(found), score)[0]


def barometer(score: Column | str, clip: float = 7.5) -> Column:
    """A score in [-clip, clip] on 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + 50 * _c(score) / clip))


def ladder(x: Column | str, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first threshold that ``x`` reaches, thresholds falling."""
    out = F.lit(otherwise)
    for at, label in reversed(steps):
        out = F.when(_c(x) >= at, label).otherwise(out)
    return F.when(_c(x).isNotNull(), out)
