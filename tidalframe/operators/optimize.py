"""Small optimisers and distribution functions in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], start, steps: int = 400, size: float = 0.5, tol: float = 1e-9) -> np.ndarray:
    """Downhill simplex with the usual coefficients."""
    start = np.asarray(start, float)
    simplex = [start] + [start + size * (abs(start[k]) if start[k] else 1.0) * np.eye(len(start))[k] for k in range(len(start))]
    value = [f(p) for p in simplex]
    for _ in range(steps):
        order = np.argsort(value, kind="stable")
        simplex, value = [simplex[k] for k in order], [value[k] for k in order]
        if abs(value[-1] - value[0]) <= tol * (abs(value[0]) + tol):
            break
        middle = np.mean(simplex[:-1], axis=0)
        away = middle + (middle - simplex[-1])
        fa = f(away)
        if fa < value[0]:
            far = middle + 2 * (middle - simplex[-1])
            ff = f(far)
            simplex[-1], value[-1] = (far, ff) if ff < fa else (away, fa)
        elif fa < value[-2]:
            simplex[-1], value[-1] = away, fa
        else:
            near = middle + 0.5 * ((away if fa < value[-1] else simplex[-1]) - middle)
            fn = f(near)
            if fn < min(fa, value[-1]):
                simplex[-1], value[-1] = near, fn
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                value = [value[0]] + [f(p) for p in simplex[1:]]
    return simplex[int(np.argmin(value))]


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail by the series or the continued fraction of the incomplete gamma."""
    if x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
