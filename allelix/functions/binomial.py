"""Exact binomial tails from the regularised incomplete beta function, vectorised, for distinct (x, n) pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.asarray(x, float)).astype(float)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + b)


def incomplete_beta(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) by Lentz's continued fraction, from the side where it converges fast."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if x <= 0 or x >= 1:
        return np.full(a.shape, float(x >= 1))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(p)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    live = np.arange(len(p)) if p.ndim else np.array([0])
    for m in range(1, 20_000):
        pl, ql, yl = p[live], q[live], y[live]
        for top in (m * (ql - m) * yl / ((pl + 2 * m - 1) * (pl + 2 * m)), -(pl + m) * (pl + ql + m) * yl / ((pl + 2 * m) * (pl + 2 * m + 1))):
            dl, cl = 1 + top * d[live], 1 + top / c[live]
            d[live] = 1 / np.where(np.abs(dl) < tiny, tiny, dl)
            c[live] = np.where(np.abs(cl) < tiny, tiny, cl)
            step = d[live] * c[live]
            h[live] *= step
        live = live[np.abs(step - 1) > 1e-15]
        if not len(live):
            break
    with np.errstate(under="ignore"):
        value = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta(p, q)) / p * h
    return np.clip(np.where(turn, 1 - value, value), 0, 1)


def binom_tail(x, n, p: float, alternative: str = "greater") -> np.ndarray:
    """P(X >= x) or P(X <= x) for X ~ Binomial(n, p); null in, null out."""
    if alternative not in ("greater", "less"):
        raise ValueError("alternative must be greater or less")
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    x, n = np.asarray(x, float), np.asarray(n, float)
    known = ~(np.isnan(x) | np.isnan(n))
    if ((x < 0) | (x > n))[known].any():
        raise ValueError("x must be between 0 and n")
    out = np.full(x.shape, np.nan)
    sure = known & ((x == 0) if alternative == "greater" else (x == n))
    out[sure] = 1.0
    k = known & ~sure
    a, b = (x[k], n[k] - x[k] + 1) if alternative == "greater" else (x[k] + 1, n[k] - x[k])
    found = incomplete_beta(p, a, b)
    out[k] = found if alternative == "greater" else 1 - found
    return out


def binom_column(x: Column, n: Column, p: float, alternative: str = "greater") -> Column:
    """The tail as an Arrow-batched column; meant for distinct pairs."""

    @F.pandas_udf("double")
    def tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(binom_tail(a.astype(float), b.astype(float), p, alternative)).replace({np.nan: None}).astype(float)

    return tail(x.cast("double"), n.cast("double"))
