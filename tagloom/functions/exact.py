"""Exact tests and the functions they rest on, computed on Arrow batches in numpy: log gamma, incomplete gamma and beta functions, the complementary error function, and Fisher's exact test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The coefficients of Stirling's series for log gamma. Where a series or fraction ends.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
CLOSE, MOST_STEPS, TINY = 1e-15, 100_000, 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    x = np.asarray(x, float)
    # Moved up by 12 where the series is too short, and back by the product of the factors between.
    small = x < 12
    up = np.where(small, x + 12, x)
    between = np.zeros_like(up)
    for k in range(12):
        between += np.where(small, np.log(np.where(small, x + k, 1.0)), 0.0)
    inverse, term = 1 / up, 1 / up
    out = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi)
    for c in STIRLING:
        out += c * term
        term = term * inverse * inverse
    return out - between


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function; NaN where a <= 0 or x < 0."""
    return _gamma(a, x)[0]


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function, without loss where it is small."""
    return _gamma(a, x)[1]


def _gamma(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, x = np.broadcast_arrays(np.atleast_1d(np.asarray(a, float)), np.asarray(x, float))
    p, q = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    p[(a > 0) & (x == 0)], q[(a > 0) & (x == 0)] = 0.0, 1.0
    p[(a > 0) & np.isposinf(x)], q[(a > 0) & np.isposinf(x)] = 1.0, 0.0
    usable = (a > 0) & (x > 0) & np.isfinite(x) & np.isfinite(a)
    for low in (True, False):
        at = np.flatnonzero(usable & ((x < a + 1) == low))
        if not len(at):
            continue
        b, y = a[at], x[at]
        front = np.exp(-y + b * np.log(y) - log_gamma(b))
        if low:
            total, term, k = 1 / b, 1 / b, 0
            while k < MOST_STEPS and (np.abs(term) > np.abs(total) * CLOSE).any():
                k += 1
                term = term * y / (b + k)
                total = total + term
            p[at], q[at] = front * total, 1 - front * total
        else:
            upper = front * _fraction(lambda k: (np.ones_like(y) if k == 1 else -(k - 1) * (k - 1 - b), y + 2 * k - 1 - b), len(y))
            p[at], q[at] = 1 - upper, upper
    return p, q


def _fraction(terms, n: int) -> np.ndarray:
    """The continued fraction a1/(b1 + a2/(b2 + ...)) of n values, by forward steps of convergents' ratios; terms(k) gives a and b of step k."""
    value, c, d = np.full(n, TINY), np.full(n, TINY), np.zeros(n)
    for k in range(1, MOST_STEPS):
        a, b = terms(k)
        d = b + a * d
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + a / c
        c = np.where(np.abs(c) < TINY, TINY, c)
        step = c * d
        value = value * step
        if (np.abs(step - 1) < CLOSE).all():
            break
    return value


def beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function; NaN outside of a, b > 0 and 0 <= x <= 1."""
    a, b, x = (v.copy() for v in np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (a, b, x))))
    out = np.full(a.shape, np.nan)
    good = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[good & (x == 0)], out[good & (x == 1)] = 0.0, 1.0
    at = np.flatnonzero(good & (x > 0) & (x < 1))
    if not len(at):
        return out
    a, b, x = a[at], b[at], x[at]
    # The fraction is short on one side of the mean; the other side is its complement.
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a

    def terms(k: int):
        m = (k - 1) // 2
        if k == 1:
            up = np.ones_like(x)
        elif k % 2 == 0:
            m = k // 2 - 1
            up = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return up, np.ones_like(x)

    found = front * _fraction(terms, len(x))
    out[at] = np.where(turned, 1 - found, found)
    return out


def fisher_row(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float, float]:
    """The probability of a table, of its first cell being that small, that large, and of a table that is as unlikely (equal up to a ten-millionth)."""
    row, column, total = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    k = np.arange(max(0, row + column - total), min(row, column) + 1)
    if len(k) == 1:
        return 1.0, 1.0, 1.0, 1.0
    log = -sum(log_gamma(v + 1) for v in (k, row - k, column - k, total - row - column + k))
    # Relative to the likeliest table, so that nothing overflows; the rest of the product is the same for all.
    p = np.exp(log - log.max())
    p /= p.sum()
    own = p[n11 - k[0]]
    return float(own), min(1.0, float(p[k <= n11].sum())), min(1.0, float(p[k >= n11].sum())), min(1.0, float(p[p <= own * (1 + 1e-7)].sum()))


FISHER = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p", "left", "right", "two")])


def _udf(function, kind, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series(function(*(v.to_numpy(float) for v in values)))

    return run(*(c.cast("double") for c in columns))


def log_gamma_of(x: Column) -> Column:
    return _udf(lambda v: np.where(v > 0, log_gamma(np.where(v > 0, v, 1.0)), np.nan), "double", x)


def gamma_p_of(a: Column, x: Column) -> Column:
    return _udf(gamma_p, "double", a, x)


def gamma_q_of(a: Column, x: Column) -> Column:
    return _udf(gamma_q, "double", a, x)


def erfc_of(x: Column) -> Column:
    """The complementary error function: the upper gamma function of a half and the square."""
    return _udf(lambda v: np.where(v >= 0, gamma_q(0.5, v * v), 2 - gamma_q(0.5, v * v)), "double", x)


def beta_of(a: Column, b: Column, x: Column) -> Column:
    return _udf(beta, "double", a, b, x)


def fisher_of(n11: Column, n12: Column, n21: Column, n22: Column) -> Column:
    """A struct p, left, right, two; null where a count is missing or below 0."""

    @F.pandas_udf(FISHER)
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [fisher_row(*map(int, r)) if all(v == v and v >= 0 for v in r) else (None,) * 4 for r in zip(a, b, c, d, strict=True)]
        return pd.DataFrame(rows, columns=FISHER.names, dtype=float)

    known = F.least(n11, n12, n21, n22) >= 0
    for c in (n11, n12, n21, n22):
        known = known & c.isNotNull()
    return F.when(known, run(*(c.cast("double") for c in (n11, n12, n21, n22))))
