"""H3: gamma and beta fits from sufficient statistics, and their distribution functions over arrays.

Likelihood fits need only a few sums per column (mean, mean logarithms), which Spark aggregates; Newton's steps then run on one
row a column. The distribution functions (incomplete gamma and beta integrals) are evaluated in Arrow batches over the
table of distinct values.
"""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-300


def digamma(x: float) -> float:
    """ψ(x): the recurrence up to 10, then the asymptotic series (Abramowitz–Stegun 6.3.18)."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    """ψ′(x): the recurrence up to 10, then the asymptotic series (Abramowitz–Stegun 6.4.12)."""
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def fit_gamma(mean: float | None, mean_log: float | None) -> tuple[float, float] | None:
    """(shape, scale) of the two-parameter likelihood maximum; None for constant or non-positive data."""
    if mean is None or mean_log is None or mean <= 0:
        return None
    s = math.log(mean) - mean_log
    if not s > 1e-12:
        return None
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(100):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        k = k - step if step < k else k / 2
        if abs(step) <= 1e-13 * k:
            break
    return k, mean / k


def fit_beta(mean: float, var: float, mean_log: float, mean_log1: float) -> tuple[float, float] | None:
    """(a, b) of the likelihood maximum on (0, 1), by Newton from the moments; None for constant data."""
    if not 0 < mean < 1 or not var > 1e-15:
        return None
    t = max(mean * (1 - mean) / var - 1, 1e-3)
    a, b = mean * t, (1 - mean) * t
    for _ in range(200):
        both, slope = digamma(a + b), trigamma(a + b)
        g, h = digamma(a) - both - mean_log, digamma(b) - both - mean_log1
        aa, bb = trigamma(a) - slope, trigamma(b) - slope
        det = aa * bb - slope * slope
        da, db = (g * bb + h * slope) / det, (h * aa + g * slope) / det
        a, b = (a - da if da < a else a / 2), (b - db if db < b else b / 2)
        if abs(da) <= 1e-12 * a and abs(db) <= 1e-12 * b:
            break
    return a, b


def gamma_cdf(x: np.ndarray, shape: float) -> np.ndarray:
    """P(shape, x), the regularised lower incomplete gamma integral: power series below shape + 1, else the continued fraction."""
    x = np.asarray(x, float)
    out = np.where(x > 0, 1.0, 0.0)
    scale = np.exp(np.where(x > 0, shape * np.log(np.maximum(x, TINY)) - x, -np.inf) - math.lgamma(shape))
    low = np.flatnonzero((x > 0) & (x < shape + 1))
    term = total = np.full(len(low), 1 / shape)
    n = shape
    while len(low) and np.any(term > 1e-17 * total):
        n += 1
        term = term * x[low] / n
        total = total + term
    out[low] = total * scale[low]
    high = np.flatnonzero((x >= shape + 1) & np.isfinite(x))
    if len(high):
        b = x[high] + 1 - shape
        c, d = np.full(len(high), 1 / TINY), 1 / b
        h = d
        for i in range(1, 100_000):
            an = -i * (i - shape)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < TINY, TINY, an * d + b)
            c = np.where(np.abs(b + an / c) < TINY, TINY, b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[high] = 1 - scale[high] * h
    return out


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """I_x(a, b), the regularised incomplete beta integral, by its continued fraction on the side where that converges."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    front = np.exp(p * np.log(np.maximum(z, TINY)) + q * np.log(np.maximum(1 - z, TINY)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    guard = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
    h = d
    for m in range(1, 100_000):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    part = np.where(z > 0, front * h / p, 0.0)
    return np.where(swap, 1 - part, part)
