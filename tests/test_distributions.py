"""Gamma and beta fits: stationary points of the likelihood, and distribution functions against numeric integrals."""

import math
import random

import numpy as np
import pytest

from sparkclin.operators import distributions as G
from sparkclin.operators.drift import FAMILIES, fit_distribution


def test_digamma_and_trigamma():
    assert G.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert G.digamma(0.5) == pytest.approx(-0.5772156649015329 - 2 * math.log(2), abs=1e-13)
    assert G.trigamma(1.0) == pytest.approx(math.pi ** 2 / 6, abs=1e-12)
    for x in (0.03, 0.7, 3.3, 42.0, 9000.0):
        h = 1e-5 * x
        assert G.digamma(x) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-6, abs=1e-6)
        assert G.trigamma(x) == pytest.approx((G.digamma(x + h) - G.digamma(x - h)) / (2 * h), rel=1e-5)


def _integral(f, lo, hi, n=200_001):
    x = np.linspace(lo, hi, n)
    y = f(x)
    h = (hi - lo) / (n - 1)
    return h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())  # Simpson


@pytest.mark.parametrize("k", [1.0, 2.5, 9.0, 150.0])
def test_gamma_integral(k):
    x = np.array([0.0, 0.1 * k, 0.7 * k, k, k + 1, 1.5 * k, 4 * k + 5])
    want = [_integral(lambda t: np.where(t > 0, np.exp((k - 1) * np.log(np.maximum(t, 1e-300)) - t - math.lgamma(k)), 1.0 if k == 1 else 0.0), 0, v)
            if v else 0.0 for v in x]
    assert G.gamma_cdf(x, k) == pytest.approx(want, abs=1e-9)
    assert G.gamma_cdf(np.array([2.0]), 1.0)[0] == pytest.approx(1 - math.exp(-2), abs=1e-14)
    assert G.gamma_cdf(np.array([0.5]), 0.5)[0] == pytest.approx(math.erf(math.sqrt(0.5)), abs=1e-14)  # chi-square of one degree


@pytest.mark.parametrize("a,b", [(1.0, 1.0), (2.0, 5.0), (7.5, 3.0), (80.0, 40.0)])
def test_beta_integral(a, b):
    x = np.array([0.0, 0.05, 0.3, 0.5, 0.66, 0.9, 1.0])
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    f = lambda t: np.exp(norm + (a - 1) * np.log(np.maximum(t, 1e-300)) + (b - 1) * np.log(np.maximum(1 - t, 1e-300)))
    assert G.beta_cdf(x, a, b) == pytest.approx([_integral(f, 0, v) if v else 0.0 for v in x], abs=1e-8)
    assert G.beta_cdf(np.array([0.25]), 0.5, 0.5)[0] == pytest.approx(2 / math.pi * math.asin(0.5), abs=1e-12)  # arcsine law


def test_fits_are_stationary():
    rng = random.Random(1)
    for k in (0.4, 3.0, 60.0):
        v = np.array([rng.gammavariate(k, 2.0) for _ in range(4000)])
        shape, scale = G.fit_gamma(v.mean(), np.log(v).mean())
        assert math.log(shape) - G.digamma(shape) == pytest.approx(math.log(v.mean()) - np.log(v).mean(), abs=1e-9)
        assert shape * scale == pytest.approx(v.mean()) and shape == pytest.approx(k, rel=0.1)
    for a, b in ((0.6, 0.9), (2.0, 5.0), (30.0, 11.0)):
        v = np.array([rng.betavariate(a, b) for _ in range(4000)])
        p, q = G.fit_beta(v.mean(), v.var(), np.log(v).mean(), np.log(1 - v).mean())
        assert G.digamma(p) - G.digamma(p + q) == pytest.approx(np.log(v).mean(), abs=1e-9)
        assert G.digamma(q) - G.digamma(p + q) == pytest.approx(np.log(1 - v).mean(), abs=1e-9)
        assert p == pytest.approx(a, rel=0.1)
    assert G.fit_gamma(3.0, math.log(3.0)) is None and G.fit_beta(0.5, 0.0, -1, -1) is None


def test_the_right_family_wins(spark):
    rng = random.Random(5)
    rows = [(rng.gammavariate(2.0, 3.0), rng.betavariate(2.0, 6.0) * 40 + 5, rng.gauss(-3, 2), rng.uniform(2, 9), 1 + rng.expovariate(0.2), 4.0)
            for _ in range(3000)]
    cols = ["gam", "bet", "nor", "uni", "expo", "same"]
    df = spark.createDataFrame([(*r, None) for r in rows] + [(None,) * 7], ", ".join(f"{c} double" for c in [*cols, "empty"])).repartition(5)
    got = {r.feature: r for r in fit_distribution(df, [*cols, "empty"]).collect()}
    assert set(got) == set(cols)
    assert [got[c].best_fit for c in ("gam", "nor")] == ["gamma", "normal"]
    assert got["bet"].d_beta < min(got["bet"][f"d_{f}"] for f in ("normal", "exponential", "uniform")) and got["bet"].p_beta > 0.05
    assert got["uni"].p_uniform > 0.05 and got["expo"].p_exponential > 0.05
    assert got["nor"].d_gamma is None and got["nor"].p_gamma is None  # values that aren't all positive
    assert all(got["same"][f"d_{f}"] is None for f in FAMILIES) and got["same"].best_fit is None
    v = np.sort([r[0] for r in rows])
    shape, scale = G.fit_gamma(v.mean(), np.log(v).mean())
    f, n = G.gamma_cdf(v / scale, shape), len(v)
    d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    assert got["gam"].d_gamma == pytest.approx(d, abs=1e-9)
    lam = math.sqrt(n) * d
    assert got["gam"].p_gamma == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)), abs=1e-9)
    assert fit_distribution(df.limit(0), cols).count() == 0
