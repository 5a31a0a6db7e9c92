"""Outliers by Mahalanobis distance from a robust mean and covariance (minimum covariance determinant).

Of all halves of the rows, the one whose covariance has the least determinant holds no outliers, as long as fewer than half of
the rows are. It is sought as published (FAST-MCD): many small starts on a bounded sample, of which the best go on with
concentration steps over all rows. A step keeps the ``support`` share of rows nearest under the present estimate (an exact
distributed order statistic, for all candidates in one pass) and takes their moments (one aggregate), which never raises
the determinant. The fit is d x d constants, and a row's score one expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import column_quantiles, q
from sparkclin.operators.distributions import gamma_cdf
from sparkclin.session import stored

SAMPLE = 2000   # rows on which starts are tried
STARTS = 100    # random starts on the sample
FULL = 4        # starts that go on over all rows
ROUNDS = 30


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1.0
    while gamma_cdf(np.array([hi / 2]), d / 2)[0] < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_cdf(np.array([mid / 2]), d / 2)[0] < p else (lo, mid)
    return hi


def _distance(cols: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Squared distance; a null field adds nothing, so a row keeps a score from the fields that it has."""
    x = [F.coalesce(F.col(q(c)).cast("double") - float(mean[i]), F.lit(0.0)) for i, c in enumerate(cols)]
    out = F.lit(0.0)
    for i in range(len(cols)):
        for j in range(len(cols)):
            out = out + F.lit(float(inverse[i, j])) * x[i] * x[j]
    return out


def _log_det(cov: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(cov)
    return value if sign > 0 else -np.inf


def _starts(sample: np.ndarray, support: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best (mean, covariance) of two concentration steps on the sample from random subsets of d + 1 rows."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    h, found = min(n, max(d + 1, int(np.ceil(support * n)))), []
    for _ in range(STARTS):
        rows = rng.choice(n, min(n, d + 1), replace=False)
        for _ in range(3):
            mean, cov = sample[rows].mean(axis=0), np.atleast_2d(np.cov(sample[rows].T, bias=True))
            diff = sample - mean
            dist = np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(cov), diff)
            rows = np.argsort(dist, kind="stable")[:h]
        mean, cov = sample[rows].mean(axis=0), np.atleast_2d(np.cov(sample[rows].T, bias=True))
        found.append((_log_det(cov), len(found), mean, cov))
    found.sort(key=lambda x: x[:2])
    return [(m, c) for _, _, m, c in found[:FULL]]


def _apart(fits: list[tuple[np.ndarray, np.ndarray]], moving: list[int]) -> list[int]:
    """Those of ``moving`` that are no earlier fit again: equal up to the rounding of sums."""
    return [s for s in moving if not any(all(np.allclose(x, y, rtol=1e-12, atol=0) for x, y in zip(fits[s], fits[t])) for t in range(s))]


def _moments(rows: DataFrame, cols: list[str], centre: np.ndarray, keep: list[Column]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the rows kept by each condition, all in one aggregate, about a common centre."""
    x = [F.col(q(c)) - float(centre[i]) for i, c in enumerate(cols)]
    d, aggs = len(cols), []
    for s, k in enumerate(keep):
        aggs.append(F.count_if(k).alias(f"n{s}"))
        aggs += [F.sum(F.when(k, x[i])).alias(f"s{s}_{i}") for i in range(d)]
        aggs += [F.sum(F.when(k, x[i] * x[j])).alias(f"p{s}_{i}_{j}") for i in range(d) for j in range(i, d)]
    r = rows.agg(*aggs).first()
    out = []
    for s in range(len(keep)):
        n = max(1, r[f"n{s}"])
        mean = np.array([r[f"s{s}_{i}"] or 0.0 for i in range(d)]) / n
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = (r[f"p{s}_{i}_{j}"] or 0.0) / n - mean[i] * mean[j]
        out.append((mean + centre, cov))
    return out


def mahalanobis_fit(ref: DataFrame, cols: list[str], contamination: float = 0.01, support: float = 0.5, seed: int = 42) -> dict:
    """C10 fit on the complete rows of ``ref``; the cut is the exact (1 − contamination) quantile of their distances."""
    rows = stored(ref.select(*[F.col(q(c)).cast("double").alias(c) for c in cols]).dropna(), "envelope")
    drawn = rows.orderBy(F.xxhash64(*[F.col(q(c)) for c in cols])).limit(SAMPLE).collect()  # bounded
    if not drawn:
        raise ValueError("no complete row to fit on")
    sample = np.array([list(r) for r in drawn])
    centre, d = np.median(sample, axis=0), len(cols)
    best = _starts(sample, support, seed)
    now = [np.inf] * len(best)
    moving = _apart(best, list(range(len(best))))
    for _ in range(ROUNDS):  # a start that no longer moves, or has met another, isn't measured again
        dist = [_distance(cols, best[s][0], np.linalg.pinv(best[s][1])) for s in moving]
        measured = rows.select("*", *[x.alias(f"__d{i}") for i, x in enumerate(dist)])
        names = [f"__d{i}" for i in range(len(dist))]
        cuts = column_quantiles(measured.select(*names), names, [support]).first()
        found = _moments(measured, cols, centre, [F.col(n) <= F.lit(float(cuts[i][0])) for i, n in enumerate(names)])
        left = []
        for s, fit in zip(moving, found):
            before, best[s], now[s] = now[s], fit, _log_det(fit[1])
            if not (before == now[s] or abs(before - now[s]) < 1e-9):
                left.append(s)
        moving = _apart(best, left)
        if not moving:
            break
    mean, cov = best[int(np.argmin(now))]
    # Scaled so that the middle distance is that of a normal sample, then reweighted once as published.
    dist = _distance(cols, mean, np.linalg.pinv(cov))
    middle = column_quantiles(rows.select(dist.alias("d")), ["d"], [0.5]).first()[0][0]
    if middle > 0:
        limit = chi2_quantile(0.975, d) * middle / chi2_quantile(0.5, d)
        mean, cov = _moments(rows, cols, centre, [dist <= F.lit(float(limit))])[0]
    inverse = np.linalg.pinv(cov)
    dist = _distance(cols, mean, inverse)
    cut = column_quantiles(rows.select(dist.alias("d")), ["d"], [1 - contamination]).first()[0][0]
    return {"cols": cols, "mean": mean, "cov": cov, "inv": inverse, "cut": cut, "dist": dist}


def mahalanobis_outliers(df: DataFrame, fitted: dict) -> DataFrame:
    """C10 apply: every row with its squared distance and whether that is above the fitted cut."""
    d = fitted["dist"]
    return df.select("*", d.alias("anomaly_score"), (d > F.lit(float(fitted["cut"]))).alias("is_adversarial"))
