"""The robust envelope finds planted outliers that mask each other in a plain one."""

import random

import numpy as np
import pytest

from sparkclin.operators import robust as R


def _rows(n=1500, share=0.35, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i < share * n:  # a tight far cluster, which drags mean and covariance towards itself
            rows.append((i, 9 + rng.gauss(0, 0.3), -9 + rng.gauss(0, 0.3), 1))
        else:
            a = rng.gauss(0, 1)
            rows.append((i, a, 0.8 * a + rng.gauss(0, 0.5), 0))
    return rows


def test_planted_outliers_are_found(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id int, a double, b double, planted int").repartition(4)
    fit = R.mahalanobis_fit(df, ["a", "b"], 0.35)
    assert fit["mean"] == pytest.approx([0, 0], abs=0.15)
    assert fit["cov"] == pytest.approx(np.array([[1, 0.8], [0.8, 0.89]]), abs=0.2)
    out = R.mahalanobis_outliers(df, fit).collect()
    assert sum(r.is_adversarial and r.planted for r in out) >= 0.99 * sum(r.planted for r in out)
    # The plain estimate with one reweighting, at the same share, misses most of them: they mask each other.
    x, planted = np.array([[a, b] for _, a, b, _ in rows]), np.array([p for *_, p in rows], bool)

    def distances(part):
        diff = x - part.mean(axis=0)
        return np.einsum("ij,jk,ik->i", diff, np.linalg.inv(np.cov(part.T)), diff)
    d = distances(x)
    d = distances(x[d <= np.quantile(d, 0.65)])
    assert planted[d > np.quantile(d, 0.65)].sum() < 0.5 * planted.sum()


def test_rows_with_nulls_are_scored(spark):
    rows = [(i, a, b) for i, a, b, _ in _rows(400, 0.0)] + [(900, None, 0.1), (901, None, None), (902, None, -50.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = {r.id: r for r in R.mahalanobis_outliers(df, R.mahalanobis_fit(df, ["a", "b"])).collect()}
    assert len(out) == 403 and out[901].anomaly_score == 0.0
    assert not out[900].is_adversarial and out[902].is_adversarial
    with pytest.raises(ValueError):
        R.mahalanobis_fit(df.limit(0), ["a", "b"])


def test_constant_and_single_columns(spark):
    df = spark.createDataFrame([(float(i % 10), 3.0) for i in range(100)] + [(500.0, 3.0)], "a double, b double")
    out = R.mahalanobis_outliers(df, R.mahalanobis_fit(df, ["a", "b"], 0.01)).where("is_adversarial").collect()
    assert [r.a for r in out] == [500.0]
    out = R.mahalanobis_outliers(df, R.mahalanobis_fit(df, ["a"], 0.01)).where("is_adversarial").collect()
    assert [r.a for r in out] == [500.0]


def test_chi2_quantiles():
    assert R.chi2_quantile(0.975, 2) == pytest.approx(-2 * np.log(0.025))
    assert R.chi2_quantile(0.5, 1) == pytest.approx(0.454936423119572)
