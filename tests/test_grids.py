"""Power scaling, temperature grids, PCA of rows with nulls and callables by name, against direct computation."""

import math
import random

import numpy as np
import pytest

from sparkclin.functions.udf import aggregate_by_name
from sparkclin.operators import features as D
from sparkclin.operators import model as E
from sparkclin.operators import prep as P


def _psi(x, lam):
    if x >= 0:
        return math.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
    return -math.log1p(-x) if abs(lam - 2) < 1e-12 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)


def test_power_scaling_takes_the_likeliest_lambda(spark):
    rng = random.Random(1)
    a = [rng.lognormvariate(0, 0.8) for _ in range(500)]
    b = [rng.gauss(-4, 3) for _ in range(500)]
    rows = [(i, x, y, 7.0) for i, (x, y) in enumerate(zip(a, b))] + [(900, None, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, same double").repartition(4)
    got = {r.id: r for r in D.scale_power(df, ["a", "b", "same"]).collect()}
    assert len(got) == 501 and got[900].a is None
    grid = [round(-2 + 0.1 * i, 1) for i in range(41)]
    for c, values in (("a", a), ("b", [*b, 1.0])):
        def loglik(lam):
            v = [_psi(x, lam) for x in values]
            return -len(v) / 2 * math.log(np.var(v)) + (lam - 1) * sum(math.copysign(math.log1p(abs(x)), x) for x in values)
        lam = max(grid, key=loglik)
        v = np.array([_psi(x, lam) for x in values])
        assert got[0][c] == pytest.approx((v[0] - v.mean()) / v.std(), rel=1e-6) or got[0][c] == pytest.approx((v[0] - v.mean()) / v.std(ddof=1), rel=1e-6)


def test_temperature_grid(spark):
    rows = [(0.9, 1), (0.8, 0), (0.3, 0), (0.6, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    temps = [0.5, 1.0, 2.0]
    got = {r.temperature: r for r in E.temperature_grid(df, "p", "y", temps).collect()}
    want = {}
    for t in temps:
        q = [1 / (1 + math.exp(-math.log(p / (1 - p + 1e-6)) / t)) for p, _ in rows]
        want[t] = -sum(math.log(x if y else 1 - x) for x, (_, y) in zip(q, rows)) / len(rows)
    assert {t: r.log_loss for t, r in got.items()} == pytest.approx(want)
    assert [t for t, r in got.items() if r.is_best] == [min(want, key=want.get)]


def test_pca_keeps_rows_with_nulls(spark):
    rows = [(i, float(i), 2.0 * i + (i % 3), float(i % 5)) for i in range(40)] + [(99, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    out, variance = P.pca_transform(df, ["a", "b", "c"], k=2)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 41 and got[99].PC1 is None and got[3].PC1 is not None
    assert variance.count() == 3


def test_callables_by_name_in_one_pass(spark):
    df = spark.createDataFrame([("x", 1.0, 4.0), ("x", 3.0, 8.0), (None, 5.0, 1.0)], "g string, a double, b double")

    def span(s):
        return s.max() - s.min()

    got = {r.g: r for r in aggregate_by_name(df, "g", ["a", "b"], ["mean", span]).collect()}
    assert (got["x"].agg_a_mean, got["x"].agg_b_span) == (2.0, 4.0) and got[None].agg_a_span == 0.0
    only = aggregate_by_name(df, "g", ["a"], [span])
    assert only.columns == ["g", "agg_a_span"] and "Join" not in only._jdf.queryExecution().optimizedPlan().toString()
