"""The random search: 50 points of its grid, each fitted and scored in all of five folds."""

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from sparkclin.operators import model as E
from sparkclin.operators import search as S
from sparkclin.plans.catalog_model import q_random_search_cv


def _orders(spark, path, n=200):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, (i * 37) % 91, "O", 10.0 * i, day + datetime.timedelta(days=i % 30), "1-URGENT") for i in range(n)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                                "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return str(path)


def _rows(spark, n=120, noise=60):
    x = [(f"p{i}", float((i * 37) % 101), float((i * 53) % 89), 1.0) for i in range(n)]
    d = spark.createDataFrame(x, "id string, a double, b double, unit double")
    mixed = F.col("a") + F.col("b") / 2 + (F.pmod(F.xxhash64("id"), F.lit(noise)) if noise else F.lit(30.0))
    return d.withColumn("target", (mixed > 100).cast("double"))


def test_random_search_fits_fifty_points_in_five_folds(spark, tmp_path, monkeypatch):
    seen, recalls = [], S.recalls_together

    def spy(rows, cols, target, points, k):
        found = recalls(rows, cols, target, points, k)
        seen.append((points, k, {r["fold"] for r in rows.select("fold").collect()}, rows.count(), found))
        return found

    monkeypatch.setattr(S, "recalls_together", spy)
    out = q_random_search_cv(spark, _orders(spark, tmp_path)).collect()
    (points, k, folds, n, found), = seen
    assert (k, folds, n) == (5, set(range(5)), 200)
    assert len({tuple(sorted(p.items())) for p in points}) == len(points) == 50
    assert {p["weightCol"] for p in points} == {"weight", "unit"}
    assert {p["elasticNetParam"] for p in points} == {0.0, 0.5, 1.0}
    assert {round(1 / (p["regParam"] * 160), 9) for p in points if p["regParam"] not in (0.0, 0.01, 0.1)} == {0.001, 0.01, 0.1, 1, 10, 100}
    assert found.shape == (50, 5)
    assert [tuple(r) for r in out] == [(i, pytest.approx(m)) for i, m in enumerate(found.mean(axis=1))]


def test_every_fold_is_held_out_once(spark):
    cv = E.grid_search_cv(_rows(spark), ["a", "b"], k=5, grid={"regParam": [0.0, 0.1]}, parallelism=2)
    assert cv.getNumFolds() == 5 and len(cv.avgMetrics) == 2
    assert all(0.5 < m <= 1 for m in cv.avgMetrics)


def test_models_fitted_together_are_those_of_single_fits(spark):
    d = _rows(spark).withColumn("flat", F.lit(7.0))
    cols = ["a", "b", "flat"]
    folds = E.stratified_folds(E._weighted(d, "target", cols, "weight"), "target", "id", 3).localCheckpoint()
    points = [{"regParam": r, "elasticNetParam": a, "weightCol": w} for r, a, w in
              [(0.0, 0.0, "unit"), (0.05, 0.0, "weight"), (0.05, 0.5, "unit"), (0.1, 1.0, "weight"), (9.0, 1.0, "unit")]]
    theta, centre, scale, positives = S.fit_together(folds, cols, "target", points, 3)
    for i, p in enumerate(points):
        for f in range(3):
            one = LogisticRegression(featuresCol="features", labelCol="target", tol=1e-12, maxIter=1000, **p).fit(folds.where(F.col("fold") != f))
            coef = theta[i, f, 1:] / scale
            assert coef == pytest.approx(one.coefficients.toArray(), abs=1e-5)
            assert theta[i, f, 0] - np.nan_to_num(coef * centre).sum() == pytest.approx(one.intercept, abs=1e-4)
    assert positives.sum() == d.where("target = 1").count()


def test_search_together_scores_and_refits_as_cross_validation(spark):
    d, grid = _rows(spark), {"regParam": [0.01, 1.0], "elasticNetParam": [0.0, 1.0]}
    one = E.grid_search_cv(d, ["a", "b"], k=3, grid=grid, parallelism=2)
    all_ = E.grid_search_cv(d, ["a", "b"], k=3, grid=grid, together=True)
    assert all_.avgMetrics == pytest.approx(one.avgMetrics)
    assert all_.stdMetrics == pytest.approx(one.stdMetrics)
    assert all_.bestModel.coefficients.toArray() == pytest.approx(one.bestModel.coefficients.toArray(), rel=1e-6)


def test_search_together_on_separable_and_one_sided_rows(spark):
    apart = E.grid_search_cv(_rows(spark, noise=0), ["a", "b"], k=3, grid={"regParam": [0.0]}, together=True)
    assert apart.avgMetrics[0] > 0.9
    d = _rows(spark, 30).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int"))
    for label, recall in ((1.0, 1.0), (0.0, 0.0)):
        got = S.recalls_together(d.withColumn("target", F.lit(label)), ["a", "b"], "target", [{"weightCol": "unit"}], 3)
        assert got.tolist() == [[recall] * 3]
    with pytest.raises(ValueError):
        S.recalls_together(d.withColumn("a", F.when(F.col("a") > 50, F.col("a"))), ["a", "b"], "target", [{"weightCol": "unit"}], 3)
    with pytest.raises(ValueError):
        E.grid_search_cv(_rows(spark), ["a", "b"], k=3, estimator="forest", together=True)
