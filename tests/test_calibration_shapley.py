"""Cross-fitted calibration and sampled Shapley values."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclin.operators import calibration as C
from sparkclin.operators import model as E
from sparkclin.operators import shapley as S


def _isotonic(points):
    """Blocks by the max-min formula over distinct scores: score -> value."""
    by = {}
    for x, y in points:
        by.setdefault(x, []).append(y)
    xs = sorted(by)
    mean = lambda j, k: sum(sum(by[x]) for x in xs[j:k + 1]) / sum(len(by[x]) for x in xs[j:k + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("parts", [1, 5, 20])
def test_isotonic_blocks_against_the_formula(spark, parts):
    rng = random.Random(parts)
    points = [(rng.randint(0, 40) / 40, int(rng.random() < 0.3 + 0.4 * rng.random())) for _ in range(400)]
    points += [(x / 40, int(rng.random() < x / 40)) for x in range(41) for _ in range(5)]
    df = spark.createDataFrame(points + [(None, 1), (0.5, None)], "score double, target int").repartition(6)
    blocks = C.isotonic_blocks(df, parts=parts).orderBy("lo").collect()
    want = _isotonic(points)
    assert [b.value for b in blocks] == sorted({b.value for b in blocks})
    for x, value in want.items():
        assert [b.value for b in blocks if b.lo <= x <= b.hi] == pytest.approx([value])
    assert sum(b.weight for b in blocks) == len(points)
    out = C.apply_isotonic(spark.createDataFrame([(-1.0,), (0.4875,), (2.0,), (None,)], "score double"), C.isotonic_blocks(df, parts=parts)).collect()
    at, v = [x for b in blocks for x in (b.lo, b.hi)], [b.value for b in blocks for _ in range(2)]
    assert [r.calibrated for r in out] == [pytest.approx(x) for x in np.interp([-1.0, 0.4875, 2.0], at, v)] + [None]


def test_pooling_is_associative():
    rng = np.random.default_rng(3)
    x, t = np.arange(200.0), rng.integers(0, 2, 200).astype(float)
    whole = C.pool(x, x, t, np.ones(200))
    for cut in (1, 37, 120, 199):
        halves = [C.pool(x[s], x[s], t[s], np.ones(len(x[s]))) for s in (slice(None, cut), slice(cut, None))]
        for a, b in zip(whole, C.pool(*(np.concatenate(v) for v in zip(*halves)))):
            assert a == pytest.approx(b)


def test_isotonic_of_nothing_and_of_one_class(spark):
    schema = "score double, target int"
    assert C.isotonic_blocks(spark.createDataFrame([], schema)).count() == 0
    one = C.isotonic_blocks(spark.createDataFrame([(0.1, 1), (0.9, 1)], schema)).collect()
    assert [(b.lo, b.hi, b.value, b.weight) for b in one] == [(0.1, 0.9, 1.0, 2.0)]


def _patients(spark, n=1200):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((f"p{i:05}", a, b, float(rng.random() < 1 / (1 + np.exp(-(1.5 * a - b))))))
    return spark.createDataFrame(rows, "id string, a double, b double, target double")


def test_rows_are_scored_by_the_model_that_has_not_seen_them(spark):
    seen = []

    def train(d):
        seen.append({r.id for r in d.select("id").collect()})
        return E.train_logistic(d, ["a", "b"])

    scores, models = C.out_of_fold_scores(_patients(spark), ["a", "b"], "target", "id", train, 4)
    rows = scores.collect()
    assert len(rows) == 1200 and len(models) == 4
    for r in rows:
        assert r.id not in seen[r.fold]
        m = models[r.fold]
        z = m.intercept + m.coefficients[0] * r.a + m.coefficients[1] * r.b
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
    forest, _ = C.out_of_fold_scores(_patients(spark), ["a", "b"], "target", "id", lambda d: E.train_forest(d, ["a", "b"], n_trees=4, max_depth=3), 3)
    assert forest.count() == 1200 and forest.where("score is null or score < 0 or score > 1").count() == 0


def test_sigmoid_is_the_likelihood_maximum(spark):
    rng = random.Random(2)
    rows = [(i % 3, s, int(rng.random() < 1 / (1 + np.exp(-(4 * s - 1 - i % 3))))) for i in range(900) for s in [rng.random()]]
    df = spark.createDataFrame(rows, "fold int, score double, target int")
    fits = {None: C.fit_sigmoids(df).first(), **{r.fold: r for r in C.fit_sigmoids(df, by_fold=True).collect()}}
    assert set(fits) == {None, 0, 1, 2}
    for fold, f in fits.items():
        x, y = (np.array(v, float) for v in zip(*[(s, t) for g, s, t in rows if fold is None or g == fold]))
        p = 1 / (1 + np.exp(-(f.slope * x + f.intercept)))
        assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-6  # the gradient vanishes


def _shapley(predict, x, base):
    """Exact values over all orders, against the mean over the background."""
    d, out = len(x), np.zeros(len(x))
    orders = list(itertools.permutations(range(d)))
    for order in orders:
        states = base.copy()
        before = predict(states).mean()
        for f in order:
            states[:, f] = x[f]
            after = predict(states).mean()
            out[f] += after - before
            before = after
    return out / len(orders)


def test_shares_are_exact_for_a_linear_margin_and_near_for_a_probability(spark):
    df = _patients(spark, 200).withColumn("c", F.col("a") * 2 - F.col("b"))
    cols, bg = ["a", "b", "c"], df.orderBy("id").limit(60)
    base = np.array([[r.a, r.b, r.c] for r in bg.collect()])
    linear = S.linear_predictor([0.5, -2.0, 1.0], 3.0, margin=True)
    rows = {(r.id, r.feature): r.contribution for r in S.explain_sampled(linear, df, bg, cols, "id", n_perm=1).collect()}
    assert len(rows) == 600
    for r in df.collect():
        for j, (c, w) in enumerate(zip(cols, (0.5, -2.0, 1.0))):
            assert rows[r.id, c] == pytest.approx(w * (r[c] - base[:, j].mean()), abs=1e-9)
    sigmoid = S.linear_predictor([0.5, -2.0, 1.0], 0.2)
    rows = {(r.id, r.feature): r.contribution for r in S.explain_sampled(sigmoid, df, bg, cols, "id", n_perm=12).collect()}
    for r in df.limit(20).collect():
        want = _shapley(sigmoid, np.array([r.a, r.b, r.c]), base)
        got = np.array([rows[r.id, c] for c in cols])
        assert got.sum() == pytest.approx(want.sum(), abs=1e-9)
        assert got == pytest.approx(want, abs=0.08)


def test_predictors_equal_the_fitted_models(spark):
    from pyspark.ml.functions import vector_to_array
    d = _patients(spark, 600)
    for m in (E.train_logistic(d, ["a", "b"]), E.train_forest(d, ["a", "b"], n_trees=5, max_depth=4),
              E.train_boosted(d, ["a", "b"], max_iter=5, max_depth=3)):
        rows = m.transform(E.assemble(d, ["a", "b"])).select("a", "b", vector_to_array("probability")[1].alias("p")).collect()
        got = S.model_predictor(m)(np.array([[r.a, r.b] for r in rows]))
        assert got == pytest.approx([r.p for r in rows], abs=1e-9)


def test_shares_of_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "id int, a double, b double")
    rows = {(r.id, r.feature): r.contribution for r in S.explain_sampled(S.linear_predictor([1.0, 1.0], margin=True), df, df, ["a", "b"], "id").collect()}
    assert rows == {(1, "a"): None, (1, "b"): None, (2, "a"): 0.0, (2, "b"): 0.0} or rows[2, "a"] == 0.0
    assert S.explain_sampled(S.linear_predictor([1.0, 1.0]), df.limit(0), df, ["a", "b"], "id").count() == 0
