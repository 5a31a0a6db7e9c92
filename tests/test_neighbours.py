"""The exact k-NN join and k-NN imputation against brute force."""

import math
import random

import numpy as np
import pytest

from sparkclin.operators import neighbours as N
from sparkclin.operators.balance import knn


def _distance(v, w):
    """Added up one after another, as row-wise engines do; sum() of Python compensates its rounding."""
    total = 0.0
    for a, b in zip(v, w):
        total += (a - b) * (a - b)
    return math.sqrt(total)


def _brute(queries, points, k):
    """id -> [(neighbour, distance)] of (id, vector) lists."""
    out = {}
    for i, v in queries:
        d = sorted((_distance(v, w), j) for j, w in points if j != i)
        out.setdefault(i, []).extend((j, x) for x, j in d[:k])
    return out


def _got(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.neighbour, r.distance))
    return out


def _frame(spark, rows, space=0):
    return spark.createDataFrame([(space, i, v) for i, v in rows], "space int, id long, vec array<double>").repartition(5)


def test_tree_search_finds_every_leaf_within_reach():
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(3000, 3)) * [1, 5, 20])
    dims, cuts = N.fit_tree(points, 6, 8)
    leaf = N.leaf_of((dims, cuts), points)
    sizes = np.bincount(leaf)
    assert len(sizes) > 32 and sizes[sizes > 0].min() >= 8
    asked = points[:50] + 0.25
    bound = rng.uniform(0, 30, 50)
    row, found = N.leaves_within((dims, cuts), asked, bound)
    got = {(r, x) for r, x in zip(row.tolist(), found.tolist())}
    assert len(got) == len(row)
    d = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(-1))
    for q, p in zip(*np.nonzero(d <= bound[:, None])):
        assert (q, leaf[p]) in got
    assert len(got) < 50 * len(np.unique(leaf)) / 2  # and prunes


def test_tree_of_equal_points_and_ties():
    for points in (np.zeros((100, 2)), np.repeat([[0.0, 1.0], [0.0, 2.0]], [90, 10], axis=0)):
        leaf = N.leaf_of(N.fit_tree(points, 3, 8), points)
        assert min(np.bincount(leaf)[np.unique(leaf)]) >= 8


@pytest.mark.parametrize("leaf_rows,top_depth", [(1024, 10), (40, 2)])
def test_join_against_brute_force(spark, leaf_rows, top_depth):
    rng = random.Random(leaf_rows + top_depth)
    points = [(i, [float(rng.randint(0, 30)), rng.gauss(0, 10), float(rng.randint(0, 1))]) for i in range(1500)]
    queries = points[:400] + [(9000 + i, [rng.uniform(-50, 80), rng.gauss(0, 40), 0.5]) for i in range(100)]
    got = _got(N.nearest(_frame(spark, queries), _frame(spark, points), 5, leaf_rows, top_depth))
    assert got == _brute(queries, points, 5)


def test_copies_hold_a_third_of_all_rows(spark):
    rng = random.Random(8)
    points = [(i, [1.0, 2.0]) for i in range(300)] + [(300 + i, [float(rng.randint(0, 9)), float(rng.randint(0, 9))]) for i in range(600)]
    got = _got(N.nearest(_frame(spark, points), _frame(spark, points), 4, 64, 2))
    assert got == _brute(points, points, 4)
    held = N.nearest(_frame(spark, points), _frame(spark, points), 4, 64, 2)
    assert held.count() == 4 * len(points)


def test_spaces_do_not_mix_and_may_be_empty(spark):
    a = [(i, [float(i % 17), float(i)]) for i in range(60)]
    b = [(i, [float(i * i % 31)]) for i in range(60)]
    queries = _frame(spark, a[:9], 1).unionAll(_frame(spark, b[:9], 2)).unionAll(_frame(spark, [(5, [1.0])], 3))
    points = _frame(spark, a, 1).unionAll(_frame(spark, b, 2))
    rows = N.nearest(queries, points, 3, 16, 1)
    assert _got(rows.where("space = 1")) == _brute(a[:9], a, 3)
    assert _got(rows.where("space = 2")) == _brute(b[:9], b, 3)
    assert rows.where("space = 3").count() == 0


def test_few_points_text_ids_and_nulls(spark):
    df = spark.createDataFrame([("b", 1.0, 2), ("a", 1.0, 2), ("c", 4.0, 6), (None, 1.0, 2), ("d", None, 1)], "key string, x double, y int")
    got = _got(knn(df, df, "key", ["x", "y"], 5))
    assert got == {"a": [("b", 0.0), ("c", 5.0)], "b": [("a", 0.0), ("c", 5.0)], "c": [("a", 5.0), ("b", 5.0)]}
    assert knn(df.limit(0), df.limit(0), "key", ["x", "y"], 5).count() == 0


# ------------------------------------------------------------------ D18
def _impute(rows, k):
    """Rows (id, values or None...) with holes filled by looking at every pair."""
    n = len(rows[0][1])
    out = {}
    for i, v in rows:
        new = list(v)
        for c in range(n):
            if v[c] is not None:
                continue
            near = []
            for j, w in rows:
                shared = [m for m in range(n) if v[m] is not None and w[m] is not None]
                if w[c] is not None and shared:
                    near.append((_distance([v[m] for m in shared], [w[m] for m in shared]) * math.sqrt(n / len(shared)), j, w[c]))
            near = sorted(near)[:k]
            have = [w[c] for _, w in rows if w[c] is not None]
            new[c] = sum(x for _, _, x in near) / len(near) if near else sum(have) / len(have) if have else None
        out[i] = new
    return out


@pytest.mark.parametrize("leaf_rows,top_depth", [(1024, 10), (32, 2)])
def test_imputation_against_brute_force(spark, leaf_rows, top_depth):
    rng = random.Random(11)
    rows = [(i, [None if rng.random() < 0.25 else float(rng.randint(0, 40)) for _ in range(4)]) for i in range(400)]
    rows += [(400 + i, [7.0, None, 3.0, 1.0]) for i in range(150)] + [(600, [None] * 4)]
    df = spark.createDataFrame([(i, "keep", *v) for i, v in rows], "id long, rank string, a double, space double, vals double, mask double")
    got = N.impute_knn(df.repartition(4), ["a", "space", "vals", "mask"], "id", 5, leaf_rows, top_depth)
    assert got.columns == df.columns
    want = _impute(rows, 5)
    held = {r.id: list(r)[2:] for r in got.collect()}
    assert held.keys() == want.keys()
    for i in want:
        assert held[i] == pytest.approx(want[i], abs=1e-9), i


def test_imputation_of_edge_cases(spark):
    schema = "id long, a double, b double, c double"
    whole = spark.createDataFrame([(1, 1.0, 2.0, None), (2, None, 4.0, None), (None, None, 3.0, None)], schema)
    got = sorted(map(tuple, N.impute_knn(whole, ["a", "b", "c"], "id").collect()), key=str)
    assert got == [(1, 1.0, 2.0, None), (2, 1.0, 4.0, None), (None, 1.0, 3.0, None)]  # a field without values stays null
    nan = spark.createDataFrame([(1, float("nan"), 1.0), (2, 5.0, 1.0)], "id long, a double, b double")
    assert N.impute_knn(nan, ["a", "b"], "id").where("id = 1").first().a == 5.0
    full = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], schema)
    assert [tuple(r) for r in N.impute_knn(full, ["a", "b", "c"], "id").collect()] == [(1, 1.0, 2.0, 3.0)]
    assert N.impute_knn(full.limit(0), ["a", "b", "c"], "id").count() == 0
    apart = spark.createDataFrame([(1, None, 2.0, None), (2, 8.0, None, 1.0)], schema)  # no shared field: the mean
    assert N.impute_knn(apart, ["a", "b", "c"], "id").where("id = 1").first().a == 8.0
    twice = spark.createDataFrame([(1, 1.0, None, 3.0), (1, 1.0, None, 3.0), (2, 1.0, 6.0, 3.0)], schema)
    assert [r.b for r in N.impute_knn(twice, ["a", "b", "c"], "id").where("id = 1").collect()] == [6.0, 6.0]


def test_a_join_reads_each_leaf_in_its_own_group(spark):
    """No window or join by a single key: what meets is keyed by space, leaf and chunk."""
    rows = [(i, [float(i % 97), float(i % 89)]) for i in range(2000)]
    plan = N.nearest(_frame(spark, rows), _frame(spark, rows), 3, 64, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow [space" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
