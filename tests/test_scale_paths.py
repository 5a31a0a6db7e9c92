"""How often queries read, and what they meet per row: steps whose cost must not outgrow the input."""

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkclin.operators import model as E
from sparkclin.operators import neighbours as N
from sparkclin.operators import ops as X
from sparkclin.operators import robust as R
from sparkclin.plans import catalog_balance, catalog_model


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _bucket_by_hand(rows, limit, period):
    tokens, last, out, held = 0.0, None, {}, None
    for key, t, i in sorted(rows, key=lambda r: (str(r[0]), math.inf if r[1] is None else r[1], r[2])):
        if key != held:
            tokens, last, held = float(int(1.5 * limit)), None, key
        now = math.nan if t is None else t
        if last is not None:
            tokens = float(int(1.5 * limit)) if t is None or math.isnan(last) or now - last > 3600 else min(int(1.5 * limit), tokens + (now - last) * limit / period)
        last = now
        out[i] = (tokens >= 1, 0.0 if tokens >= 1 else (1 - tokens) * period / limit)
        tokens -= tokens >= 1
    return out


def test_token_bucket_of_many_keys_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None, ""]), None if rng.random() < 0.05 else rng.randrange(8000), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go on from batch to batch
    try:
        out = X.rate_limit_replay(df, F.col("k"), limit=4, period_s=600.0)
        got = {r.event_id: (r.allowed, r.retry_after_s) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _bucket_by_hand(rows, 4, 600.0)
    assert len(got) == 900 and {a for a, _ in got.values()} == {True, False}
    assert all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], abs_tol=1e-6) for i in want)
    assert "FlatMapGroups" not in _plan(out)  # a Python call per key cost about 1 ms, whatever its rows


def test_points_of_a_leaf_are_met_part_by_part():
    rng = np.random.default_rng(3)
    for n, dims, k in ((1500, 3, 5), (700, 2, 10), (300, 1, 3), (40, 3, 5)):
        points = np.round(rng.normal(size=(n, dims)), 2 if dims > 1 else 1)  # ties and copies
        queries = np.concatenate([points[: n // 2], np.round(rng.normal(size=(60, dims)) * 3, 2)])
        same = (np.concatenate([np.arange(n // 2), np.full(60, -1)]), np.arange(n))
        bound = np.where(rng.random(len(queries)) < 0.3, 0.2, np.inf)
        got, want = (f(queries, points, same, k, bound) for f in (N.nearest_in_leaf, N.nearest_of))
        assert all(np.array_equal(x, y) for x, y in zip(got, want))
    none = N.nearest_in_leaf(np.zeros((2, 2)) + 50, rng.normal(size=(400, 2)), (np.full(2, -1), np.arange(400)), 5, np.ones(2))
    assert [len(x) for x in none] == [0, 0, 0]


def test_a_query_meets_a_small_part_of_its_leaf(monkeypatch):
    points = np.random.default_rng(4).normal(size=(1024, 3))
    met, inner = [], N.nearest_of
    monkeypatch.setattr(N, "nearest_of", lambda a, b, *rest: (met.append(len(a) * len(b)), inner(a, b, *rest))[1])
    N.nearest_in_leaf(points, points, (np.arange(1024), np.arange(1024)), 5, np.full(1024, np.inf))
    assert sum(met) < 1024 * 1024 / 2


def test_folds_shuffle_rows_once(spark):
    d = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("target"))
    d = d.unionAll(spark.sql("SELECT id, CAST(null AS INT) FROM range(7)")).unionAll(spark.sql("SELECT null, 1 FROM range(4)"))
    out = E.stratified_folds(d, "target", "id", 5)
    assert len(re.findall(r"Sort \[", _plan(out))) <= 2  # rows in their ranges, ranges in their order
    assert out.columns == ["id", "target", "fold"] and out.count() == 3011
    want = {}
    for t in (0, 1, None):
        ids = [i for i in range(3000) if int(i % 3 == 0) == t] if t is not None else range(7)
        ids = [None] * 4 * (t == 1) + sorted(ids, key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i))
        want |= {(t, i): n % 5 for n, i in enumerate(ids) if i is not None}
    assert {(r.target, r.id): r.fold for r in out.where("id IS NOT NULL").collect()} == want


def test_robust_fit_drops_starts_that_stand_still(spark, monkeypatch):
    df = spark.range(400).select(F.sin("id").alias("a"), (F.cos(F.col("id") * 3) + F.sin("id")).alias("b"))
    width, inner = [], R._moments
    monkeypatch.setattr(R, "_moments", lambda rows, cols, centre, keep: (width.append(len(keep)), inner(rows, cols, centre, keep))[1])
    R.mahalanobis_fit(df, ["a", "b"])
    steps = width[:-1]  # the last is the reweighting
    assert steps == sorted(steps, reverse=True) and sum(steps) < R.FULL * len(steps)


def test_training_rows_are_imputed_once(spark, sf):
    for frame in (catalog_model._train_frame(spark, sf), catalog_balance._source(spark, sf)):
        assert "Aggregate" not in _plan(frame)
