"""Keyed windows and chains cut in time: same rows as the uncut plan, and as brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparkclin.operators import features as D
from sparkclin.operators import keyed as K
from sparkclin.operators import ops as X

WHOLE = 10 ** 9


def _log(spark, n=900, seed=1):
    """One key holds most rows, in bursts and gaps; ties in time, null values, a null key and null times."""
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice((0, 0, 1, 1, 2, 30)) if i % 200 < 150 else rng.choice((5, 400))
        key = rng.choice(("hot", "hot", "hot", "a", "b", None))
        rows.append((i, key, t, None if rng.random() < 0.15 else round(rng.uniform(0, 100), 3)))
    rows += [(n, "hot", None, 5.0), (n + 1, None, None, None), (n + 2, "solo", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, user string, sec double, value double")
    return df.select("event_id", "user", F.timestamp_micros((F.col("sec") * 1e6).cast("long")).alias("ts"), "value").repartition(6)


def _same(a, b):
    assert a.columns == b.columns
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    rows = [sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in x.collect()), key=key) for x in (a, b)]
    assert rows[0] == rows[1]


def test_cut_covers_a_key_in_time_order(spark):
    x = K.cut(_log(spark), ["user"], "ts", 100, 7).where("user = 'hot'")
    chunks = x.groupBy("__chunk").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).orderBy("__chunk").collect()
    assert len(chunks) >= 5
    assert all(a.hi < b.lo for a, b in zip(chunks, chunks[1:]))
    assert max(c.n for c in chunks) < 0.4 * sum(c.n for c in chunks)
    assert K.is_cut(K.cut(_log(spark), ["user"], "ts", 100, 7)) and not K.is_cut(K.cut(_log(spark), ["user"], "ts", WHOLE))


def test_halo_reaches_over_small_chunks(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(12)], "k string, t double")
    x = K.with_halo(K.cut(df, ["k"], "t", 5, 12), ["t"], 4)
    for chunk in {r["__chunk"] for r in x.select("__chunk").distinct().collect()}:
        rows = x.where(F.col("__chunk") == chunk).collect()
        first = min(r.t for r in rows if r["__real"])
        assert sorted(r.t for r in rows if not r["__real"]) == [t for t in range(12) if first - 4 <= t < first]


@pytest.mark.parametrize("run", [
    lambda d, n: D.rolling_aggregates(d, "user", ["ts", "event_id"], ["value"], [3, 7], ["mean", "std", "min", "max"], n),
    lambda d, n: D.lag_diff_features(d, "user", ["ts", "event_id"], ["value"], n),
    lambda d, n: D.value_trend(d, "user", ["ts", "event_id"], "value", 7, n),
    lambda d, n: X.sustained_condition(d.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("event_id") / 10000)),
                                       ["user"], "ts", F.col("value") > 30, 20, n),
    lambda d, n: X.ema_latency(d, ["user"], ["ts", "event_id"], "value", hot_rows=n),
    lambda d, n: K.fire_with_cooldown(d, ["user"], "ts", "event_id", F.lit(60), n),
], ids=["rolling", "lag", "trend", "islands", "ema", "cooldown"])
def test_a_hot_key_gives_the_rows_of_the_uncut_plan(spark, run):
    df = _log(spark)
    _same(run(df, 100), run(df, WHOLE))


def test_empty_tables(spark):
    df = _log(spark).limit(0)
    assert D.lag_diff_features(df, "user", ["ts", "event_id"], ["value"]).count() == 0
    assert K.fire_with_cooldown(df, ["user"], "ts", "event_id", F.lit(60)).count() == 0
    assert X.ema_latency(df, ["user"], ["ts", "event_id"], "value").count() == 0


@pytest.mark.parametrize("wait", [0, 7, 300, 10 ** 7])
def test_cooldown_against_a_scan(spark, wait):
    rng = random.Random(wait)
    rows, t = [], 0
    for i in range(700):
        t += rng.choice((0, 1, 1, 1, 3, 250))
        rows.append((i, rng.choice(("hot", "hot", "cold")), t))
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.fires for r in K.fire_with_cooldown(df, ["k"], "ts", "id", F.lit(wait), 100, 9).collect()}
    last, want = {}, {}
    for i, k, s in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = k not in last or s - last[k] >= wait
        if want[i]:
            last[k] = s
    assert got == want


def test_a_key_without_gaps_is_spread_and_chained(spark):
    """A rule that holds in every sample: no gap to cut at, and a chain through every chunk."""
    df = spark.range(5000).select("id", F.lit("rule").alias("k"), F.timestamp_seconds(F.col("id") * 2).alias("ts"))
    fired = K.fire_with_cooldown(df, ["k"], "ts", "id", F.lit(300), 500, 16)
    assert sorted(r.id for r in fired.where("fires").collect()) == list(range(0, 5000, 150))
    plan = fired._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "__chunk" in plan


def test_no_window_by_key_alone(spark):
    df = _log(spark)
    x = D.rolling_aggregates(df, "user", ["ts", "event_id"], ["value"], [3], ["mean"], 100)
    windows = [line for line in x._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("__chunk" in line for line in windows)


def test_rows_without_key_or_time_stay(spark):
    df = spark.createDataFrame([(1, "k", 1, 10.0), (2, "k", None, 20.0), (3, None, 2, 30.0)], "event_id long, user string, s long, value double")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r.event_id: r.ema_latency_ms for r in X.ema_latency(df, ["user"], ["ts", "event_id"], "value").collect()}
    assert got == pytest.approx({2: 2.0, 1: 2.8, 3: 3.0})
