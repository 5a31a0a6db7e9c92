"""Hand-worked checks for formulas and state machines no oracle expresses."""

import math

import pytest
from pyspark.sql import functions as F

from sparkclin.functions.exprs import cumulative_sums
from sparkclin.operators import drift as H
from sparkclin.operators import metrics as M
from sparkclin.operators import model as E
from sparkclin.operators import ops as X
from sparkclin.operators import privacy as PV
from sparkclin.operators import rules as G


def test_confusion_fixture(spark):
    # y = 0,1,0,1,0,1 ; ŷ = 0,1,0,0,1,1 → tn 2, fp 1, fn 1, tp 2
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 0, 1], [0, 1, 0, 0, 1, 1])), "y_true int, y_pred int")
    r = M.threshold_metrics(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 1, 1, 2)
    assert r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3)
    assert r.accuracy == pytest.approx(4 / 6)


def test_auc_symmetry_and_ties(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.8), (1, 0.9)]
    df = spark.createDataFrame(rows, "y_true int, y_prob double")
    auc = M.roc_auc(df).first().roc_auc
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    brute = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute)
    flipped = M.roc_auc(df.withColumn("y_prob", 1 - F.col("y_prob"))).first().roc_auc
    assert flipped == pytest.approx(1 - auc)


def test_pr_auc_brute(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.8), (1, 0.9), (1, 0.2)]
    df = spark.createDataFrame(rows, "y_true int, y_prob double")
    got = M.pr_auc(df).first().pr_auc
    thr = sorted({p for _, p in rows}, reverse=True)
    P = sum(y for y, _ in rows)
    pts = [(0.0, 1.0)]
    for t in thr:
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        pts.append((tp / P, tp / (tp + fp)))
    area = sum((r1 - r0) * (p0 + p1) / 2 for (r0, p0), (r1, p1) in zip(pts, pts[1:]))
    assert got == pytest.approx(area)


def test_ece_le_mce(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("y_true"), ((F.col("id") % 97) / 97.0).alias("y_prob"))
    r = M.ece_mce(df).first()
    assert r.ece <= r.mce + 1e-12


def test_drift_identity(spark):
    df = spark.range(500).select(F.lit("reference").alias("sample"), (F.col("id") % 37).cast("double").alias("x"))
    both = df.unionByName(df.withColumn("sample", F.lit("current")))
    long = H.to_long(both, ["x"])
    assert H.ks_two_sample(long, with_pvalue=False).first().ks_statistic == pytest.approx(0.0)
    assert H.psi_decile(long).first().psi == pytest.approx(0.0)
    assert H.wasserstein(long).first().wasserstein == pytest.approx(0.0)


def test_cumulative_sums_matches_window(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("v"),
                                  F.lit(1).alias("c"))
    d = df.groupBy("g", "v").agg(F.sum("c").alias("c"))
    got = {(r.g, r.v): r.cum_c for r in cumulative_sums(d, "v", ["c"], ["g"], n_buckets=5).collect()}
    from pyspark.sql.window import Window
    w = Window.partitionBy("g").orderBy("v")
    exp = {(r.g, r.v): r.s for r in d.select("g", "v", F.sum("c").over(w).alias("s")).collect()}
    assert got == exp


def test_fallback_worked_example(spark):
    rows = [(6, 148.0, 72.0, 35.0, 0.0, 33.6, 0.627, 50), (0, 80.0, 65.0, 20.0, 10.0, 22.0, 0.2, 25)]
    df = spark.createDataFrame(rows, "pregnancies int, glucose double, blood_pressure double, skin_thickness double, "
                                     "insulin double, bmi double, diabetes_pedigree double, age int")
    out = G.fallback_score(G.safe_defaults(df)).collect()
    assert out[0].total_score == 9 and out[0].risk_level == "High Risk" and out[0].risk_score == 100
    assert out[1].total_score == 0 and out[1].risk_level == "Low Risk" and out[1].risk_score == 30
    bumped = G.conservative_bump(G.fallback_score(df)).collect()[1]
    assert bumped.risk_score == 45 and bumped.risk_level == "Moderate Risk"


def test_cooldown_state_machine(spark):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", 0.5) for i, m in enumerate([0, 1, 4, 5, 6, 11])]
    df = spark.createDataFrame(rows, "sample_id long, ts string, error_rate double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    fired = sorted(r.sample_id for r in X.evaluate_alert_rules(df).collect())
    assert fired == [0, 3, 5]  # 00:00, 00:05 (300 s later), 00:11


def test_token_bucket(spark):
    rows = [(i, "2024-01-01 00:00:00", "/x") for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, ts string, endpoint string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    out = X.rate_limit_replay(df, F.col("endpoint"), limit=2, period_s=60).orderBy("event_id").collect()
    assert [r.allowed for r in out] == [True, True, True, False, False]  # capacity int(1.5·2) = 3


def test_circuit_breaker(spark):
    statuses = [500] * 5 + [200, 200]
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "/p", s) for i, s in enumerate(statuses)]
    rows += [(7, "2024-01-01 00:00:40", "/p", 200), (8, "2024-01-01 00:00:41", "/p", 200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, endpoint string, status int").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    out = {r.event_id: (r.admitted, r.state_after) for r in X.outage_states(df).collect()}
    assert out[4] == (True, "OPEN") and out[5] == (False, "OPEN")
    assert out[7] == (True, "HALF_OPEN") and out[8] == (True, "CLOSED")


def test_encrypt_roundtrip_and_masks(spark):
    df = spark.createDataFrame([("a@b.com", "john.smith@example.org", "555-123-4567", "123-45-6789")],
                               "short string, email string, phone string, ssn string")
    r = df.select(PV.mask_email(F.col("short")).alias("s"), PV.mask_email(F.col("email")).alias("e"),
                  PV.mask_phone(F.col("phone")).alias("p"), PV.mask_ssn(F.col("ssn")).alias("n")).first()
    assert r.s == "a@*******" and r.e == "jo****@example.org" and r.p == "55****4567" and r.n == "***-**-6789"
    key = "k" * 32
    enc = PV.encrypt_columns(df, ["email"], key)
    dec = PV.decrypt_columns(enc, ["email"], key).first()
    assert dec.email == "john.smith@example.org"


def test_hash_pii_token(spark):
    import hashlib
    df = spark.createDataFrame([("mail me at jane@doe.io now",)], "t string")
    out = df.select(PV.hash_pii(F.col("t"), "s1").alias("t")).first().t
    h = hashlib.sha256(("jane@doe.io" + "s1").encode()).hexdigest()[:8]
    assert out == f"mail me at [EMAIL_{h}] now"


def test_kolmogorov_series():
    lam = 1.0
    s = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert s == pytest.approx(0.2699996716735, rel=1e-9)


def test_feature_registry_and_validation(spark):
    from sparkclin.functions import udf as K
    reg = K.FeatureRegistry()
    reg.register_feature("ratio", lambda df: F.col("glucose") / F.col("bmi"), dependencies=[])
    reg.register_feature("ratio_sq", lambda df: F.col("ratio") * F.col("ratio"), dependencies=["ratio"])
    df = spark.createDataFrame([(100.0, 25.0)], "glucose double, bmi double")
    r = reg.compute(df, ["ratio_sq"]).first()
    assert r.ratio == 4.0 and r.ratio_sq == 16.0
    vals = {}
    K.register_validation(vals, "bin", "{col} IN (0, 1)", "not binary")
    K.register_validation(vals, "pos", pandas_fn=lambda s: s > 0, message="not positive")
    v = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    out = K.apply_validation(K.apply_validation(v, vals["bin"], "x"), vals["pos"], "x").orderBy("x").collect()
    assert [o.bin_ok for o in out] == [True, False] and [o.pos_ok for o in out] == [False, True]


def test_distributed_quantiles_equal_percentile(spark):
    from sparkclin.functions.exprs import column_quantiles, quantiles_long
    df = spark.range(5000).select(((F.col("id") * 7919) % 1013 / 7.0).alias("a"), (F.col("id") % 13).cast("int").alias("b"),
                                  F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") / 3.0).alias("c"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    d = column_quantiles(df, ["a", "b", "c"], probs).first()
    arr = "array(" + ", ".join(map(str, probs)) + ")"
    p = df.selectExpr(*[f"percentile({c}, {arr}) AS {c}" for c in "abc"]).first()
    for i in range(3):
        assert d[f"__q_{i}"] == pytest.approx(p[i], rel=1e-12, abs=1e-12)
    w = spark.createDataFrame([("x", 1.0, 3), ("x", 2.0, 1), ("x", 5.0, 2), ("y", 4.0, 1)], "feature string, value double, r long")
    dw = {r["feature"]: r["__q"] for r in quantiles_long(w, [0.25, 0.5, 0.9], ["feature"], weight="r").collect()}
    pw = {r["feature"]: r["q"] for r in w.groupBy("feature").agg(
        F.expr("percentile(value, array(0.25, 0.5, 0.9), r)").alias("q")).collect()}
    for k in pw:
        assert dw[k] == pytest.approx(pw[k])


def test_cumulative_sums_next_value_and_descending(spark):
    from pyspark.sql.window import Window
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),  # one null group
                                  ((F.col("id") * 7919) % 577).cast("double").alias("v"), (F.col("id") % 5).alias("c"))
    d = df.groupBy("g", "v").agg(F.sum("c").alias("c"))
    for desc in (False, True):
        w = Window.partitionBy("g").orderBy(F.desc("v") if desc else F.asc("v"))
        a = {(r.g, r.v): (r.cum_c, r.next_value) for r in
             cumulative_sums(d, "v", ["c"], ["g"], descending=desc, with_next=True, n_buckets=7).collect()}
        b = {(r.g, r.v): (r.s, r.n) for r in d.select("g", "v", F.sum("c").over(w).alias("s"), F.lead("v").over(w).alias("n")).collect()}
        assert a == b


def test_bucket_edges_are_per_group(spark):
    # A narrow and a very wide feature: each spreads over its own buckets, none holds most of a feature.
    from sparkclin.functions.exprs import _bucket
    d = (spark.range(4000).select(F.lit("narrow").alias("g"), (F.col("id") / 1e6).alias("v"))
         .unionByName(spark.range(4000).select(F.lit("wide").alias("g"), (F.col("id") * 1e6).alias("v"))))
    e = d.groupBy("g").agg(F.expr("percentile_approx(v, array(0.125,0.25,0.375,0.5,0.625,0.75,0.875), 1000)").alias("e"))
    sizes = d.join(e, "g").withColumn("b", _bucket("e", "v", 8)).groupBy("g", "b").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 600
    linear = F.size(F.filter("e", lambda x: x < F.col("v")))
    assert d.join(e, "g").where(_bucket("e", "v", 8) != linear).count() == 0


def test_pii_chains_equal_column_forms(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    d = d.unionByName(spark.createDataFrame([(10**9, "Mail John Smith at john.smith@x.org, SSN 123-45-6789, MRN-1234567")],
                                            "doc_id long, text string"))
    a = PV.hash_pii_df(d, "text", "s1", "h").select("doc_id", "h")
    b = d.select("doc_id", PV.hash_pii(F.col("text"), "s1").alias("h"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    ra = PV.redact_pii_df(d, "text", "r").select("doc_id", "r")
    rb = d.select("doc_id", PV.redact_pii(F.col("text")).alias("r"))
    assert ra.exceptAll(rb).count() == 0


def test_sensitive_names_any_case_and_nested(spark):
    df = spark.sql("""SELECT 'a@b.org' AS Email, '123-45-6789' AS SSN, named_struct('street', '1 Main Road') AS Address,
                      named_struct('Phone', '5551234567', 'note', 'fine') AS who, map('Email', 'x@y.org', 'k', 'ok') AS m,
                      array('call a@b.org') AS notes""")
    r = PV.sanitize_nested(df, "s1").first()
    assert r.Email == "****" and r.SSN == "****6789" and r.Address == "****"
    assert r.who.Phone == "****4567" and r.who.note == "fine"
    assert r.m["Email"] == "****" and r.m["k"] == "ok" and "a@b.org" not in r.notes[0]
    t = PV.mask_sensitive_fields(df.select("Email", "SSN")).first()
    assert t.Email == "****" and t.SSN == "****6789"


def test_ema_exact_for_small_alpha_and_long_keys(spark):
    import numpy as np
    n, alpha = 5000, 0.001
    d = spark.range(n).select(F.lit(1).alias("k"), F.col("id"), F.expr("timestamp_seconds(id div 3)").alias("ts"),
                              ((F.col("id") * 7919) % 1013).cast("double").alias("latency_ms"))
    got = {r.id: r.ema_latency_ms for r in X.ema_latency(d, ["k"], ["ts", "id"], alpha=alpha, hot_rows=700).collect()}
    avg = 0.0
    for i in range(n):
        avg = (1 - alpha) * avg + alpha * ((i * 7919) % 1013)
        assert abs(got[i] - avg) < 1e-8 * max(1.0, avg)


def test_global_importance_covers_every_feature(spark):
    coef = {f"f{i}": 1.0 + i for i in range(15)}
    d = spark.range(200).select(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(f"f{i}") for i in range(15)])
    got = {r.feature: r.mean_abs_contribution for r in E.global_importance(d, coef, k=15).collect()}
    pdf = d.toPandas()
    for f, w in coef.items():
        assert got[f] == pytest.approx((w * (pdf[f] - pdf[f].mean())).abs().mean())


def test_rules_over_absent_metrics(spark):
    m = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 1 AS sample_id, 0.9 AS error_rate")
    assert [r.rule_name for r in X.alert_candidates(m).collect()] == ["high_error_rate"]
    with pytest.raises(Exception):
        X.alert_candidates(m, [("r", "no_such_metric > 1", "high", ["slack"], 300)]).collect()


def test_cache_lifetime_starts_at_the_miss(spark):
    d = spark.createDataFrame([(i, 60 * t) for i, t in enumerate([0, 4, 6, 9, 12])], "event_id long, s long").select(
        "event_id", F.expr("timestamp_seconds(s)").alias("ts"), F.lit("x").alias("e"))
    got = {r.event_id: r.cache_hit for r in X.dedupe_requests(d, ["e"]).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}
