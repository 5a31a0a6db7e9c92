"""The feature stream: newest value, validation, expiry, replay and compaction."""

import datetime as dt

from sparkclin.streaming import streams as S

SCHEMA = "entity_id string, feature string, value double, ts timestamp_ntz, event_id long"
T0 = dt.datetime(2026, 1, 1)


def _write(spark, path, rows):
    spark.createDataFrame([(e, f, v, T0 + dt.timedelta(seconds=s), i) for e, f, v, s, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, d, **kw):
    q = S.stream_feature_upsert(S.read_stream(spark, f"{d}/in", max_files=1), f"{d}/changes", f"{d}/ck", **kw).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def _table(df):
    return {(r.entity_id, r.feature): r.value for r in df.collect()}


def test_upsert_expiry_and_compaction(spark, tmp_path):
    d = str(tmp_path)
    rules = {"bmi": (10.0, 60.0), "age": (0.0, None)}
    _write(spark, f"{d}/in", [("a", "bmi", 20.0, 0, 1), ("a", "bmi", 21.0, 5, 2), ("b", "bmi", 99.0, 0, 3), ("b", "age", None, 1, 4), ("b", "odd", 1.0, 1, 5)])
    _run(spark, d, rules=rules, ttl_s=60)
    _write(spark, f"{d}/in", [("a", "bmi", 22.0, 50, 6), ("a", "age", 40.0, 2, 7)])
    _run(spark, d, rules=rules, ttl_s=60)
    want = {("a", "bmi"): 22.0, ("b", "bmi"): 99.0, ("b", "age"): None, ("b", "odd"): 1.0, ("a", "age"): 40.0}
    table = S.feature_table(spark, f"{d}/changes")
    assert _table(table) == want
    assert {(r.entity_id, r.feature): r.message for r in table.collect() if r.message} == {
        ("b", "bmi"): "bmi above 60.0", ("b", "age"): "missing value", ("b", "odd"): "unknown feature odd"}
    at = T0 + dt.timedelta(seconds=90)
    assert _table(S.feature_table(spark, f"{d}/changes", at)) == {("a", "bmi"): 22.0}

    # A base answers as the log does, also with batches after it.
    base = f"{d}/base"
    assert _table(S.feature_table(spark, f"{d}/changes", None, base)) == want
    assert S.compact_features(spark, f"{d}/changes", base) == 1
    assert _table(S.feature_table(spark, f"{d}/changes", None, base)) == want
    _write(spark, f"{d}/in", [("a", "bmi", 23.0, 70, 8), ("a", "age", 1.0, 1, 9)])  # the second is older than what is known
    _run(spark, d, rules=rules, ttl_s=60)
    want[("a", "bmi")] = 23.0
    assert _table(S.feature_table(spark, f"{d}/changes", None, base)) == want == _table(S.feature_table(spark, f"{d}/changes"))
    spark.createDataFrame([("z", 1)], "junk string, n int").write.parquet(f"{base}/base-unfinished")  # died before its record
    assert S.compact_features(spark, f"{d}/changes", base, at) == 2
    assert _table(S.feature_table(spark, f"{d}/changes", None, base)) == {("a", "bmi"): 23.0}


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([("a", "bmi", 1.0, T0, None, None)],
                                 "entity_id string, feature string, value double, ts timestamp_ntz, message string, expires_at timestamp_ntz")
    for _ in range(2):
        S.replace_batch(rows, 7, f"{d}/changes")
    assert spark.read.parquet(f"{d}/changes").count() == 1
    assert _table(S.feature_table(spark, f"{d}/changes")) == {("a", "bmi"): 1.0}
