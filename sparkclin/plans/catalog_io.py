"""Registered queries for group A (sources, manifests, quarantine tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkclin.functions.exprs import md5_bucket
from sparkclin.plans.registry import register
from sparkclin.session import checkpoint_dir
from sparkclin.sources import io as A
from sparkclin.sources import versions as V
from sparkclin.sources.io import table
from sparkclin.sources.views import patients, runs, scored

_FP_COLS = ["patient_id", "age", "gender", "pregnancies", "k"]


@register("dataset_fingerprint", sql=f"""
SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(',', {', '.join(f'CAST({c} AS VARCHAR)' for c in _FP_COLS)})), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint
FROM patients_v""")
def q_dataset_fingerprint(spark, sf):
    return A.dataset_fingerprint(patients(spark, sf), _FP_COLS).drop("xor64")


@register("dataset_metadata", sql="""
SELECT CAST(sum(n) AS BIGINT) AS n_samples, CAST(8 AS INTEGER) AS n_features,
       ['age', 'pregnancies', 'glucose', 'blood_pressure', 'skin_thickness', 'insulin', 'bmi', 'diabetes_pedigree'] AS feature_names,
       map_from_entries(list((CAST(y_true AS VARCHAR), n) ORDER BY CAST(y_true AS VARCHAR))) AS class_distribution
FROM (SELECT y_true, count(*) AS n FROM scored_v GROUP BY y_true) t""")
def q_dataset_metadata(spark, sf):
    s = scored(spark, sf).select("age", "pregnancies", "glucose", "blood_pressure", "skin_thickness", "insulin", "bmi",
                                 "diabetes_pedigree", "y_true")
    return A.dataset_metadata(s, "y_true")


@register("sample_rows", sql="""
SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders
               WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 100) t
ORDER BY o_orderkey LIMIT 500""")
def q_sample_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return A.sample_rows(o, "o_orderkey", fraction=0.1, limit=500)


@register("read_headerless_numeric", dbl=["glucose", "bmi"], sql="""
SELECT patient_id, CASE WHEN trim(g) = '?' THEN NULL ELSE try_cast(trim(g) AS DOUBLE) END AS glucose,
       CASE WHEN trim(b) = '?' THEN NULL ELSE try_cast(trim(b) AS DOUBLE) END AS bmi
FROM (SELECT patient_id, CASE WHEN glucose IS NULL THEN '?' ELSE CAST(glucose AS VARCHAR) END AS g,
             CASE WHEN k % 17 = 0 THEN 'n/a' ELSE CAST(bmi AS VARCHAR) END AS b FROM patients_v) t""")
def q_read_headerless_numeric(spark, sf):
    p = patients(spark, sf).select(
        "patient_id", F.when(F.col("glucose").isNull(), "?").otherwise(F.col("glucose").cast("string")).alias("glucose"),
        F.when(F.col("k") % 17 == 0, "n/a").otherwise(F.col("bmi").cast("string")).alias("bmi"))
    return A.coerce_numeric(p, ["glucose", "bmi"])


_LINE = ("strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' "
         "ELSE 'INFO' END || ' api.' || event_type || ' user ' || CAST(user_id AS VARCHAR) || ' value ' || CAST(event_id AS VARCHAR)")
_SLINE = ("concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' "
          "ELSE 'INFO' END, ' api.', event_type, ' user ', CAST(user_id AS STRING), ' value ', CAST(event_id AS STRING))")


@register("parse_text_logs", sql=f"""
SELECT event_id, CAST(try_strptime(regexp_extract(line, '{A.LOG_LINE_PATTERN}', 1), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS log_ts,
       regexp_extract(line, '{A.LOG_LINE_PATTERN}', 2) AS level, regexp_extract(line, '{A.LOG_LINE_PATTERN}', 3) AS module,
       regexp_extract(line, '{A.LOG_LINE_PATTERN}', 4) AS message
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'garbage line ' || CAST(event_id AS VARCHAR) ELSE {_LINE} END AS line FROM events) t""")
def q_parse_text_logs(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(
        f"CASE WHEN event_id % 11 = 0 THEN concat('garbage line ', CAST(event_id AS STRING)) ELSE {_SLINE} END").alias("line"))
    p = A.parse_text_logs(e)
    return p.select("event_id", "log_ts", F.coalesce("level", F.lit("")).alias("level"),
                    F.coalesce("module", F.lit("")).alias("module"), F.coalesce("message", F.lit("")).alias("message"))


@register("parse_json_logs", sql="""
SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def q_parse_json_logs(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    return A.parse_json_logs(e, "props", {"k": "$.k"}).select("event_id", "k")


_VERSION = ("CAST(c_nationkey % 3 AS VARCHAR) || '.' || CAST(c_custkey % 12 AS VARCHAR) || '.' || "
            "CASE WHEN c_custkey % 5 = 0 THEN 'rc' ELSE CAST(c_custkey % 7 AS VARCHAR) END")


@register("latest_version", sql=f"""
SELECT name, arg_max(version, ([coalesce(try_cast(x AS INTEGER), -1) FOR x IN string_split(version, '.')], version)) AS latest_version
FROM (SELECT c_mktsegment AS name, {_VERSION} AS version FROM customer) t GROUP BY name""")
def q_latest_version(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"),
                                            F.expr(_VERSION.replace("VARCHAR", "STRING")).alias("version"))
    return A.latest_version(c, "name", "version")


@register("version_history", dbl=["drift_score"], sql="SELECT run_id, run_date, drift_score, feature FROM runs_v")
def q_version_history(spark, sf):
    return A.version_history(runs(spark, sf).select("run_id", "run_date", "drift_score", "feature"), "run_date")


@register("list_datasets", sql="SELECT DISTINCT feature AS name FROM runs_v")
def q_list_datasets(spark, sf):
    return A.list_datasets(runs(spark, sf).select(F.col("feature").alias("name")))


@register("expire_snapshots", sql="""
SELECT run_id, run_date FROM runs_v WHERE run_date < (SELECT max(run_date) FROM runs_v) - INTERVAL 30 DAY""")
def q_expire_snapshots(spark, sf):
    r = runs(spark, sf).select("run_id", "run_date")
    return A.expire_snapshots(r, "run_date", 30).select("run_id", F.col("run_date"))


@register("read_snapshot", sql="SELECT run_id, run_date FROM runs_v WHERE run_date = (SELECT max(run_date) FROM runs_v)")
def q_read_snapshot(spark, sf):
    return A.latest_partition(runs(spark, sf).select("run_id", "run_date"), "run_date")


@register("split_distribution", sql="""
SELECT CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.3 THEN 'validation' ELSE 'train' END AS split, y_true, count(*) AS n
FROM (SELECT y_true, CAST(CAST('0x' || substr(md5(patient_id), 1, 8) AS BIGINT) % 1073741824 AS DOUBLE) / 1073741824.0 AS u FROM scored_v) t
GROUP BY 1, 2""")
def q_split_distribution(spark, sf):
    from sparkclin.operators.prep import split_train_test
    s = split_train_test(scored(spark, sf).select("patient_id", "y_true"), "patient_id")
    return A.split_distribution(s, "split", "y_true")


_DLQ = ("SELECT review_id AS dlq_id, CASE WHEN review_id % 3 = 0 THEN 'score' ELSE 'drift' END AS task_name, created_at AS ts, "
        "CAST(review_id % 4 AS INTEGER) AS retry_count, 3 AS max_retries, "
        "CASE WHEN review_id % 5 = 0 THEN 'resolved' ELSE 'pending' END AS status FROM reviews_v")


def _dlq(spark, sf):
    from sparkclin.sources.views import reviews
    r = reviews(spark, sf)
    return r.select(F.col("review_id").alias("dlq_id"),
                    F.when(F.col("review_id") % 3 == 0, "score").otherwise("drift").alias("task_name"),
                    F.col("created_at").alias("ts"), (F.col("review_id") % 4).cast("int").alias("retry_count"),
                    F.lit(3).alias("max_retries"),
                    F.when(F.col("review_id") % 5 == 0, "resolved").otherwise("pending").alias("status"))


@register("quarantine_retry", sql=f"""
WITH d AS ({_DLQ}),
p AS (SELECT dlq_id FROM d WHERE status = 'pending' ORDER BY ts, dlq_id LIMIT 100),
o AS (SELECT dlq_id, dlq_id % 2 = 0 AS ok FROM d),
j AS (SELECT d.*, p.dlq_id IS NOT NULL AS picked, o.ok FROM d LEFT JOIN p USING (dlq_id) LEFT JOIN o USING (dlq_id)),
k AS (SELECT *, CASE WHEN picked AND NOT coalesce(ok, false) THEN retry_count + 1 ELSE retry_count END AS nr FROM j)
SELECT status_new AS status, CAST(nr AS INTEGER) AS retry_count, count(*) AS n FROM (
  SELECT nr, CASE WHEN NOT picked THEN status WHEN coalesce(ok, false) THEN 'resolved' WHEN nr >= max_retries THEN 'failed_retry'
                  ELSE 'pending' END AS status_new FROM k) t GROUP BY 1, 2""")
def q_quarantine_retry(spark, sf):
    d = _dlq(spark, sf)
    o = d.select("dlq_id", (F.col("dlq_id") % 2 == 0).alias("ok"))
    r = A.quarantine_retry(d, o, 100)
    return r.groupBy("status", "retry_count").agg(F.count(F.lit(1)).alias("n"))


@register("quarantine_stats", sql=f"""
WITH d AS ({_DLQ}), m AS (SELECT max(ts) AS as_of_ts FROM d)
SELECT task_name, count(*) AS total, count_if(status = 'pending') AS pending, count_if(status = 'resolved') AS resolved,
       count_if(status = 'failed_retry') AS failed_retry, CAST(epoch(max(as_of_ts)) - epoch(min(ts)) AS BIGINT) AS oldest_age_s
FROM d, m GROUP BY task_name""")
def q_quarantine_stats(spark, sf):
    return A.quarantine_stats(_dlq(spark, sf))


@register("quarantine_split", sql="""
SELECT CASE WHEN n_err > 0 THEN 'quarantine' ELSE 'good' END AS side, count(*) AS n FROM (
  SELECT (CASE WHEN glucose IS NULL THEN 1 ELSE 0 END) + (CASE WHEN blood_pressure IS NULL THEN 1 ELSE 0 END) AS n_err FROM patients_v) t
GROUP BY 1""")
def q_quarantine_split(spark, sf):
    p = patients(spark, sf)
    errs = F.filter(F.array(F.when(F.col("glucose").isNull(), F.lit("glucose missing")),
                            F.when(F.col("blood_pressure").isNull(), F.lit("blood_pressure missing"))), lambda x: x.isNotNull())
    good, bad = A.quarantine_split(p.withColumn("errors", errs))
    return (good.select(F.lit("good").alias("side")).unionByName(bad.select(F.lit("quarantine").alias("side")))
            .groupBy("side").agg(F.count(F.lit(1)).alias("n")))


@register("hash_sample_buckets", sql="""
SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def q_hash_sample_buckets(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(md5_bucket(F.col("o_orderkey"), 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("file_list", sql="""
SELECT 'orders.parquet' AS file, true AS has_size, (SELECT count(*) FROM orders) AS n_rows""")
def q_file_list(spark, sf):
    """Files of the orders table from the scan's metadata, with rows a file."""
    f = V.file_list(table(spark, sf, "orders"))
    name = F.regexp_extract("path", "([a-z]+\\.parquet)", 1)
    return f.groupBy(name.alias("file")).agg((F.sum("size_bytes") > 0).alias("has_size"), F.sum("n_rows").alias("n_rows"))


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("version_data", sql="""
SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n_rows, 'first' AS message, 1 AS commits""")
def q_version_data(spark, sf):
    """A version of the orders table, written to the shared folder and read back from its commit record."""
    root = _scratch(spark, "versions")
    V.version_data(spark, f"{sf}/orders.parquet", root, "orders", "first")
    return V.version_records(spark, root, "orders").groupBy("name", "n_rows", "message").agg(F.count(F.lit(1)).cast("int").alias("commits"))


@register("reference_statistics", dbl=["mean", "min", "max"], sql="""
SELECT c.col_name, c.n AS count, c.mean, c.lo AS min, c.hi AS max FROM (
  SELECT 'o_totalprice' AS col_name, count(o_totalprice) AS n, avg(o_totalprice) AS mean, min(CAST(o_totalprice AS DOUBLE)) AS lo, max(CAST(o_totalprice AS DOUBLE)) AS hi FROM orders
  UNION ALL SELECT 'o_custkey', count(o_custkey), avg(o_custkey), min(CAST(o_custkey AS DOUBLE)), max(CAST(o_custkey AS DOUBLE)) FROM orders) c""")
def q_reference_statistics(spark, sf):
    """A reference written with its statistics, and the statistics read back."""
    root = _scratch(spark, "reference")
    V.write_reference(table(spark, sf, "orders").select("o_custkey", "o_totalprice"), root, "orders as of now")
    return V.read_reference_statistics(spark, root).select("col_name", "count", "mean", "min", "max")


@register("read_snapshot_rows", sql="SELECT o_orderkey, o_custkey FROM orders")
def q_read_snapshot_rows(spark, sf):
    """A snapshot of the orders table, written and read back (the newest one)."""
    root = _scratch(spark, "snapshots")
    A.write_snapshot(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), root, "orders")
    return A.read_snapshot(spark, root, "orders").drop("snapshot_ts")
