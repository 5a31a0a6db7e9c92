"""Registered queries for request-log monitoring (H30–H48) on ``reqlog_v``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.functions.exprs import quantiles_long
from sparkclin.operators import ops as X
from sparkclin.plans.registry import register
from sparkclin.sources.views import reqlog

_T = "ts"


@register("canary_guard", dbl=["canary_error_rate", "canary_p95_ms", "baseline_error_rate"], sql="""
WITH g AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, track, count(*) AS n,
                  avg(CAST(status >= 400 AS DOUBLE)) AS error_rate, quantile_cont(latency_ms, 0.95) AS p95_ms
           FROM reqlog_v GROUP BY 1, 2),
c AS (SELECT window_start, n AS canary_n, error_rate AS canary_error_rate, p95_ms AS canary_p95_ms FROM g WHERE track = 'canary'),
b AS (SELECT window_start, n AS baseline_n, error_rate AS baseline_error_rate FROM g WHERE track = 'production')
SELECT c.*, b.baseline_n, b.baseline_error_rate, canary_error_rate > 0.05 AS error_rate_alert,
       canary_p95_ms / 1000.0 > 2.0 AS latency_alert, canary_n / 300.0 < 5.0 AS low_traffic_alert,
       canary_error_rate - coalesce(baseline_error_rate, 0.0) > 0.05 AS regression_alert
FROM c LEFT JOIN b USING (window_start)""")
def q_canary_guard(spark, sf):
    return X.canary_guard(reqlog(spark, sf))


@register("recent_aggregates", dbl=["avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate"], sql="""
WITH l AS (SELECT latency_ms, status FROM reqlog_v ORDER BY ts DESC, event_id DESC LIMIT 100),
r AS (SELECT CAST(latency_ms AS DOUBLE) AS l, CAST(status >= 400 AS DOUBLE) AS e, row_number() OVER (ORDER BY latency_ms) AS rn,
             count(*) OVER () AS cnt FROM l)
SELECT count(*) AS n, avg(l) AS avg_latency_ms, max(CASE WHEN rn = floor(cnt * 0.95) + 1 THEN l END) AS p95_latency_ms,
       max(CASE WHEN rn = floor(cnt * 0.99) + 1 THEN l END) AS p99_latency_ms, avg(e) AS error_rate FROM r""")
def q_recent_aggregates(spark, sf):
    return X.recent_aggregates(reqlog(spark, sf))


_TH = ", ".join(f"('{m}', '{o}', CAST({t} AS DOUBLE), '{s}')" for m, o, t, s in X.METRIC_THRESHOLDS)


@register("metric_thresholds", dbl=["value", "threshold"], sql=f"""
WITH m AS (SELECT endpoint, avg(CAST(status >= 400 AS DOUBLE)) AS error_rate, quantile_cont(latency_ms, 0.95) AS p95_latency_ms
           FROM reqlog_v GROUP BY endpoint),
l AS (SELECT endpoint, 'error_rate' AS metric, error_rate AS value FROM m UNION ALL SELECT endpoint, 'p95_latency_ms', p95_latency_ms FROM m),
th AS (SELECT * FROM (VALUES {_TH}) v(metric, op, threshold, severity))
SELECT l.metric, l.endpoint, l.value, th.op, th.threshold, th.severity FROM l JOIN th USING (metric)
WHERE CASE WHEN th.op = '>' THEN l.value > th.threshold ELSE l.value < th.threshold END""")
def q_metric_thresholds(spark, sf):
    r = reqlog(spark, sf)
    m = r.groupBy("endpoint").agg(F.avg((F.col("status") >= 400).cast("double")).alias("error_rate"))
    m = m.join(quantiles_long(r, [0.95], ["endpoint"], "latency_ms"), "endpoint").withColumn("p95_latency_ms", F.get("__q", F.lit(0)))
    long = m.select("endpoint", F.explode(F.array(
        F.struct(F.lit("error_rate").alias("metric"), F.col("error_rate").alias("value")),
        F.struct(F.lit("p95_latency_ms").alias("metric"), F.col("p95_latency_ms").alias("value")))).alias("s")) \
        .select("endpoint", "s.*")
    return X.metric_thresholds(long).select("metric", "endpoint", "value", "op", "threshold", "severity")


@register("metric_range", sql="""
SELECT endpoint, count(*) AS n, count_if(status >= 400) AS errors FROM reqlog_v
WHERE ts >= (SELECT max(ts) FROM reqlog_v) - INTERVAL 600 MINUTE GROUP BY endpoint""")
def q_metric_range(spark, sf):
    r = X.metric_range(reqlog(spark, sf), 600)
    return r.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("errors"))


def _minute_metrics(spark, sf):
    r = reqlog(spark, sf)
    r = r.withColumn("w", F.window(F.col("ts").cast("timestamp"), "1 minute"))
    g = r.groupBy("w").agg(F.avg((F.col("status") >= 400).cast("double")).alias("error_rate"),
                           (F.count(F.lit(1)) / 60.0).alias("throughput"))
    g = g.join(quantiles_long(r, [0.95], ["w"], "latency_ms"), "w").withColumn("p95_latency_ms", F.get("__q", F.lit(0)))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("ts"),
                    F.unix_seconds(F.col("w.start")).alias("sample_id"), "error_rate", "p95_latency_ms", "throughput")


_MM = """
WITH RECURSIVE mm AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS ts, avg(CAST(status >= 400 AS DOUBLE)) AS error_rate,
                   quantile_cont(latency_ms, 0.95) AS p95_latency_ms FROM reqlog_v GROUP BY 1),
cand AS (SELECT ts, 'high_error_rate' AS rule_name, 'critical' AS severity FROM mm WHERE error_rate > 0.05
         UNION ALL SELECT ts, 'high_latency', 'medium' FROM mm WHERE p95_latency_ms > 1000)"""


@register("evaluate_alert_rules", sql=_MM + """,
later AS MATERIALIZED (SELECT a.rule_name, a.ts, b.ts AS next_ts FROM cand a ASOF LEFT JOIN cand b
          ON a.rule_name = b.rule_name AND a.ts + INTERVAL 300 SECOND <= b.ts),
fired AS (SELECT rule_name, min(ts) AS ts FROM cand GROUP BY rule_name
          UNION ALL SELECT l.rule_name, l.next_ts FROM fired f JOIN later l ON f.rule_name = l.rule_name AND f.ts = l.ts
          WHERE l.next_ts IS NOT NULL)
SELECT f.rule_name, f.ts, c.severity FROM fired f JOIN cand c ON f.rule_name = c.rule_name AND f.ts = c.ts""")
def q_evaluate_alert_rules(spark, sf):
    return X.evaluate_alert_rules(_minute_metrics(spark, sf)).select("rule_name", "ts", "severity")


_CH = {n: ch for n, _, _, ch, _ in X.DEFAULT_ALERT_RULES}


@register("alert_routing", sql=_MM + """,
rt AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {ch!r})".replace('"', "'") for n, ch in _CH.items()) + """) v(rule_name, channels)),
x AS (SELECT cand.rule_name, cand.severity, cand.ts, unnest(rt.channels) AS channel FROM cand JOIN rt USING (rule_name))
SELECT rule_name, severity, channel, min(ts) AS ts,
       '[' || upper(severity) || '] ' || rule_name || ' triggered at ' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS message,
       concat_ws('_', rule_name, strftime(ts, '%Y%m%d'), channel) AS dedup_key
FROM x GROUP BY rule_name, severity, channel, strftime(ts, '%Y%m%d')""")
def q_alert_routing(spark, sf):
    c = X.alert_candidates(_minute_metrics(spark, sf))
    return X.alert_routing(c).select("rule_name", "severity", "channel", "ts", "message", "dedup_key")


@register("alert_history_stats", sql=_MM + """
SELECT severity, 'open' AS status, count(*) AS n FROM cand WHERE ts >= (SELECT max(ts) FROM reqlog_v) - INTERVAL 7 DAY
GROUP BY severity""")
def q_alert_history_stats(spark, sf):
    c = X.alert_candidates(_minute_metrics(spark, sf)).withColumn("status", F.lit("open"))
    mx = reqlog(spark, sf).agg(F.max("ts").alias("newest"))  # one row
    return X.alert_history_stats(c.crossJoin(F.broadcast(mx)), F.col("newest"), days=7)


@register("request_counters", sql="SELECT endpoint, status, count(*) AS requests FROM reqlog_v GROUP BY endpoint, status")
def q_request_counters(spark, sf):
    return X.request_counters(reqlog(spark, sf), ["endpoint", "status"])


_BUCKETS = X.LATENCY_BUCKETS_S
_HIST_SQL = """
WITH a AS (SELECT endpoint, """ + ", ".join(f"count_if(latency_ms / 1000.0 <= {b}) AS b{i}" for i, b in enumerate(_BUCKETS)) + """,
                  count(*) AS count, sum(latency_ms / 1000.0) AS sum FROM reqlog_v GROUP BY endpoint),
h AS (""" + "\nUNION ALL ".join(f"SELECT endpoint, CAST({b} AS DOUBLE) AS le, b{i} AS cumulative, count, sum FROM a"
                                for i, b in enumerate(_BUCKETS)) + """
      UNION ALL SELECT endpoint, CAST('inf' AS DOUBLE), count, count, sum FROM a)"""


@register("latency_histogram", dbl=["le", "sum"], sql=_HIST_SQL + " SELECT * FROM h")
def q_latency_histogram(spark, sf):
    r = reqlog(spark, sf)
    return X.latency_histogram(r, F.col("latency_ms") / 1000.0, group_cols=["endpoint"])


@register("rate_over_window", dbl=["rate", "error_ratio"], sql="""
WITH e AS (SELECT track, status, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(i AS BIGINT)) AS ws
           FROM reqlog_v, range(0, 5) t(i))
SELECT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, track, count(*) AS n, count(*) / 300.0 AS rate,
       CAST(count_if(status >= 400) AS DOUBLE) / count(*) AS error_ratio, CAST(count_if(status >= 400) AS DOUBLE) / count(*) > 0.05 AS alert
FROM e GROUP BY ws, track""")
def q_rate_over_window(spark, sf):
    return X.rate_over_window(reqlog(spark, sf), labels=["track"])


@register("histogram_quantile", dbl=["quantile"], sql=_HIST_SQL + """,
w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY endpoint ORDER BY le), 0.0) AS ple,
             coalesce(lag(cumulative) OVER (PARTITION BY endpoint ORDER BY le), 0) AS pc FROM h),
f AS (SELECT endpoint, arg_min({'le': le, 'ple': ple, 'pc': pc, 'cum': cumulative, 'cnt': count}, le) AS b
      FROM w WHERE cumulative >= count * 0.95 GROUP BY endpoint)
SELECT endpoint, CASE WHEN isinf(b.le) THEN b.ple ELSE b.ple + (b.le - b.ple) *
       coalesce((b.cnt * 0.95 - b.pc) / nullif(CAST(b.cum - b.pc AS DOUBLE), 0), 0.0) END AS quantile FROM f""")
def q_histogram_quantile(spark, sf):
    h = X.latency_histogram(reqlog(spark, sf), F.col("latency_ms") / 1000.0, group_cols=["endpoint"])
    return X.histogram_quantile(h, 0.95, ["endpoint"])


@register("sustained_condition", dbl=["duration_s"], sql="""
WITH x AS (SELECT track, ts, latency_ms > 500 AS c FROM reqlog_v),
y AS (SELECT *, CAST(c <> coalesce(lag(c) OVER (PARTITION BY track ORDER BY ts), NOT c) AS INTEGER) AS chg FROM x),
z AS (SELECT *, sum(chg) OVER (PARTITION BY track ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM y),
i AS (SELECT track, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM z WHERE c GROUP BY track, isl)
SELECT track, start, "end", n, (epoch_us("end") - epoch_us(start)) / 1e6 AS duration_s,
       (epoch_us("end") - epoch_us(start)) / 1e6 >= 60 AS alert FROM i""")
def q_sustained_condition(spark, sf):
    r = reqlog(spark, sf)
    return X.sustained_condition(r, ["track"], "ts", F.col("latency_ms") > 500, 60)


@register("ema_latency", dbl=["ema_latency_ms"], sql="""
SELECT event_id, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(CAST(latency_ms AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), lambda acc, v: acc * (1 - 0.1) + v * 0.1) AS ema_latency_ms FROM reqlog_v""")
def q_ema_latency(spark, sf):
    r = reqlog(spark, sf).select("event_id", "user_id", "ts", "latency_ms")
    return X.ema_latency(r, ["user_id"], ["ts", "event_id"]).select("event_id", "ema_latency_ms")


@register("rolling_latency_quantiles", dbl=["p95", "p99"], sql="""
WITH x AS (SELECT endpoint, ts, event_id, row_number() OVER w AS i,
                  list_sort(list(CAST(latency_ms AS DOUBLE)) OVER (w ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)) AS a
           FROM reqlog_v WINDOW w AS (PARTITION BY endpoint ORDER BY ts, event_id))
SELECT endpoint, ts, event_id, CAST(len(a) AS INTEGER) AS n, a[CAST(floor(len(a) * 0.95) AS BIGINT) + 1] AS p95,
       a[CAST(floor(len(a) * 0.99) AS BIGINT) + 1] AS p99 FROM x WHERE i % 100 = 0 AND len(a) >= 100""")
def q_rolling_latency_quantiles(spark, sf):
    return X.rolling_latency_quantiles(reqlog(spark, sf), ["endpoint"], ["ts", "event_id"])


@register("rate_limit_replay")
def q_rate_limit_replay(spark, sf):
    r = reqlog(spark, sf)
    return X.rate_limit_replay(r, F.concat_ws(":", F.col("user_id").cast("string"), F.col("endpoint")), limit=5,
                               period_s=60.0)


@register("outage_states")
def q_outage_states(spark, sf):
    return X.outage_states(reqlog(spark, sf), "endpoint", ok=F.col("status") < 500)


@register("dedupe_requests", sql="""
WITH RECURSIVE k AS (SELECT event_id, ts, md5(to_json({'endpoint': endpoint, 'user_id': user_id})) AS request_key FROM reqlog_v),
n AS (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY ts, event_id) AS i FROM k),
g AS (SELECT request_key, ts, min(i) AS i FROM n GROUP BY request_key, ts),
later AS MATERIALIZED (SELECT a.request_key, a.i, b.i AS next_i FROM g a ASOF JOIN g b ON a.request_key = b.request_key AND a.ts + INTERVAL 300 SECOND <= b.ts),
miss AS (SELECT request_key, min(i) AS i FROM n GROUP BY request_key
         UNION ALL SELECT l.request_key, l.next_i FROM miss m JOIN later l ON m.request_key = l.request_key AND m.i = l.i)
SELECT n.event_id, n.request_key, m.i IS NULL AS cache_hit FROM n LEFT JOIN miss m ON n.request_key = m.request_key AND n.i = m.i""")
def q_dedupe_requests(spark, sf):
    r = X.dedupe_requests(reqlog(spark, sf), ["endpoint", "user_id"])
    return r.select("event_id", "request_key", "cache_hit")


@register("audit_log_page", dbl=["latency_ms"], sql="""
WITH t AS (SELECT count(*) AS total FROM reqlog_v)
SELECT r.event_id, r.ts, r.user_id, r.endpoint, r.latency_ms, t.total, CAST(ceil(t.total / 50.0) AS BIGINT) AS pages,
       3 < ceil(t.total / 50.0) AS has_next, true AS has_previous
FROM (SELECT * FROM reqlog_v ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100) r, t""")
def q_audit_log_page(spark, sf):
    p = X.audit_log_page(reqlog(spark, sf).select("event_id", "ts", "user_id", "endpoint", "latency_ms"), page=3, page_size=50)
    return p


@register("audit_report_stats", sql="""
SELECT count(*) AS total_audits, max(ts) AS last_audit,
       count_if(event_type = 'error') AS critical_findings, count_if(event_type = 'purchase') AS high_findings FROM events""")
def q_audit_report_stats(spark, sf):
    from sparkclin.sources.io import table
    e = table(spark, sf, "events")
    sev = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").otherwise("low")
    a = e.select("ts", F.array(F.struct(sev.alias("severity"))).alias("findings"))
    return X.audit_report_stats(a)
