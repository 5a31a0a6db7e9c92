"""Request-log monitoring: windows, counters, histograms, alerts and state machines.

Time windows use ``window()`` grouping (tumbling / sliding) so they work
unchanged on streams. Ordered work per key (alert cooldown, request cache,
islands, moving averages) is cut in time by ``keyed``, so a hot key spreads
over tasks. The token bucket and circuit breaker replays are per-key scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.functions.exprs import q, quantiles_long, safe_div
from sparkclin.operators.keyed import CHUNK, HOT, HOT_ROWS, REAL, cut, fire_with_cooldown, is_cut, join_same, with_halo
from sparkclin.session import stored

# Latency histogram upper bounds in seconds.
LATENCY_BUCKETS_S = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0]
# Monitor thresholds (metric, comparison, threshold, severity).
METRIC_THRESHOLDS = [("cpu_percent", ">", 80.0, "warning"), ("memory_percent", ">", 85.0, "warning"),
                     ("error_rate", ">", 0.05, "critical"), ("p95_latency_ms", ">", 1000.0, "warning")]


def _ts(c: str = "ts") -> Column:
    return F.col(c).cast("timestamp")


def _event_ts(df: DataFrame, c: str = "ts") -> Column:
    """Event time as TIMESTAMP; left untouched when it already is one, so a watermark on it stays visible."""
    return F.col(c) if dict(df.dtypes).get(c) == "timestamp" else F.col(c).cast("timestamp")


def _seconds(window: Column) -> Column:
    """Length of a window struct in seconds."""
    return (F.unix_micros(window["end"]) - F.unix_micros(window["start"])) / 1e6


def canary_guard(log: DataFrame, track: str = "track", latency_ms: str = "latency_ms", status: str = "status",
                 window: str = "5 minutes", canary: str = "canary", baseline: str = "production",
                 max_error_rate: float = 0.05, max_p95_s: float = 2.0, min_rate: float = 5.0,
                 approx: bool = False) -> DataFrame:
    """Per 5-minute window and track: error rate, p95 latency, request rate; guard flags.

    Canary and baseline rows of the same window are paired by a join on the
    window (a small table: windows × 2 tracks).
    """
    timed = log.withColumn("w", F.window(_ts(), window))
    g = timed.groupBy("w", track).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(status) >= 400).cast("double")).alias("error_rate"),
        *([F.expr(f"percentile_approx({latency_ms}, 0.95, 10000)").alias("p95_ms")] if approx else []))
    if not approx:
        g = join_same(g, quantiles_long(timed, [0.95], ["w", track], latency_ms), ["w", track])
        g = g.withColumn("p95_ms", F.get("__q", F.lit(0))).drop("__q")
    g = g.withColumn("__s", _seconds(F.col("w")))
    c = g.where(F.col(track) == canary).select("__s", F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("n").alias("canary_n"),
                                               F.col("error_rate").alias("canary_error_rate"), F.col("p95_ms").alias("canary_p95_ms"))
    b = g.where(F.col(track) == baseline).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("n").alias("baseline_n"),
                                                 F.col("error_rate").alias("baseline_error_rate"))
    j = c.join(b, "window_start", "left")
    return j.select(*[x for x in j.columns if x != "__s"], (F.col("canary_error_rate") > max_error_rate).alias("error_rate_alert"),
                    (F.col("canary_p95_ms") / 1000.0 > max_p95_s).alias("latency_alert"),
                    (F.col("canary_n") / F.col("__s") < min_rate).alias("low_traffic_alert"),
                    (F.col("canary_error_rate") - F.coalesce(F.col("baseline_error_rate"), F.lit(0.0)) > max_error_rate)
                    .alias("regression_alert"))


def recent_aggregates(log: DataFrame, n: int = 100, latency_ms: str = "latency_ms", status: str = "status",
                      order: list[str] | None = None) -> DataFrame:
    """Over the last ``n`` requests: avg, p95, p99 latency (sorted index) and error rate.

    ``orderBy(desc).limit(n)`` is a top-k (each task keeps n rows), so the
    small frame that follows never needs a full sort of the log.
    """
    order = order or ["ts", "event_id"]
    last = log.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    w = Window.orderBy(F.col(latency_ms))  # at most n rows
    r = last.select(F.col(latency_ms).cast("double").alias("l"), (F.col(status) >= 400).cast("double").alias("e"),
                    F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy()).alias("cnt"))
    pick = lambda qv: F.max(F.when(F.col("rn") == F.floor(F.col("cnt") * qv) + 1, F.col("l")))
    return r.agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("avg_latency_ms"), pick(0.95).alias("p95_latency_ms"),
                 pick(0.99).alias("p99_latency_ms"), F.avg("e").alias("error_rate"))


def metric_thresholds(metrics: DataFrame, thresholds=METRIC_THRESHOLDS) -> DataFrame:
    """Long-form metric rows (metric, value, ...) joined to the threshold table → alert rows."""
    spark = metrics.sparkSession
    th = spark.createDataFrame(thresholds, "metric string, op string, threshold double, severity string")
    j = metrics.join(F.broadcast(th), "metric")
    fire = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return j.where(fire)


def metric_range(log: DataFrame, minutes: int, as_of: Column | None = None, endpoint: str | None = None,
                 ts: str = "ts") -> DataFrame:
    """Rows of the last ``minutes`` before ``as_of`` (default newest ts), optionally one endpoint."""
    if as_of is None:
        mx = log.agg(F.max(_ts(ts)).alias("__asof"))
        out = log.crossJoin(F.broadcast(mx)).where(
            _ts(ts) >= F.col("__asof") - F.expr(f"INTERVAL {int(minutes)} MINUTES")).drop("__asof")
    else:
        out = log.where(_ts(ts) >= as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    if endpoint is not None:
        out = out.where(F.col("endpoint") == endpoint)
    return out


# ------------------------------------------------------------------ H34 alert rules with cooldown
# Default alert rules (name, SQL condition, severity, channels, cooldown seconds).
DEFAULT_ALERT_RULES = [
    ("high_cpu_usage", "cpu_percent > 80", "high", ["slack", "email"], 300),
    ("high_memory_usage", "memory_percent > 85", "high", ["slack", "email"], 300),
    ("disk_usage_high", "disk_percent > 90", "medium", ["slack"], 300),
    ("model_performance_drop", "recall_drop > 0.1", "critical", ["slack", "pagerduty"], 300),
    ("high_error_rate", "error_rate > 0.05", "critical", ["slack", "email"], 300),
    ("high_latency", "p95_latency_ms > 1000", "medium", ["slack"], 300),
    ("data_drift_detected", "drift_detected", "high", ["slack", "email"], 300),
    ("model_drift_detected", "model_drift_detected", "critical", ["slack", "pagerduty"], 300),
    ("fairness_violation", "size(fairness_violations) > 0", "high", ["slack", "email"], 300),
]
# Metrics the default rules read, with their types: one that a table lacks is NULL there and fires nothing.
METRIC_TYPES = {
    "cpu_percent": "double", "memory_percent": "double", "disk_percent": "double", "recall_drop": "double",
    "error_rate": "double", "p95_latency_ms": "double", "drift_detected": "boolean",
    "model_drift_detected": "boolean", "fairness_violations": "array<string>",
}


def alert_candidates(metrics: DataFrame, rules=DEFAULT_ALERT_RULES, ts: str = "ts", id_col: str = "sample_id") -> DataFrame:
    """Rule predicates compiled as columns, unpivoted to (rule, ts, id) rows where they hold.

    Every rule is evaluated. A known metric (``METRIC_TYPES``) that the table
    lacks is NULL; a rule over any other absent column is an analysis error.
    """
    have = set(metrics.columns)
    full = metrics.select("*", *[F.lit(None).cast(t).alias(c) for c, t in METRIC_TYPES.items() if c not in have])
    items = [F.when(F.expr(f"coalesce({cond}, false)"), F.struct(
        F.lit(name).alias("rule_name"), F.lit(sev).alias("severity"), F.lit(cd).alias("cooldown_s")))
        for name, cond, sev, _, cd in rules]
    x = full.select(ts, id_col, F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("r"))
    return x.select(ts, id_col, "r.*")


def evaluate_alert_rules(metrics: DataFrame, rules=DEFAULT_ALERT_RULES, ts: str = "ts",
                         id_col: str = "sample_id") -> DataFrame:
    """A rule fires when its condition holds and ≥ cooldown seconds passed since it last fired."""
    c = alert_candidates(metrics, rules, ts, id_col)
    return fire_with_cooldown(c, ["rule_name"], ts, id_col, F.col("cooldown_s")).where("fires").drop("fires")


def alert_routing(alerts: DataFrame, rules=DEFAULT_ALERT_RULES, ts: str = "ts", id_col: str = "sample_id") -> DataFrame:
    """One row per (alert, channel) with message text and a per-day dedup key: the earliest (ts, id) of a key."""
    spark = alerts.sparkSession
    rt = spark.createDataFrame([(n, ch) for n, _, _, ch, _ in rules], "rule_name string, channels array<string>")
    j = alerts.join(F.broadcast(rt), "rule_name")
    out = j.select("*", F.explode("channels").alias("channel")).drop("channels")
    out = out.withColumn("message", F.format_string("[%s] %s triggered at %s", F.upper(F.col("severity")),
                                                    F.col("rule_name"), F.col(ts).cast("string")))
    out = out.withColumn("dedup_key", F.concat_ws("_", F.col("rule_name"), F.date_format(_ts(ts), "yyyyMMdd"),
                                                  F.col("channel")))
    rest = [c for c in out.columns if c != "dedup_key"]
    first = out.groupBy("dedup_key").agg(F.min_by(F.struct(*rest), F.struct(F.col(ts), F.col(id_col))).alias("a"))
    return first.select("a.*", "dedup_key")


def alert_history_stats(alerts: DataFrame, as_of: Column, days: int = 7, severity: str | None = None,
                        status: str | None = None, ts: str = "ts") -> DataFrame:
    """Alerts of the last ``days`` by severity and status."""
    a = alerts.where(_ts(ts) >= as_of.cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    if severity:
        a = a.where(F.col("severity") == severity)
    if status:
        a = a.where(F.col("status") == status)
    return a.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))


def acknowledge_alerts(alerts: DataFrame, acks: DataFrame, id_col: str = "alert_id") -> DataFrame:
    """H36 update: acknowledged / resolved states applied by a left join."""
    a = acks.select(id_col, F.col("action").alias("__a"), F.col("user").alias("__u"))
    j = alerts.join(a, id_col, "left")
    return (j.withColumn("status", F.when(F.col("__a") == "resolve", "resolved")
                         .when(F.col("__a") == "acknowledge", "acknowledged").otherwise(F.col("status")))
            .withColumn("acknowledged_by", F.when(F.col("__a") == "acknowledge", F.col("__u")))
            .drop("__a", "__u"))


def request_counters(log: DataFrame, labels: list[str]) -> DataFrame:
    """Request counts by label set."""
    return log.groupBy(*labels).agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(log: DataFrame, latency_s: Column, buckets=LATENCY_BUCKETS_S,
                      group_cols: list[str] | None = None) -> DataFrame:
    """Cumulative ``le`` buckets with sum and count (one aggregate, one row per bucket)."""
    g = list(group_cols or [])
    agg = log.groupBy(*g).agg(*[F.count_if(latency_s <= b).alias(f"__b{i}") for i, b in enumerate(buckets)],
                              F.count(F.lit(1)).alias("count"), F.sum(latency_s).alias("sum"))
    items = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    items.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative")))
    return agg.select(*g, "count", "sum", F.explode(F.array(*items)).alias("b")).select(*g, "b.le", "b.cumulative",
                                                                                        "count", "sum")


def rate_over_window(log: DataFrame, window: str = "5 minutes", slide: str = "1 minute", labels=None,
                     status: str = "status", alert: float = 0.05) -> DataFrame:
    """Events per second over sliding windows per label; error ratio and its alert."""
    g = log.groupBy(F.window(_event_ts(log), window, slide).alias("w"), *(labels or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) >= 400).alias("errors"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), *(labels or []), "n",
                    (F.col("n") / _seconds(F.col("w"))).alias("rate"), (F.col("errors") / F.col("n")).alias("error_ratio"),
                    (F.col("errors") / F.col("n") > alert).alias("alert"))


def histogram_quantile(hist: DataFrame, qv: float, group_cols: list[str] | None = None) -> DataFrame:
    """Quantile by linear interpolation inside the first bucket whose cumulative count ≥ q·n."""
    g = list(group_cols or [])
    w = Window.partitionBy(*g).orderBy("le")  # per group: one row per bucket
    h = hist.withColumn("__ple", F.coalesce(F.lag("le").over(w), F.lit(0.0))) \
            .withColumn("__pc", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
    target = F.col("count") * qv
    hit = h.where(F.col("cumulative") >= target)
    first = hit.groupBy(*g).agg(F.min_by(F.struct("le", "__ple", "__pc", "cumulative", "count"), F.col("le")).alias("b"))
    b = F.col("b")
    val = F.when(F.isnan(b["le"]) | (b["le"] == float("inf")), b["__ple"]).otherwise(
        b["__ple"] + (b["le"] - b["__ple"]) * safe_div(b["count"] * qv - b["__pc"], b["cumulative"] - b["__pc"]))
    return first.select(*g, val.alias("quantile"))


def sustained_condition(df: DataFrame, key: list[str], ts: str, cond: Column, min_seconds: float,
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """Islands of consecutive rows where ``cond`` holds (gaps-and-islands per key);
    an island alerts when it lasts at least ``min_seconds``.

    A key of more than ``hot_rows`` rows is cut in time: a chunk numbers its changes against a halo of one row, and the
    changes of the chunks before it are added to the numbers of its islands, which joins an island that spans chunks.
    """
    x = with_halo(cut(df.select(*key, ts, cond.alias("__c")), key, ts, hot_rows), [ts], 1)
    w = Window.partitionBy(*key, CHUNK).orderBy(ts)
    last = F.lag("__c").over(w)
    x = x.withColumn("__chg", (F.col("__c") != F.coalesce(last, ~F.col("__c"))).cast("int")).where(REAL)
    x = x.withColumn("__isl", F.coalesce(F.sum("__chg").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    part = x.groupBy(*key, HOT, CHUNK, "__isl").agg(
        F.min(F.when(F.col("__c"), F.col(ts))).alias("start"), F.max(F.when(F.col("__c"), F.col(ts))).alias("end"),
        F.count_if("__c").alias("n"))
    if is_cut(x):
        part = stored(part, "islands")
        changes = part.where(F.col(HOT).isNotNull()).groupBy(HOT, CHUNK).agg(F.max("__isl").alias("__m"))
        before = Window.partitionBy(HOT).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # over one row a chunk
        changes = changes.select(HOT, CHUNK, F.sum("__m").over(before).alias("__before"))
        part = join_same(part, changes, [HOT, CHUNK]).withColumn("__isl", F.col("__isl") + F.coalesce("__before", F.lit(0)))
        part = part.groupBy(*key, "__isl").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    isl = part.where(F.col("n") > 0)
    dur = F.unix_micros(F.col("end").cast("timestamp")) / 1e6 - F.unix_micros(F.col("start").cast("timestamp")) / 1e6
    return isl.select(*key, "start", "end", "n", dur.alias("duration_s"), (dur >= min_seconds).alias("alert"))


def ema_latency(log: DataFrame, key: list[str], order: list[str], latency_ms: str = "latency_ms",
                alpha: float = 0.1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Avg ← (1 − α)·avg + α·x starting at 0, per key in (ts, id) order, over the whole history.

    The recurrence is an associative scan. Each chunk of a key is folded from 0 in one pass; the chunks of a cut key
    (their row count and folded value, one row each) are combined in order; and each row adds its chunk's incoming
    average, decayed by its place in the chunk. A row without a latency repeats the average before it. Every row
    stays, also one without key or time.
    """
    import pandas as pd
    names = log.columns
    x = cut(log.withColumn("__x", F.col(latency_ms).cast("double")), key, order[0], hot_rows)

    def folded(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        nulls_first = pc.sort_indices(table.select(order), sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
        table = table.take(nulls_first)
        v = table.column("__x").to_numpy()
        given = ~np.isnan(v)
        place = np.cumsum(given)
        average = pd.Series(np.concatenate([[0.0], v[given]])).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        return table, average[place], place

    def rows(table: pa.Table) -> pa.Table:
        table, average, place = folded(table)
        return table.select([*names, HOT, CHUNK]).append_column("__local", pa.array(average)).append_column("__place", pa.array(place))

    def end(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, average, place = folded(table)
        return pa.table({HOT: [key_[0].as_py()], CHUNK: pa.array([key_[1].as_py()], pa.int32()), "__s": average[-1:], "__n": place[-1:]})

    types = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in log.schema.fields)
    local = x.groupBy(*[F.col(q(k)) for k in key], CHUNK).applyInArrow(rows, f"{types}, {HOT} long, {CHUNK} int, __local double, __place long")
    ema = F.col("__local")
    if is_cut(x):
        ends = x.where(F.col(HOT).isNotNull()).groupBy(HOT, CHUNK).applyInArrow(end, f"{HOT} long, {CHUNK} int, __s double, __n long")

        def carry(pdf):
            pdf = pdf.sort_values(CHUNK)
            out, state = [], 0.0
            for s, n in zip(pdf["__s"], pdf["__n"]):
                out.append(state)
                state = state * (1 - alpha) ** n + s
            return pdf.assign(__in=out).drop(columns=["__s", "__n"])

        into = ends.groupBy(HOT).applyInPandas(carry, f"{HOT} long, {CHUNK} int, __in double")  # a row a chunk
        local = join_same(local, into, [HOT, CHUNK])
        ema = ema + F.coalesce("__in", F.lit(0.0)) * F.pow(F.lit(1.0 - alpha), F.col("__place"))
    return local.select(*[F.col(q(c)) for c in names], ema.alias("ema_latency_ms"))


def rolling_latency_quantiles(log: DataFrame, key: list[str], order: list[str], latency_ms: str = "latency_ms",
                              window: int = 1000, min_count: int = 100, every: int = 100) -> DataFrame:
    """At every ``every``-th request, p95 / p99 = sorted[int(n·q)] over the last ``window`` latencies.

    Positions per key come from prefix sums over the event-time microseconds
    (ties broken by a row number inside one timestamp), so no key-wide
    window. Each row belongs to at most ``window / every`` reporting points;
    it is exploded to those only and each report collects ≤ ``window``
    values: O(rows · window/every) work instead of a list per row.
    """
    from sparkclin.functions.exprs import cumulative_sums
    t = (F.unix_micros(_event_ts(log, order[0])).cast("double")).alias("__t")
    base = log.select(*key, *order, F.col(latency_ms).cast("double").alias("__l"), t)
    cnt = base.groupBy(*key, "__t").agg(F.count(F.lit(1)).alias("__c"))
    cum = cumulative_sums(cnt, "__t", ["__c"], key).select(*key, "__t", (F.col("cum___c") - F.col("__c")).alias("__before"))
    rn = F.row_number().over(Window.partitionBy(*key, "__t").orderBy(*order[1:] or order))
    pos = join_same(base, cum, key + ["__t"], "inner").withColumn("__i", F.col("__before") + rn)  # 1-based position
    first = F.ceil(F.col("__i") / every).cast("long")
    last = F.floor((F.col("__i") + window - 1) / every).cast("long")
    ex = pos.select(*key, *order, "__l", "__i", F.explode(F.sequence(first, last)).alias("__rep"))
    ex = ex.where((F.col("__rep") * every >= F.col("__i")) & (F.col("__rep") * every - F.col("__i") < window))
    here = ex.where(F.col("__i") == F.col("__rep") * every).select(*key, "__rep", *order)
    lists = ex.groupBy(*key, "__rep").agg(F.array_sort(F.collect_list("__l")).alias("__a"))
    rep = join_same(lists, here, key + ["__rep"], "inner")
    n = F.size("__a")
    return rep.where(n >= min_count).select(*key, *order, n.alias("n"),
                                            F.element_at("__a", F.floor(n * 0.95).cast("int") + 1).alias("p95"),
                                            F.element_at("__a", F.floor(n * 0.99).cast("int") + 1).alias("p99"))


# ------------------------------------------------------------------ H44 / H45 state machines
def _token_bucket(limit: float, period_s: float, idle_s: float):
    """Scan of rows sorted by (key, time, id): the bucket goes on from batch to batch, so no key is held whole."""
    cap = int(1.5 * limit)
    rate = limit / period_s

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, last = (), float(cap), None  # no key equals an empty tuple
        for b in batches:
            allowed, retry = [], []
            times = pc.fill_null(b.column("__t"), float("nan")).to_pylist()  # a row without a time finds a full bucket
            for key, t in zip(b.column("rl_key").to_pylist(), times):
                if key != held:
                    held, tokens, last = key, float(cap), None
                if last is not None and t - last > idle_s:
                    tokens = float(cap)
                elif last is not None:
                    tokens = min(cap, tokens + (t - last) * rate)
                last = t
                if tokens >= 1:
                    tokens -= 1
                    allowed.append(True)
                    retry.append(0.0)
                else:
                    allowed.append(False)
                    retry.append((1 - tokens) / rate)
            names = [n for n in b.schema.names if n != "__t"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(allowed, pa.bool_()), pa.array(retry, pa.float64())],
                                             names=[*names, "allowed", "retry_after_s"])
    return scan


def rate_limit_replay(log: DataFrame, key: Column, limit: float = 100, period_s: float = 60.0,
                      idle_s: float = 3600.0, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Token bucket per key replayed over a request log (capacity int(1.5·limit),
    refill limit/period per second, allow when ≥ 1 token; idle keys reset after 3600 s).

    A task replays all keys of its sorted partition in one pass; a call per key would cost more than the key's rows."""
    x = log.select(key.cast("string").alias("rl_key"), F.col(id_col).cast("long").alias("__id"), F.col(ts).cast("timestamp_ntz").alias(ts),
                   (F.unix_micros(_ts(ts)) / 1e6).alias("__t"))
    return x.repartition("rl_key").sortWithinPartitions("rl_key", F.asc_nulls_last("__t"), F.asc_nulls_last("__id")).mapInArrow(
        _token_bucket(limit, period_s, idle_s),
        f"rl_key string, __id long, {ts} timestamp_ntz, allowed boolean, retry_after_s double") \
        .withColumnRenamed("__id", id_col)


def _breaker(threshold: int, wait_s: float, half_open_max: int, close_after: int):
    def scan(pdf):
        pdf = pdf.sort_values(["__t", "__id"])
        state, fails, opened, trials, succ = "CLOSED", 0, None, 0, 0
        states, admitted = [], []
        for t, ok in zip(pdf["__t"], pdf["__ok"]):
            if state == "OPEN" and t - opened >= wait_s:
                state, trials, succ = "HALF_OPEN", 0, 0
            if state == "OPEN" or (state == "HALF_OPEN" and trials >= half_open_max):
                states.append(state)
                admitted.append(False)
                continue
            admitted.append(True)
            if state == "HALF_OPEN":
                trials += 1
                if ok:
                    succ += 1
                    if succ >= close_after:
                        state, fails = "CLOSED", 0
                else:
                    state, opened = "OPEN", t
            else:
                fails = 0 if ok else fails + 1
                if fails >= threshold:
                    state, opened = "OPEN", t
            states.append(state)
        out = pdf.drop(columns=["__t", "__ok"]).copy()
        out["admitted"] = admitted
        out["state_after"] = states
        return out
    return scan


def outage_states(log: DataFrame, key: str = "endpoint", ok: Column | None = None, threshold: int = 5,
                  wait_s: float = 30.0, half_open_max: int = 3, close_after: int = 2, ts: str = "ts",
                  id_col: str = "event_id") -> DataFrame:
    """Circuit-breaker timeline per key: 5 consecutive failures open it, after 30 s it
    half-opens for ≤ 3 trial calls, 2 successes close it, a trial failure reopens it."""
    ok = ok if ok is not None else (F.col("status") < 500)
    x = log.select(F.col(key), F.col(id_col).alias("__id"), F.col(ts), (F.unix_micros(_ts(ts)) / 1e6).alias("__t"),
                   ok.alias("__ok"))
    return x.groupBy(key).applyInPandas(
        _breaker(threshold, wait_s, half_open_max, close_after),
        f"{key} string, __id long, {ts} timestamp_ntz, admitted boolean, state_after string") \
        .withColumnRenamed("__id", id_col)


def request_key(cols: list[str]) -> Column:
    """md5 of the inputs as JSON with sorted field names (H46 cache key)."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])))


def dedupe_requests(log: DataFrame, cols: list[str], ts: str = "ts", id_col: str = "event_id",
                    ttl_s: float = 300.0) -> DataFrame:
    """A miss stores the result for ``ttl_s`` seconds; identical requests until then are hits.

    Only a miss sets the lifetime, so a miss is a firing with the lifetime as
    its cooldown.
    """
    x = log.withColumn("request_key", request_key(cols))
    x = fire_with_cooldown(x, ["request_key"], ts, id_col, F.lit(ttl_s))
    return x.withColumn("cache_hit", ~F.col("fires")).drop("fires")


def audit_log_page(log: DataFrame, page: int = 1, page_size: int = 50, user: int | None = None,
                   start=None, end=None, ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """Filter, order, one page (size clamped to 1–1000) with total / pages / next / previous."""
    size = max(1, min(1000, int(page_size)))
    page = max(1, int(page))
    x = log
    if user is not None:
        x = x.where(F.col("user_id") == user)
    if start is not None:
        x = x.where(F.col(ts) >= F.lit(start))
    if end is not None:
        x = x.where(F.col(ts) <= F.lit(end))
    order = order or [ts, "event_id"]
    rows = x.orderBy(*[F.col(c).desc() for c in order]).offset((page - 1) * size).limit(size)
    tot = x.agg(F.count(F.lit(1)).alias("total"))
    meta = tot.select("total", F.ceil(F.col("total") / size).cast("bigint").alias("pages"),
                      (F.lit(page) < F.ceil(F.col("total") / size)).alias("has_next"), F.lit(page > 1).alias("has_previous"))
    return rows.crossJoin(F.broadcast(meta))


def audit_report_stats(audits: DataFrame, findings: str = "findings", ts: str = "ts") -> DataFrame:
    """Audits total, last audit time, critical and high findings."""
    f = audits.select(F.explode_outer(findings).alias("f"))
    c = f.agg(F.count_if(F.col("f.severity") == "critical").alias("critical_findings"),
              F.count_if(F.col("f.severity") == "high").alias("high_findings"))
    a = audits.agg(F.count(F.lit(1)).alias("total_audits"), F.max(ts).alias("last_audit"))
    return a.crossJoin(c)
