"""Structured Streaming forms of the scoring, validation and monitoring operators.

The same column expressions serve batch and stream. Fitted constants
(medians, reference histograms) come from a static table and are joined
stream-static. Stateful operators carry a watermark or a state timeout so
state is bounded: windowed counts (I3, I4), dedupe within a watermark (I7),
a time-bounded stream-stream join (I8), and per-key state machines with
``applyInPandasWithState`` (I5, I6). Sinks are idempotent per micro-batch
(``foreachBatch`` writes keyed by ``batch_id``) and every query needs a
checkpoint location on shared storage.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from sparkclin.operators import model as E
from sparkclin.operators import ops as X
from sparkclin.operators import prep as P
from sparkclin.operators import protect as PR
from sparkclin.operators.features import clinical_features
from sparkclin.operators.store import latest_features
from sparkclin.sources.io import quarantine_split


def read_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """A file source (parquet directory); ``max_files`` bounds each micro-batch if given."""
    if schema is None:
        schema = spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Driver tables load ``timestamp_ntz``; watermarks need ``timestamp`` (UTC session)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def replace_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch as the partition of its id: writing it again leaves one copy."""
    (rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


# I1
def stream_score(stream: DataFrame, fitted_medians: DataFrame, coef: dict, intercept: float,
                 numeric: list[str]) -> DataFrame:
    """Protect (C8) → impute with medians fitted offline (stream-static) → features → linear score."""
    p = PR.protect_batch(stream, numeric)
    imp = P.impute_apply(p, fitted_medians)
    return E.score_linear(clinical_features(imp), coef, intercept)


# I2
def stream_validate(stream: DataFrame, good_path: str, quarantine_path: str, checkpoint: str,
                    errors_col: str = "errors"):
    """Good rows and quarantined rows to two tables per micro-batch; a replayed batch replaces its own partition."""
    def write(batch: DataFrame, batch_id: int):
        batch.persist()
        good, bad = quarantine_split(batch, errors_col)
        replace_batch(good, batch_id, good_path)
        replace_batch(bad, batch_id, quarantine_path)
        batch.unpersist()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# I3
def stream_request_rates(log: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                         watermark: str = "10 minutes", labels: list[str] | None = None) -> DataFrame:
    """Sliding-window request rates; late rows beyond the watermark are dropped."""
    x = event_time(log).withWatermark("ts", watermark)
    return X.rate_over_window(x, window, slide, labels=labels)


# I4
def stream_latency_histogram(log: DataFrame, latency_s_col: str = "latency_s", group_cols: list[str] | None = None,
                             window: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """H38 per event-time window, emitted in update mode."""
    x = event_time(log).withWatermark("ts", watermark)
    g = list(group_cols or [])
    buckets = X.LATENCY_BUCKETS_S
    lat = F.col(latency_s_col)
    return x.groupBy(F.window("ts", window).alias("w"), *g).agg(
        *[F.count_if(lat <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets],
        F.count(F.lit(1)).alias("count"), F.sum(lat).alias("sum"))


# Per-key state machines with bounded state
ALERT_STATE = T.StructType([T.StructField("last_fire", T.DoubleType())])
ALERT_OUT = T.StructType([T.StructField("rule_name", T.StringType()), T.StructField("ts", T.TimestampType()),
                          T.StructField("severity", T.StringType())])


def _alert_fn(key, pdfs, state):
    import pandas as pd
    last = state.get[0] if state.exists else None
    rows, parts = [], list(pdfs)
    if parts:  # a key's rows may come in several chunks: order holds across them
        pdf = pd.concat(parts).sort_values(["__t", "sample_id"])
        for t, ts, sev, cd in zip(pdf["__t"], pdf["ts"], pdf["severity"], pdf["cooldown_s"]):
            if last is None or t - last >= cd:
                rows.append((key[0], ts, sev))
                last = t
    if last is not None:
        state.update((float(last),))
        state.setTimeoutDuration(3600 * 1000)
    if state.hasTimedOut:
        state.remove()
    yield pd.DataFrame(rows, columns=["rule_name", "ts", "severity"])


def stream_alerts(metrics: DataFrame) -> DataFrame:
    """H34 with cooldown state per rule (state expires after an hour without firings)."""
    c = X.alert_candidates(metrics).withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return c.groupBy("rule_name").applyInPandasWithState(
        _alert_fn, ALERT_OUT, ALERT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


RL_STATE = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("last", T.DoubleType())])
RL_OUT = T.StructType([T.StructField("rl_key", T.StringType()), T.StructField("event_id", T.LongType()),
                       T.StructField("allowed", T.BooleanType())])


def _rate_limit_fn(limit: float, period_s: float, idle_s: float):
    cap = int(1.5 * limit)
    rate = limit / period_s

    def fn(key, pdfs, state):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["rl_key", "event_id", "allowed"])
            return
        tokens, last = (state.get if state.exists else (float(cap), None))
        out = []
        for pdf in pdfs:
            pdf = pdf.sort_values(["__t", "event_id"])
            for t, eid in zip(pdf["__t"], pdf["event_id"]):
                if last is not None and t - last > idle_s:
                    tokens = float(cap)
                elif last is not None:
                    tokens = min(cap, tokens + (t - last) * rate)
                last = t
                ok = tokens >= 1
                if ok:
                    tokens -= 1
                out.append((key[0], int(eid), bool(ok)))
        state.update((float(tokens), float(last) if last is not None else None))
        state.setTimeoutDuration(int(idle_s * 1000))
        yield pd.DataFrame(out, columns=["rl_key", "event_id", "allowed"])
    return fn


def stream_rate_limit(log: DataFrame, key_col: str, limit: float = 100, period_s: float = 60.0,
                      idle_s: float = 3600.0) -> DataFrame:
    """H44 token bucket with per-key state; idle keys expire after ``idle_s``."""
    x = log.select(F.col(key_col).cast("string").alias("rl_key"), "event_id",
                   (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("__t"))
    return x.groupBy("rl_key").applyInPandasWithState(
        _rate_limit_fn(limit, period_s, idle_s), RL_OUT, RL_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


# I7
def stream_dedupe(log: DataFrame, cols: list[str], delay: str = "300 seconds") -> DataFrame:
    """Identical requests within the watermark delay are dropped (state bounded by the watermark)."""
    x = event_time(log).withColumn("request_key", X.request_key(cols)).withWatermark("ts", delay)
    return x.dropDuplicatesWithinWatermark(["request_key"])


# I8
def stream_join_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str = "prediction_id",
                         max_delay: str = "30 days", watermark: str = "1 day", how: str = "inner") -> DataFrame:
    """Outcome arrives after its prediction, within ``max_delay``: stream-stream join with a time bound."""
    p = event_time(predictions, "pred_ts").withWatermark("pred_ts", watermark).alias("p")
    o = event_time(outcomes, "outcome_ts").withWatermark("outcome_ts", watermark).alias("o")
    cond = F.expr(f"p.{key} = o.{key} AND o.outcome_ts >= p.pred_ts AND o.outcome_ts <= p.pred_ts + INTERVAL {max_delay}")
    return p.join(o, cond, how).select("p.*", F.col("o.actual_outcome"), F.col("o.outcome_ts"))


# I9
def stream_drift_check(stream: DataFrame, reference: DataFrame, cols: list[str], out_path: str, checkpoint: str):
    """Per micro-batch: H12 drift scores of the batch against the static reference rows."""
    from sparkclin.operators.drift import feature_drift_scores, to_long

    def run(batch: DataFrame, batch_id: int):
        cur = batch.select(*cols).withColumn("sample", F.lit("current"))
        ref = reference.select(*cols).withColumn("sample", F.lit("reference"))
        scores = feature_drift_scores(to_long(ref.unionByName(cur), cols), ks_score="statistic")
        replace_batch(scores, batch_id, out_path)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


# I10
def feature_message(rules: dict[str, tuple[float | None, float | None]] | None):
    """What is wrong with a feature row (null: nothing): a null value, a feature without a rule, or a value out of its range."""
    if not rules:
        return F.when(F.col("value").isNull(), "missing value")
    out = F.when(~F.col("feature").isin(*rules), F.concat(F.lit("unknown feature "), "feature")).when(F.col("value").isNull(), "missing value")
    for name, (lo, hi) in rules.items():
        here = F.col("feature") == name
        if lo is not None:
            out = out.when(here & (F.col("value") < lo), F.lit(f"{name} below {lo}"))
        if hi is not None:
            out = out.when(here & (F.col("value") > hi), F.lit(f"{name} above {hi}"))
    return out


def stream_feature_upsert(stream: DataFrame, changes_path: str, checkpoint: str,
                          rules: dict[str, tuple[float | None, float | None]] | None = None, ttl_s: float | None = None):
    """Feature values per batch (newest per key within the batch; a replayed batch replaces itself), with ``message``
    where validation finds fault (kept all the same, as the reference does) and ``expires_at`` = ts + ``ttl_s``.

    The change log is a log-structured upsert: ``latest_feature_table`` reads it, ``compact_features`` folds it.
    """
    def run(batch: DataFrame, batch_id: int):
        latest = latest_features(batch, tiebreak="event_id" if "event_id" in batch.columns else None)
        life = F.lit(None).cast("interval day to second") if ttl_s is None else F.make_dt_interval(secs=F.lit(float(ttl_s)))
        latest = latest.withColumn("message", feature_message(rules)).withColumn("expires_at", F.col("ts") + life)
        replace_batch(latest, batch_id, changes_path)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _newest(rows: DataFrame) -> DataFrame:
    kept = F.max_by(F.struct("value", "ts", "message", "expires_at", "batch_id"), F.struct("ts", "batch_id")).alias("r")
    return rows.groupBy("entity_id", "feature").agg(kept).select("entity_id", "feature", "r.*")


def _folded(spark: SparkSession, changes_path: str, base_path: str | None) -> tuple[DataFrame, int | None]:
    """(newest committed base joined with the later batches, the last batch in that base)."""
    changes = spark.read.parquet(changes_path)
    commit = None
    if base_path is not None:
        try:
            commit = spark.read.parquet(f"{base_path}/commits").orderBy(F.desc("upto"), F.desc("committed_at")).first()
        except AnalysisException:  # nothing compacted yet
            commit = None
    if commit is None:
        return _newest(changes), None
    base = spark.read.parquet(f"{base_path}/{commit.version}")
    return _newest(base.unionByName(changes.where(F.col("batch_id") > commit.upto))), commit.upto


def feature_table(spark: SparkSession, changes_path: str, as_of=None, base_path: str | None = None) -> DataFrame:
    """Newest value of every (entity, feature); with ``as_of`` only those not yet expired then."""
    latest, _ = _folded(spark, changes_path, base_path)
    if as_of is not None:
        latest = latest.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of)))
    return latest


def compact_features(spark: SparkSession, changes_path: str, base_path: str, as_of=None) -> int:
    """Fold the change log into a new base version and commit it; returns the last batch in it.

    The base is written whole before its one-row commit record, so readers see the old base or the new one; batches up to
    the record's are then no longer read (and may be removed by whoever owns the folder). With ``as_of``, expired values go.
    """
    upto = spark.read.parquet(changes_path).agg(F.max("batch_id")).first()[0]
    latest, _ = _folded(spark, changes_path, base_path)
    latest = latest.where(F.col("batch_id") <= upto)
    if as_of is not None:
        latest = latest.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of)))
    version = f"base-{uuid.uuid4().hex}"
    latest.write.parquet(f"{base_path}/{version}")
    record = spark.range(1).select(F.lit(version).alias("version"), F.lit(upto).cast("long").alias("upto"), F.current_timestamp().alias("committed_at"))
    record.coalesce(1).write.mode("append").parquet(f"{base_path}/commits")
    return upto


def latest_feature_table(spark: SparkSession, changes_path: str) -> DataFrame:
    ch = spark.read.parquet(changes_path)
    return ch.groupBy("entity_id", "feature").agg(F.max_by("value", F.struct("ts", "batch_id")).alias("value"),
                                                  F.max("ts").alias("ts"))
