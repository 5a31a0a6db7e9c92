"""Ground truth, accuracy trends, retraining and promotion decisions, canary comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.functions.exprs import quantiles_long
from sparkclin.operators.drift import ks_two_sample


def join_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str = "prediction_id",
                  predicted: str = "predicted", actual: str = "actual_outcome") -> DataFrame:
    """Prediction ⋈ outcome on the id; correct = predicted = actual (shuffle join on the key)."""
    return predictions.join(outcomes, key, "inner").withColumn(
        "correct", (F.col(predicted) == F.col(actual)).cast("int"))


def retraining_set(joined: DataFrame, patient_cols: list[str], key: str = "prediction_id",
                   actual: str = "actual_outcome") -> DataFrame:
    """Flattened patient fields + label + id + correctness."""
    return joined.select(*patient_cols, F.col(actual).alias("target"), key, "correct")


def accuracy_trend(joined: DataFrame, ts: str = "outcome_ts", last_n: int = 100) -> DataFrame:
    """Per month mean correctness and count, with overall and last-N accuracy and the trend label."""
    month = F.date_trunc("month", F.col(ts))
    if dict(joined.dtypes).get(ts) == "timestamp_ntz":
        month = month.cast("timestamp_ntz")
    m = joined.groupBy(month.alias("month")).agg(
        F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    ends = m.agg(F.min_by("accuracy", "month").alias("__first"), F.max_by("accuracy", "month").alias("__last"))
    recent = joined.orderBy(F.col(ts).desc(), F.col("prediction_id").desc()).limit(last_n).agg(
        F.avg("correct").alias("last_n_accuracy"))
    overall = joined.agg(F.avg("correct").alias("overall_accuracy"))
    summ = ends.crossJoin(recent).crossJoin(overall).select(
        "overall_accuracy", "last_n_accuracy",
        F.when(F.col("__last") > F.col("__first"), "improving").otherwise("declining").alias("trend"))
    return m.crossJoin(F.broadcast(summ))


def retrain_decision(drift_severity: Column, recent_accuracy: Column, recent_count: Column, days_since_training: Column,
                     min_accuracy: float = 0.75, min_samples: int = 50, max_age_days: int = 30) -> Column:
    """struct(retrain, reasons) from drift, recent accuracy and model age."""
    reasons = F.filter(F.array(
        F.when(drift_severity == "HIGH", F.lit("high drift")),
        F.when((recent_count >= min_samples) & (recent_accuracy < min_accuracy), F.lit("low recent accuracy")),
        F.when(days_since_training > max_age_days, F.lit("model too old"))), lambda x: x.isNotNull())
    return F.struct((F.size(reasons) > 0).alias("retrain"), reasons.alias("reasons"))


def promotion_gate(candidate: DataFrame, current: DataFrame, recall_min: float = 0.8, accuracy_min: float = 0.6,
                   min_improvement: float = 0.01) -> DataFrame:
    """Candidate metrics vs thresholds and vs the current model; error list and verdict."""
    c = candidate.select(*[F.col(x).alias(f"cand_{x}") for x in candidate.columns])
    b = current.select(*[F.col(x).alias(f"cur_{x}") for x in current.columns])
    j = c.crossJoin(b)
    errs = F.filter(F.array(
        F.when(F.col("cand_recall") < recall_min, F.lit("recall below threshold")),
        F.when(F.col("cand_accuracy") < accuracy_min, F.lit("accuracy below threshold")),
        F.when(~F.coalesce(F.col("cand_golden_pass"), F.lit(True)), F.lit("golden tests failed")),
        F.when(F.coalesce(F.col("cand_fairness_violations"), F.lit(0)) > 0, F.lit("fairness violations")),
        F.when(F.col("cand_recall") - F.col("cur_recall") < min_improvement, F.lit("insufficient improvement"))),
        lambda x: x.isNotNull())
    return j.select("*", errs.alias("errors"), (F.size(errs) == 0).alias("promote"))


def canary_compare(df: DataFrame, track: str = "track", prob: str = "probability", risk: str = "risk_level",
                   canary: str = "canary", baseline: str = "production") -> DataFrame:
    """KS of probabilities, risk-level share differences, confidence and spread; decision.

    PROMOTE when KS < 0.05 and every share difference < 0.05; MONITOR when
    KS < 0.1; else ROLLBACK.
    """
    long = df.select(F.when(F.col(track) == canary, "current").otherwise("reference").alias("sample"),
                     F.lit("probability").alias("feature"), F.col(prob).cast("double").alias("value"))
    ks = ks_two_sample(long.where(F.col("value").isNotNull()), with_pvalue=False).select("ks_statistic")
    shares = (df.groupBy(track, risk).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(track))))
    sd = (shares.groupBy(risk).agg(F.sum(F.when(F.col(track) == canary, F.col("share")).otherwise(0.0)).alias("__c"),
                                   F.sum(F.when(F.col(track) == baseline, F.col("share")).otherwise(0.0)).alias("__b"))
          .agg(F.max(F.abs(F.col("__c") - F.col("__b"))).alias("max_share_diff")))
    conf = F.when(F.col(prob) > 0.8, 1.0).when(F.col(prob) > 0.6, 0.5).otherwise(0.0)
    st = df.groupBy().agg(*[f for t in (canary, baseline) for f in (
        F.avg(F.when(F.col(track) == t, F.col(prob))).alias(f"{t}_mean"),
        F.stddev_samp(F.when(F.col(track) == t, F.col(prob))).alias(f"{t}_std"),
        F.avg(F.when(F.col(track) == t, conf)).alias(f"{t}_confidence"))])
    medians = quantiles_long(df.where(F.col(track).isin(canary, baseline)), [0.5], [track], prob)
    st = st.crossJoin(medians.agg(*[F.first(F.when(F.col(track) == t, F.get("__q", F.lit(0))), ignorenulls=True).alias(f"{t}_median")
                                    for t in (canary, baseline)]))
    parts = [f"{t}_{k}" for t in (canary, baseline) for k in ("mean", "std", "median", "confidence")]
    r = ks.crossJoin(sd).crossJoin(st.select(*parts))
    return r.select("*", F.when((F.col("ks_statistic") < 0.05) & (F.col("max_share_diff") < 0.05), "PROMOTE")
                    .when(F.col("ks_statistic") < 0.1, "MONITOR").otherwise("ROLLBACK").alias("decision"))
