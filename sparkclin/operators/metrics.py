"""F: evaluation and calibration metrics as grouped aggregates.

Every metric takes ``(y_true, y_pred, y_prob)`` column names and optional
``group_cols``; the work is a partial aggregate per partition plus a tiny
final merge. Curve metrics first reduce rows to distinct scores (so a hot
score value is one row), then use the bucketed prefix sum in
``cumulative_sums`` instead of a global single-task window.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkclin.functions.exprs import cumulative_sums, safe_div

EPS = 1e-15
# numpy.linspace(0, 1, 11)[1:-1]: i * 0.1 in double arithmetic (0.30000000000000004, ...).
BIN_EDGES_10 = [i * 0.1 for i in range(1, 10)]


def _g(group_cols):
    return list(group_cols or [])


def confusion_cells(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    t, p = F.col(y_true), F.col(y_pred)
    return [F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp")]


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     group_cols: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """tn, fp, fn, tp per group; ``rollup`` adds the all-groups row (NULL keys)."""
    g = _g(group_cols)
    gb = df.rollup(*g) if (rollup and g) else df.groupBy(*g)
    return gb.agg(*confusion_cells(y_true, y_pred))


def _ratio_metrics() -> list[Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    return [safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"), precision.alias("precision"),
            recall.alias("recall"), safe_div(tn, tn + fp).alias("specificity"),
            safe_div(2 * precision * recall, precision + recall).alias("f1")]


def threshold_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                      group_cols: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """F2: accuracy, precision, recall, specificity, F1 (0 on zero division)."""
    cm = confusion_matrix(df, y_true, y_pred, group_cols, rollup)
    return cm.select(*_g(group_cols), "tn", "fp", "fn", "tp", *_ratio_metrics())


def mcc_kappa(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
              group_cols: list[str] | None = None) -> DataFrame:
    """Matthews correlation and Cohen's kappa from the confusion cells."""
    cm = confusion_matrix(df, y_true, y_pred, group_cols)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    mcc = safe_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    kappa = safe_div(po - pe, 1 - pe)
    return cm.select(*_g(group_cols), mcc.alias("mcc"), kappa.alias("kappa"))


def _score_counts(df: DataFrame, y_true: str, y_prob: str, group_cols) -> DataFrame:
    """Distinct (group, score) with positive / negative counts (the reduction before any window)."""
    g = _g(group_cols)
    return (df.groupBy(*g, F.col(y_prob).cast("double").alias("score"))
            .agg(F.sum(F.col(y_true).cast("long")).alias("pos"),
                 F.sum((1 - F.col(y_true)).cast("long")).alias("neg")))


def roc_auc(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
            group_cols: list[str] | None = None) -> DataFrame:
    """area under ROC, ties counted ½ (Mann–Whitney form)."""
    g = _g(group_cols)
    c = cumulative_sums(_score_counts(df, y_true, y_prob, g), "score", ["neg"], g)
    return c.groupBy(*g).agg(
        safe_div(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)),
                 F.sum("pos").cast("double") * F.sum("neg"), None).alias("roc_auc"))


def pr_auc(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
           group_cols: list[str] | None = None) -> DataFrame:
    """trapezoid area under precision–recall from (recall 0, precision 1), positive sign.

    Walking thresholds from the highest score down, each step adds
    pos/P × (precision here + precision before)/2; the previous precision is
    recovered from this row's cumulative counts minus its own, so no lag
    (and no ordering across buckets) is needed.
    """
    g = _g(group_cols)
    c = cumulative_sums(_score_counts(df, y_true, y_prob, g), "score", ["pos", "neg"], g, descending=True)
    n_here = F.col("cum_pos") + F.col("cum_neg")
    n_before = n_here - F.col("pos") - F.col("neg")
    p_here = F.col("cum_pos") / n_here
    p_before = F.when(n_before == 0, F.lit(1.0)).otherwise((F.col("cum_pos") - F.col("pos")) / n_before)
    return c.groupBy(*g).agg(
        safe_div(F.sum(F.col("pos") * (p_here + p_before) / 2.0), F.sum("pos"), None).alias("pr_auc"))


def roc_curve(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
              group_cols: list[str] | None = None) -> DataFrame:
    """one point per distinct threshold: fpr, tpr, precision, recall."""
    g = _g(group_cols)
    c = cumulative_sums(_score_counts(df, y_true, y_prob, g), "score", ["pos", "neg"], g, descending=True)
    tot = c.groupBy(*g).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    j = c.join(tot, g, "inner") if g else c.crossJoin(F.broadcast(tot))
    return j.select(*g, F.col("score").alias("threshold"),
                    safe_div(F.col("cum_neg"), F.col("__N")).alias("fpr"),
                    safe_div(F.col("cum_pos"), F.col("__P")).alias("tpr"),
                    safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"))


def log_loss(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
             group_cols: list[str] | None = None) -> DataFrame:
    """mean −log p of the true class, p clipped to [1e−15, 1 − 1e−15]."""
    p = F.greatest(F.least(F.col(y_prob).cast("double"), F.lit(1 - EPS)), F.lit(EPS))
    y = F.col(y_true)
    return df.groupBy(*_g(group_cols)).agg(
        F.avg(-(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def brier_score(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
                group_cols: list[str] | None = None) -> DataFrame:
    """F8: mean (p − y)²."""
    return df.groupBy(*_g(group_cols)).agg(
        F.avg(F.pow(F.col(y_prob).cast("double") - F.col(y_true), 2)).alias("brier_score"))


def digitize_bin(p: Column, edges=BIN_EDGES_10) -> Column:
    """Left-closed bin index with clipping (numpy ``digitize(p, linspace)-1`` then clip)."""
    return sum((F.when(p >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))


def searchsorted_bin(p: Column, edges=BIN_EDGES_10) -> Column:
    """Bin index = number of inner edges strictly below p (``searchsorted`` side='left')."""
    return sum((F.when(p > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))


def reliability_bins(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
                     group_cols: list[str] | None = None) -> DataFrame:
    """10 equal-width bins: count, accuracy (mean y), confidence (mean p); empty bins → 0."""
    g = _g(group_cols)
    p = F.col(y_prob).cast("double")
    agg = (df.groupBy(*g, digitize_bin(p).alias("bin"))
           .agg(F.count(F.lit(1)).alias("count"), F.avg(F.col(y_true).cast("double")).alias("accuracy"),
                F.avg(p).alias("confidence")))
    spark = df.sparkSession
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    keys = agg.select(*g).distinct().crossJoin(bins) if g else bins
    return (keys.join(agg, g + ["bin"], "left")
            .select(*g, "bin", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                    F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence")))


def ece_mce(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
            group_cols: list[str] | None = None) -> DataFrame:
    """ECE = Σ|acc − conf|·n / N and MCE = max |acc − conf| over the 10 bins."""
    g = _g(group_cols)
    b = reliability_bins(df, y_true, y_prob, g)
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return b.groupBy(*g).agg(safe_div(F.sum(gap * F.col("count")), F.sum("count")).alias("ece"),
                             F.max(gap).alias("mce"))


def calibration_curve(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob",
                      group_cols: list[str] | None = None) -> DataFrame:
    """non-empty uniform bins: mean predicted probability and fraction of positives."""
    g = _g(group_cols)
    p = F.col(y_prob).cast("double")
    return (df.groupBy(*g, searchsorted_bin(p).alias("bin"))
            .agg(F.avg(p).alias("prob_pred"), F.avg(F.col(y_true).cast("double")).alias("prob_true"),
                 F.count(F.lit(1)).alias("count")))


@F.pandas_udf(DoubleType())
def _chi2_df1_pvalue(x: pd.Series) -> pd.Series:
    # Survival function of chi-square with one degree of freedom: erfc(sqrt(x/2)).
    return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)) if v is not None and v == v else float("nan"))


def chi_square_2x2(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                   group_cols: list[str] | None = None, with_pvalue: bool = True) -> DataFrame:
    """chi-square on the confusion matrix with Yates' continuity correction."""
    g = _g(group_cols)
    cm = confusion_matrix(df, y_true, y_pred, g)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    r0, r1, c0, c1 = tn + fp, fn + tp, tn + fn, fp + tp
    cells = [(tn, r0 * c0 / n), (fp, r0 * c1 / n), (fn, r1 * c0 / n), (tp, r1 * c1 / n)]
    stat = sum((F.pow(F.greatest(F.abs(o - e) - 0.5, F.lit(0.0)), 2) / e for o, e in cells), F.lit(0.0))
    out = cm.select(*g, stat.alias("chi2"))
    if with_pvalue:
        out = out.withColumn("p_value", _chi2_df1_pvalue(F.col("chi2")))
        out = out.withColumn("significant", F.col("p_value") < 0.05)
    return out


def bootstrap_ci(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                 n_boot: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """bootstrap percentile interval of recall and precision.

    The data reduce to the four confusion cells first; each replicate then
    draws cell counts as a multinomial of size N (numpy, per replicate in a
    task over ``range(n_boot)``), which equals resampling rows with
    replacement. Work is O(n_boot), independent of the row count.
    """
    cm = confusion_matrix(df, y_true, y_pred)
    spark = df.sparkSession
    reps = spark.range(n_boot).repartition(max(1, n_boot // 100))
    j = reps.crossJoin(F.broadcast(cm))

    def draw(it):
        import numpy as np
        for pdf in it:
            out = []
            for rid, tn, fp, fn, tp in zip(pdf["id"], pdf["tn"], pdf["fp"], pdf["fn"], pdf["tp"]):
                n = tn + fp + fn + tp
                rng = np.random.default_rng([seed, int(rid)])
                c = rng.multinomial(n, np.array([tn, fp, fn, tp], dtype=float) / max(n, 1))
                rec = c[3] / (c[3] + c[2]) if (c[3] + c[2]) else 0.0
                pre = c[3] / (c[3] + c[1]) if (c[3] + c[1]) else 0.0
                out.append((int(rid), float(rec), float(pre)))
            yield pd.DataFrame(out, columns=["rep", "recall", "precision"])

    sc = j.mapInPandas(draw, "rep long, recall double, precision double")
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    return sc.agg(F.expr(f"percentile(recall, {lo})").alias("recall_lo"),
                  F.expr(f"percentile(recall, {hi})").alias("recall_hi"),
                  F.expr(f"percentile(precision, {lo})").alias("precision_lo"),
                  F.expr(f"percentile(precision, {hi})").alias("precision_hi"))


def compare_models(df: DataFrame, model_col: str = "model", y_true: str = "y_true", y_pred: str = "y_pred",
                   y_prob: str | None = "y_prob") -> DataFrame:
    """metrics per model side by side with the best model by recall (name breaks ties)."""
    m = threshold_metrics(df, y_true, y_pred, [model_col])
    if y_prob:
        m = m.join(roc_auc(df, y_true, y_prob, [model_col]), model_col, "left")
    best = m.agg(F.max_by(F.col(model_col), F.struct(F.col("recall"), F.col(model_col))).alias("best_model"))
    return m.crossJoin(F.broadcast(best)).withColumn("is_best", F.col(model_col) == F.col("best_model"))


def rate_model(metrics: DataFrame) -> DataFrame:
    """overall rating, balanced performance and recommendation list.

    Expects columns accuracy, recall, specificity, roc_auc, brier_score.
    """
    recs = F.filter(F.array(
        F.when(F.col("recall") < 0.7, F.lit("Consider improving model recall (sensitivity)")),
        F.when(F.col("specificity") < 0.7, F.lit("Consider improving model specificity")),
        F.when(F.col("roc_auc") < 0.7, F.lit("Model discrimination is poor, consider feature engineering")),
        F.when(F.col("brier_score") > 0.2, F.lit("Model calibration needs improvement"))), lambda x: x.isNotNull())
    return metrics.select(
        "*",
        F.when(F.col("accuracy") > 0.8, "Good").when(F.col("accuracy") > 0.7, "Average").otherwise("Poor")
        .alias("overall_performance"),
        ((F.col("recall") + F.col("specificity")) / 2).alias("balanced_performance"),
        recs.alias("recommendations"))


def latency_metrics(df: DataFrame, latency_col: str = "latency_ms", error_col: str | None = "is_error",
                    group_cols: list[str] | None = None) -> DataFrame:
    """F16: mean, p50/p95/p99 = sorted[int(n·q)], throughput, error rate.

    The index percentile is a rank selection (not interpolation): the value
    at 1-based rank floor(n·q)+1 is the smallest latency whose cumulative
    count reaches that rank. Counts per distinct latency plus the bucketed
    prefix sum keep it distributed even for one huge group.
    """
    g = _g(group_cols)
    lat = F.col(latency_col).cast("double")
    err = F.col(error_col).cast("int") if error_col else F.lit(0)
    tot = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("request_count"), F.sum(err).cast("bigint").alias("error_count"),
        F.avg(lat).alias("mean_latency"), F.sum(lat).alias("__sum"))
    cnt = df.groupBy(*g, lat.alias("__l")).agg(F.count(F.lit(1)).alias("__c"))
    cum = cumulative_sums(cnt, "__l", ["__c"], g)
    j = cum.join(tot.select(*g, "request_count"), g, "inner") if g else cum.crossJoin(
        F.broadcast(tot.select("request_count")))
    def pick(qv):
        return F.min(F.when(F.col("cum___c") >= F.floor(F.col("request_count") * qv) + 1, F.col("__l")))
    qs = j.groupBy(*g).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))
    out = tot.join(qs, g, "inner") if g else tot.crossJoin(qs)
    return out.select(*g, "request_count", "error_count", "mean_latency", "p50", "p95", "p99",
                      safe_div(F.col("request_count"), F.col("__sum") / 1000.0).alias("throughput"),
                      (F.col("error_count") / F.greatest(F.col("request_count"), F.lit(1))).alias("error_rate"))
