"""Group fairness metrics, disparities, violations and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import safe_div


def group_fairness(df: DataFrame, group: str, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per group TPR, FPR, FNR, TNR, precision, recall, F1, accuracy, selection rate, count."""
    t, p = F.col(y_true), F.col(y_pred)
    g = df.groupBy(group).agg(F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
                              F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"),
                              F.count(F.lit(1)).alias("count"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return g.select(group, "count", "tp", "fp", "fn", "tn", rec.alias("tpr"), safe_div(fp, fp + tn).alias("fpr"),
                    safe_div(fn, fn + tp).alias("fnr"), safe_div(tn, tn + fp).alias("tnr"), prec.alias("precision"),
                    rec.alias("recall"), safe_div(2 * prec * rec, prec + rec).alias("f1"),
                    safe_div(tp + tn, F.col("count")).alias("accuracy"),
                    safe_div(tp + fp, F.col("count")).alias("selection_rate"))


def group_disparity(metrics: DataFrame, group: str) -> DataFrame:
    """Each group against the largest group (count, then name): demographic parity
    ((TPR+FPR) ratio, the reference formula), equal opportunity (TPR ratio), disparate
    impact (= parity), plus the selection-rate ratio; 1.0 when the denominator is 0.
    Fewer than two groups → no rows."""
    maj = metrics.agg(F.max_by(F.struct(F.col(group).alias("g"), (F.col("tpr") + F.col("fpr")).alias("par"),
                                        F.col("tpr").alias("tpr"), F.col("selection_rate").alias("sr")),
                               F.struct("count", F.col(group))).alias("__m"),
                      F.count(F.lit(1)).alias("__k"))
    j = metrics.crossJoin(F.broadcast(maj)).where((F.col("__k") >= 2) & (F.col(group) != F.col("__m.g")))
    def ratio(a, b):
        return F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    par = ratio(F.col("tpr") + F.col("fpr"), F.col("__m.par"))
    return j.select(group, F.col("__m.g").alias("reference_group"), par.alias("demographic_parity"),
                    ratio(F.col("tpr"), F.col("__m.tpr")).alias("equal_opportunity"), par.alias("disparate_impact"),
                    ratio(F.col("selection_rate"), F.col("__m.sr")).alias("selection_rate_ratio"))


def fairness_violations(metrics: DataFrame, disparities: DataFrame, group: str, threshold: float = 0.8,
                        small_share: float = 0.05) -> DataFrame:
    """Disparity ratios under the threshold, and groups under 5 % of all rows."""
    long = disparities.select(group, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("demographic_parity", "equal_opportunity", "disparate_impact")])).alias("d")).select(group, "d.*")
    low = long.where(F.col("value") < threshold).select(group, "metric", "value")
    tot = metrics.agg(F.sum("count").alias("__n"))
    small = (metrics.crossJoin(F.broadcast(tot)).where(F.col("count") < small_share * F.col("__n"))
             .select(group, F.lit("small_group").alias("metric"), (F.col("count") / F.col("__n")).alias("value")))
    return low.unionByName(small)


def fairness_severity(violations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Low (none), critical (> 3), high (any ratio below 0.8·threshold), medium (≥ 2), else low."""
    s = violations.agg(F.count(F.lit(1)).alias("n_violations"),
                       F.min(F.when(F.col("metric") != "small_group", F.col("value"))).alias("min_ratio"))
    sev = (F.when(F.col("n_violations") == 0, "low").when(F.col("n_violations") > 3, "critical")
           .when(F.coalesce(F.col("min_ratio") < threshold * threshold, F.lit(False)), "high")
           .when(F.col("n_violations") >= 2, "medium").otherwise("low"))
    return s.select("*", sev.alias("severity"))


def fairness_recommendations(metrics: DataFrame, group: str) -> DataFrame:
    recs = F.filter(F.array(
        F.when(F.col("recall") < 0.7, F.concat(F.lit("Improve recall for group "), F.col(group).cast("string"))),
        F.when(F.col("precision") < 0.7, F.concat(F.lit("Improve precision for group "), F.col(group).cast("string")))),
        lambda x: x.isNotNull())
    return metrics.select(group, recs.alias("recommendations"))


def fairness_threshold_table(metrics: DataFrame, group: str, threshold: float = 0.8) -> DataFrame:
    """Per group whether recall, precision and F1 reach the threshold, and all three."""
    r, p, f = (F.col(c) >= threshold for c in ("recall", "precision", "f1"))
    return metrics.select(group, r.alias("recall_ok"), p.alias("precision_ok"), f.alias("f1_ok"),
                          (r & p & f).alias("all_ok"))


def bias_history_summary(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Last ``days``: reports, violations, attributes seen, latest severity."""
    recent = runs.where(F.col("run_date") > F.date_sub(as_of, days))
    latest = F.max_by("n_violations", F.struct("run_date", "run_id"))
    return recent.agg(F.count(F.lit(1)).alias("n_reports"), F.sum("n_violations").cast("bigint").alias("total_violations"),
                      F.countDistinct("feature").alias("n_attributes"),
                      F.array_sort(F.collect_set("feature")).alias("attributes"),
                      latest.alias("latest_violations")).select(
        "*", F.when(F.col("latest_violations") == 0, "low").when(F.col("latest_violations") > 3, "critical")
        .when(F.col("latest_violations") >= 2, "medium").otherwise("low").alias("latest_severity"))
