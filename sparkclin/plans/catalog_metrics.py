"""Registered queries for group F (evaluation and calibration metrics) on ``scored_v``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.operators import metrics as M
from sparkclin.plans.registry import register
from sparkclin.sources.views import reqlog, scored

_CELLS = ("count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 0 AND y_pred = 1) AS fp, "
          "count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 1 AND y_pred = 1) AS tp")


def _sdiv(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


@register("confusion_matrix", sql=f"SELECT model, {_CELLS} FROM scored_v GROUP BY model")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(scored(spark, sf), group_cols=["model"])


@register("confusion_matrix_rollup", sql=f"SELECT model, {_CELLS} FROM scored_v GROUP BY ROLLUP (model)")
def q_confusion_matrix_rollup(spark, sf):
    return M.confusion_matrix(scored(spark, sf), group_cols=["model"], rollup=True)


_TM = (f"SELECT model, tn, fp, fn, tp, {_sdiv('tp + tn', 'tn + fp + fn + tp')} AS accuracy, "
       f"{_sdiv('tp', 'tp + fp')} AS precision, {_sdiv('tp', 'tp + fn')} AS recall, "
       f"{_sdiv('tn', 'tn + fp')} AS specificity, "
       f"{_sdiv('2 * ' + _sdiv('tp', 'tp + fp') + ' * ' + _sdiv('tp', 'tp + fn'), _sdiv('tp', 'tp + fp') + ' + ' + _sdiv('tp', 'tp + fn'))} AS f1 "
       f"FROM (SELECT model, {_CELLS} FROM scored_v GROUP BY model) c")


@register("threshold_metrics", dbl=["accuracy", "precision", "recall", "specificity", "f1"], sql=_TM)
def q_threshold_metrics(spark, sf):
    return M.threshold_metrics(scored(spark, sf), group_cols=["model"])


@register("mcc_kappa", dbl=["mcc", "kappa"], sql=f"""
SELECT model,
  {_sdiv('tp * tn - fp * fn', 'sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc,
  {_sdiv('po - pe', '1 - pe')} AS kappa
FROM (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS pe
      FROM (SELECT model, CAST(tn AS DOUBLE) tn, CAST(fp AS DOUBLE) fp, CAST(fn AS DOUBLE) fn, CAST(tp AS DOUBLE) tp,
                   CAST(tn + fp + fn + tp AS DOUBLE) AS n
            FROM (SELECT model, {_CELLS} FROM scored_v GROUP BY model) a) b) c""")
def q_mcc_kappa(spark, sf):
    return M.mcc_kappa(scored(spark, sf), group_cols=["model"])


_SC = ("SELECT model, CAST(y_prob AS DOUBLE) AS score, CAST(sum(y_true) AS DOUBLE) AS pos, "
       "CAST(sum(1 - y_true) AS DOUBLE) AS neg FROM scored_v GROUP BY model, score")


@register("roc_auc", dbl=["roc_auc"], sql=f"""
WITH sc AS ({_SC}),
c AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc)
SELECT model, sum(pos * (cum_neg - neg + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM c GROUP BY model""")
def q_roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf), group_cols=["model"])


@register("pr_auc", dbl=["pr_auc"], sql=f"""
WITH sc AS ({_SC}),
c AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM sc
      WINDOW w AS (PARTITION BY model ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, sum(pos * (cum_pos / (cum_pos + cum_neg)
   + CASE WHEN cum_pos + cum_neg - pos - neg = 0 THEN 1.0 ELSE (cum_pos - pos) / (cum_pos + cum_neg - pos - neg) END) / 2)
   / sum(pos) AS pr_auc
FROM c GROUP BY model""")
def q_pr_auc(spark, sf):
    return M.pr_auc(scored(spark, sf), group_cols=["model"])


@register("roc_curve", dbl=["threshold", "fpr", "tpr", "precision"], sql=f"""
WITH sc AS ({_SC}),
c AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
             sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM sc
      WINDOW w AS (PARTITION BY model ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, score AS threshold, {_sdiv('cum_neg', 'N')} AS fpr, {_sdiv('cum_pos', 'P')} AS tpr,
       {_sdiv('cum_pos', 'cum_pos + cum_neg')} AS precision FROM c""")
def q_roc_curve(spark, sf):
    return M.roc_curve(scored(spark, sf), group_cols=["model"])


@register("log_loss", dbl=["log_loss"], sql="""
SELECT model, avg(-(CASE WHEN y_true = 1 THEN ln(p) ELSE ln(1 - p) END)) AS log_loss
FROM (SELECT model, y_true, greatest(least(CAST(y_prob AS DOUBLE), 1 - CAST(1e-15 AS DOUBLE)), CAST(1e-15 AS DOUBLE)) AS p
      FROM scored_v) t GROUP BY model""")
def q_log_loss(spark, sf):
    return M.log_loss(scored(spark, sf), group_cols=["model"])


@register("brier_score", dbl=["brier_score"], sql="""
SELECT model, avg(pow(CAST(y_prob AS DOUBLE) - y_true, 2)) AS brier_score FROM scored_v GROUP BY model""")
def q_brier_score(spark, sf):
    return M.brier_score(scored(spark, sf), group_cols=["model"])


def _bin_sql(op):
    return "(" + " + ".join(f"CASE WHEN CAST(y_prob AS DOUBLE) {op} CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END"
                            for e in M.BIN_EDGES_10) + ")"


_REL = f"""
SELECT b.bin, CAST(coalesce(a.count, 0) AS BIGINT) AS count, coalesce(a.accuracy, 0.0) AS accuracy,
       coalesce(a.confidence, 0.0) AS confidence
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b LEFT JOIN
     (SELECT {_bin_sql('>=')} AS bin, count(*) AS count, avg(CAST(y_true AS DOUBLE)) AS accuracy,
             avg(CAST(y_prob AS DOUBLE)) AS confidence FROM scored_v GROUP BY 1) a ON a.bin = b.bin"""


@register("reliability_bins", dbl=["accuracy", "confidence"], sql=_REL)
def q_reliability_bins(spark, sf):
    return M.reliability_bins(scored(spark, sf))


@register("ece_mce", dbl=["ece", "mce"], sql=f"""
SELECT coalesce(sum(abs(accuracy - confidence) * count) / nullif(CAST(sum(count) AS DOUBLE), 0), 0.0) AS ece,
       max(abs(accuracy - confidence)) AS mce FROM ({_REL}) r""")
def q_ece_mce(spark, sf):
    return M.ece_mce(scored(spark, sf))


@register("calibration_curve", dbl=["prob_pred", "prob_true"], sql=f"""
SELECT {_bin_sql('>')} AS bin, avg(CAST(y_prob AS DOUBLE)) AS prob_pred, avg(CAST(y_true AS DOUBLE)) AS prob_true,
       count(*) AS count FROM scored_v GROUP BY 1""")
def q_calibration_curve(spark, sf):
    return M.calibration_curve(scored(spark, sf))


@register("chi_square_2x2", dbl=["chi2"], sql=f"""
SELECT model, ({' + '.join(f"pow(greatest(abs({o} - {e}) - 0.5, 0.0), 2) / ({e})" for o, e in [
    ('tn', '(tn + fp) * (tn + fn) / n'), ('fp', '(tn + fp) * (fp + tp) / n'),
    ('fn', '(fn + tp) * (tn + fn) / n'), ('tp', '(fn + tp) * (fp + tp) / n')])}) AS chi2
FROM (SELECT model, CAST(tn AS DOUBLE) tn, CAST(fp AS DOUBLE) fp, CAST(fn AS DOUBLE) fn, CAST(tp AS DOUBLE) tp,
             CAST(tn + fp + fn + tp AS DOUBLE) n FROM (SELECT model, {_CELLS} FROM scored_v GROUP BY model) a) b""")
def q_chi_square_2x2(spark, sf):
    return M.chi_square_2x2(scored(spark, sf), group_cols=["model"], with_pvalue=False)


@register("bootstrap_ci")
def q_bootstrap_ci(spark, sf):
    return M.bootstrap_ci(scored(spark, sf), n_boot=200)


@register("compare_models", dbl=["accuracy", "precision", "recall", "specificity", "f1", "roc_auc"], sql=f"""
WITH m AS ({_TM}),
sc AS ({_SC}),
c AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc),
a AS (SELECT model, sum(pos * (cum_neg - neg + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM c GROUP BY model),
ma AS (SELECT m.*, a.roc_auc FROM m LEFT JOIN a USING (model)),
best AS (SELECT arg_max(model, (recall, model)) AS best_model FROM ma)
SELECT ma.*, best.best_model, ma.model = best.best_model AS is_best FROM ma, best""")
def q_compare_models(spark, sf):
    return M.compare_models(scored(spark, sf), "model")


@register("rate_model", dbl=["accuracy", "recall", "specificity", "roc_auc", "brier_score", "balanced_performance"],
          sql=f"""
WITH m AS ({_TM}),
sc AS ({_SC}),
c AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc),
a AS (SELECT model, sum(pos * (cum_neg - neg + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM c GROUP BY model),
b AS (SELECT model, avg(pow(CAST(y_prob AS DOUBLE) - y_true, 2)) AS brier_score FROM scored_v GROUP BY model),
x AS (SELECT m.model, m.accuracy, m.recall, m.specificity, a.roc_auc, b.brier_score FROM m JOIN a USING (model) JOIN b USING (model))
SELECT *, CASE WHEN accuracy > 0.8 THEN 'Good' WHEN accuracy > 0.7 THEN 'Average' ELSE 'Poor' END AS overall_performance,
       (recall + specificity) / 2 AS balanced_performance,
       list_filter([CASE WHEN recall < 0.7 THEN 'Consider improving model recall (sensitivity)' END,
                    CASE WHEN specificity < 0.7 THEN 'Consider improving model specificity' END,
                    CASE WHEN roc_auc < 0.7 THEN 'Model discrimination is poor, consider feature engineering' END,
                    CASE WHEN brier_score > 0.2 THEN 'Model calibration needs improvement' END], lambda r: r IS NOT NULL) AS recommendations
FROM x""")
def q_rate_model(spark, sf):
    s = scored(spark, sf)
    m = (M.threshold_metrics(s, group_cols=["model"]).select("model", "accuracy", "recall", "specificity")
         .join(M.roc_auc(s, group_cols=["model"]), "model").join(M.brier_score(s, group_cols=["model"]), "model"))
    return M.rate_model(m)


@register("latency_metrics", dbl=["mean_latency", "p50", "p95", "p99", "throughput", "error_rate"], sql="""
WITH r AS (SELECT endpoint, CAST(latency_ms AS DOUBLE) AS l, CAST(status >= 400 AS INTEGER) AS e,
                  row_number() OVER (PARTITION BY endpoint ORDER BY latency_ms) AS rn,
                  count(*) OVER (PARTITION BY endpoint) AS n FROM reqlog_v)
SELECT endpoint, count(*) AS request_count, CAST(sum(e) AS BIGINT) AS error_count, avg(l) AS mean_latency,
       max(CASE WHEN rn = floor(n * 0.5) + 1 THEN l END) AS p50,
       max(CASE WHEN rn = floor(n * 0.95) + 1 THEN l END) AS p95,
       max(CASE WHEN rn = floor(n * 0.99) + 1 THEN l END) AS p99,
       count(*) / (sum(l) / 1000.0) AS throughput, CAST(sum(e) AS DOUBLE) / greatest(count(*), 1) AS error_rate
FROM r GROUP BY endpoint""")
def q_latency_metrics(spark, sf):
    r = reqlog(spark, sf).withColumn("is_error", F.col("status") >= 400)
    return M.latency_metrics(r, "latency_ms", "is_error", ["endpoint"])
