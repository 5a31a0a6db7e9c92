"""Registered queries for drift, fairness and outcomes (H1–H29) on ``scored_v`` / ``runs_v``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.operators import drift as H
from sparkclin.operators import fairness as FA
from sparkclin.operators import metrics as M
from sparkclin.operators import outcomes as O
from sparkclin.plans.registry import register
from sparkclin.sources.io import table
from sparkclin.sources.views import patients, runs, scored

DCOLS = ["glucose", "bmi", "age", "insulin"]
_LONG_SQL = "\nUNION ALL\n".join(
    [f"SELECT sample, 'glucose' AS feature, CASE WHEN sample = 'current' THEN glucose * CAST(1.1 AS DOUBLE) ELSE glucose END AS value "
     f"FROM scored_v WHERE glucose IS NOT NULL"] +
    [f"SELECT sample, '{c}', CAST({c} AS DOUBLE) FROM scored_v WHERE {c} IS NOT NULL" for c in DCOLS[1:]])
_L = f"l AS ({_LONG_SQL})"


def _long(spark, sf):
    s = scored(spark, sf).withColumn(
        "glucose", F.when(F.col("sample") == "current", F.col("glucose") * 1.1).otherwise(F.col("glucose")))
    return H.to_long(s, DCOLS)


_PC = ["age", "pregnancies", "glucose", "blood_pressure", "insulin", "bmi"]


@register("reference_stats_numeric", dbl=["mean", "std", "min", "max", "q1", "median", "q3", "skew", "kurtosis"],
          sql="\nUNION ALL\n".join(
              f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, "
              f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, quantile_cont({c}, 0.25) AS q1, "
              f"quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, skewness({c}) AS skew, "
              f"kurtosis({c}) AS kurtosis FROM patients_v" for c in _PC))
def q_reference_stats_numeric(spark, sf):
    return H.reference_stats_numeric(patients(spark, sf), _PC)


@register("reference_stats_categorical", dbl=["entropy"], sql="""
WITH c AS (SELECT gender, count(*) AS n FROM patients_v WHERE gender IS NOT NULL GROUP BY gender),
t AS (SELECT sum(n) AS tot FROM c)
SELECT map_from_entries(list((gender, n) ORDER BY gender)) AS categories, count(*) AS n_categories,
       sum(-(CAST(n AS DOUBLE) / tot) * ln(CAST(n AS DOUBLE) / tot)) AS entropy FROM c, t""")
def q_reference_stats_categorical(spark, sf):
    return H.reference_stats_categorical(patients(spark, sf), "gender")


@register("reference_categories", dbl=["share", "entropy"], sql="""
WITH l AS (SELECT 'gender' AS feature, CAST(gender AS VARCHAR) AS category FROM patients_v
           UNION ALL SELECT 'age', CAST(age AS VARCHAR) FROM patients_v
           UNION ALL SELECT 'patient_id', CAST(patient_id AS VARCHAR) FROM patients_v),
c AS (SELECT feature, category, count(*) AS n FROM l WHERE category IS NOT NULL GROUP BY feature, category),
t AS (SELECT feature, sum(n) AS total, count(*) AS n_categories FROM c GROUP BY feature),
e AS (SELECT c.feature, sum(-(CAST(n AS DOUBLE) / total) * ln(CAST(n AS DOUBLE) / total)) AS entropy
      FROM c JOIN t ON c.feature = t.feature GROUP BY c.feature)
SELECT c.feature, c.category, c.n, CAST(c.n AS DOUBLE) / t.total AS share, t.n_categories, e.entropy
FROM c JOIN t ON c.feature = t.feature JOIN e ON c.feature = e.feature""")
def q_reference_categories(spark, sf):
    return H.reference_categories(patients(spark, sf), ["gender", "age", "patient_id"])


_CDF = f"""{_L},
c AS (SELECT feature, value, count_if(sample = 'reference') AS r, count_if(sample = 'current') AS c FROM l GROUP BY feature, value),
w AS (SELECT *, CAST(sum(r) OVER (PARTITION BY feature ORDER BY value) AS DOUBLE) / sum(r) OVER (PARTITION BY feature) AS Fr,
             CAST(sum(c) OVER (PARTITION BY feature ORDER BY value) AS DOUBLE) / sum(c) OVER (PARTITION BY feature) AS Fc,
             lead(value) OVER (PARTITION BY feature ORDER BY value) AS nv,
             min(CASE WHEN r > 0 THEN value END) OVER (PARTITION BY feature) AS lo,
             max(CASE WHEN r > 0 THEN value END) OVER (PARTITION BY feature) AS hi,
             CAST(sum(r) OVER (PARTITION BY feature) AS BIGINT) AS nr, CAST(sum(c) OVER (PARTITION BY feature) AS BIGINT) AS nc FROM c)"""

_W_SQL = f"""WITH {_CDF},
a AS (SELECT feature, coalesce(sum(abs(Fr - Fc) * (nv - value)), 0.0) AS wasserstein, any_value(lo) AS lo, any_value(hi) AS hi FROM w GROUP BY feature)
SELECT feature, wasserstein, wasserstein / (hi - lo + 1e-6) AS wasserstein_score FROM a"""


@register("wasserstein", dbl=["wasserstein", "wasserstein_score"], sql=_W_SQL)
def q_wasserstein(spark, sf):
    return H.wasserstein(_long(spark, sf))


_KS_SQL = f"""WITH {_CDF},
d AS (SELECT feature, max(abs(Fr - Fc)) AS ks_statistic, any_value(nr) AS n_ref, any_value(nc) AS n_cur FROM w GROUP BY feature),
p AS (SELECT *, ks_statistic * sqrt(CAST(n_ref * n_cur AS DOUBLE) / (n_ref + n_cur)) AS lam FROM d),
q AS (SELECT feature, ks_statistic, n_ref, n_cur,
        CASE WHEN lam <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum(pow(-1, k - 1) * exp(-2 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS p_value FROM p)
SELECT *, CASE WHEN p_value < 1 THEN 1 - p_value ELSE 0.0 END AS ks_score FROM q"""


@register("ks_two_sample", dbl=["ks_statistic", "p_value", "ks_score"], sql=_KS_SQL)
def q_ks_two_sample(spark, sf):
    return H.ks_two_sample(_long(spark, sf))


def _ge_count(edges_expr, n):
    return "(" + " + ".join(f"CASE WHEN value >= {edges_expr}[{i}] THEN 1 ELSE 0 END" for i in range(1, n + 1)) + ")"


_PSI6_SQL = f"""WITH {_L},
e AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM l WHERE sample = 'reference' GROUP BY feature),
b AS (SELECT l.feature, l.sample, {_ge_count('e.e', 9)} AS bin FROM l JOIN e USING (feature)),
h AS (SELECT feature, bin, count_if(sample = 'reference') AS r, count_if(sample = 'current') AS c FROM b GROUP BY feature, bin),
n AS (SELECT feature, count_if(sample = 'reference') AS nr, count_if(sample = 'current') AS nc FROM l GROUP BY feature)
SELECT feature, sum(CASE WHEN r > 0 AND c > 0 THEN (CAST(c AS DOUBLE) / nc - CAST(r AS DOUBLE) / nr) * ln((CAST(c AS DOUBLE) / nc) / (CAST(r AS DOUBLE) / nr)) ELSE 0.0 END) / 5 AS psi
FROM h JOIN n USING (feature) GROUP BY feature"""


@register("psi_decile", dbl=["psi"], sql=_PSI6_SQL)
def q_psi_decile(spark, sf):
    return H.psi_decile(_long(spark, sf))


_BINS10 = "SELECT feature, CAST(range AS INTEGER) AS bin FROM (SELECT DISTINCT feature FROM l) f, range(10)"
_PSI7_SQL = f"""WITH {_L},
e AS (SELECT feature, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM l WHERE sample = 'reference' GROUP BY feature),
b AS (SELECT l.feature, l.sample, {_ge_count('e.e[2:10]', 9)} AS bin FROM l JOIN e USING (feature) WHERE l.value >= e.e[1] AND l.value <= e.e[11]),
h AS (SELECT k.feature, k.bin, count_if(b.sample = 'reference') AS r, count_if(b.sample = 'current') AS c
      FROM ({_BINS10}) k LEFT JOIN b ON k.feature = b.feature AND k.bin = b.bin GROUP BY k.feature, k.bin),
n AS (SELECT feature, count_if(sample = 'reference') AS nr, count_if(sample = 'current') AS nc FROM l GROUP BY feature)
SELECT feature, sum(((c + 1e-6) / nc - (r + 1e-6) / nr) * ln(((c + 1e-6) / nc) / ((r + 1e-6) / nr))) AS psi
FROM h JOIN n USING (feature) GROUP BY feature"""


@register("psi_smoothed", dbl=["psi"], sql=_PSI7_SQL)
def q_psi_smoothed(spark, sf):
    return H.psi_smoothed(_long(spark, sf))


_EDGES50 = "[" + ", ".join(f"CAST({i} AS DOUBLE) * ((hi - lo) / 50) + lo" for i in range(1, 50)) + "]"
_BINS50 = "SELECT feature, CAST(range AS INTEGER) AS bin FROM (SELECT DISTINCT feature FROM l) f, range(50)"
_UH = f"""WITH {_L},
g AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l WHERE sample = 'reference' GROUP BY feature),
e AS (SELECT feature, lo, hi, {_EDGES50} AS e FROM g),
b AS (SELECT l.feature, l.sample, len(list_filter(e.e, lambda x: l.value >= x)) AS bin FROM l JOIN e USING (feature)
      WHERE l.value >= e.lo AND l.value <= e.hi),
h AS (SELECT k.feature, k.bin, count_if(b.sample = 'reference') AS r, count_if(b.sample = 'current') AS c
      FROM ({_BINS50}) k LEFT JOIN b ON k.feature = b.feature AND k.bin = b.bin GROUP BY k.feature, k.bin),
t AS (SELECT feature, sum(r) AS nr, sum(c) AS nc FROM h GROUP BY feature),
pq AS (SELECT h.feature, CAST(r AS DOUBLE) / nr + 1e-10 AS p, CAST(c AS DOUBLE) / nc + 1e-10 AS q FROM h JOIN t USING (feature))"""


@register("kl_histogram", dbl=["kl"], sql=f"{_UH} SELECT feature, sum(p * ln(p / q)) AS kl FROM pq GROUP BY feature")
def q_kl_histogram(spark, sf):
    return H.kl_histogram(_long(spark, sf))


@register("js_histogram", dbl=["js"], sql=f"""{_UH}
SELECT feature, sqrt(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2)))) AS js FROM pq GROUP BY feature""")
def q_js_histogram(spark, sf):
    return H.js_histogram(_long(spark, sf))


_CAT = "CASE WHEN sample = 'current' AND k % 7 = 0 THEN 'male' ELSE gender END"


@register("chi_square_categories", dbl=["chi2"], sql=f"""
WITH c AS (SELECT cat, count_if(sample = 'current') AS o, count_if(sample = 'reference') AS e
           FROM (SELECT sample, {_CAT} AS cat FROM scored_v) s WHERE cat IS NOT NULL GROUP BY cat),
t AS (SELECT sum(o) AS to_, sum(e) AS te, count(*) AS k FROM c),
x AS (SELECT c.*, t.*, CAST(to_ * (o + e) AS DOUBLE) / (to_ + te) AS eo, CAST(te * (o + e) AS DOUBLE) / (to_ + te) AS ee,
             CASE WHEN k = 2 THEN 0.5 ELSE 0.0 END AS corr FROM c, t)
SELECT sum(pow(greatest(abs(o - eo) - corr, 0.0), 2) / eo + pow(greatest(abs(e - ee) - corr, 0.0), 2) / ee) AS chi2,
       CAST(any_value(k) - 1 AS BIGINT) AS dof FROM x""")
def q_chi_square_categories(spark, sf):
    s = scored(spark, sf).select("sample", F.expr(_CAT).alias("cat"))
    return H.chi_square_categories(s, "cat", with_pvalue=False)


@register("js_categories", dbl=["js_distance"], sql=f"""
WITH c AS (SELECT cat, count_if(sample = 'current') AS a, count_if(sample = 'reference') AS b
           FROM (SELECT sample, {_CAT} AS cat FROM scored_v) s WHERE cat IS NOT NULL GROUP BY cat),
t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c),
x AS (SELECT CAST(a AS DOUBLE) / ta AS p, CAST(b AS DOUBLE) / tb AS q FROM c, t)
SELECT sqrt((sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0.0 END)
           + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0.0 END)) / 2) / ln(2) AS js_distance FROM x""")
def q_js_categories(spark, sf):
    s = scored(spark, sf).select("sample", F.expr(_CAT).alias("cat"))
    return H.js_categories(s, "cat")


_TH = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in H.FEATURE_THRESHOLDS.items())
_SCORES_SQL = f"""WITH {_CDF},
ww AS (SELECT feature, coalesce(sum(abs(Fr - Fc) * (nv - value)), 0.0) / (any_value(hi) - any_value(lo) + 1e-6) AS s FROM w GROUP BY feature),
d AS (SELECT feature, max(abs(Fr - Fc)) AS D, any_value(nr) AS n_ref, any_value(nc) AS n_cur FROM w GROUP BY feature),
kp AS (SELECT feature, D * sqrt(CAST(n_ref * n_cur AS DOUBLE) / (n_ref + n_cur)) AS lam FROM d),
ks AS (SELECT feature, CASE WHEN p < 1 THEN 1 - p ELSE 0.0 END AS s FROM (SELECT feature,
        CASE WHEN lam <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum(pow(-1, k - 1) * exp(-2 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS p FROM kp) z),
e AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM l WHERE sample = 'reference' GROUP BY feature),
b AS (SELECT l.feature, l.sample, {_ge_count('e.e', 9)} AS bin FROM l JOIN e USING (feature)),
h AS (SELECT feature, bin, count_if(sample = 'reference') AS r, count_if(sample = 'current') AS c FROM b GROUP BY feature, bin),
n AS (SELECT feature, count_if(sample = 'reference') AS nr, count_if(sample = 'current') AS nc FROM l GROUP BY feature),
ps AS (SELECT feature, sum(CASE WHEN r > 0 AND c > 0 THEN (CAST(c AS DOUBLE) / nc - CAST(r AS DOUBLE) / nr) * ln((CAST(c AS DOUBLE) / nc) / (CAST(r AS DOUBLE) / nr)) ELSE 0.0 END) / 5 AS s
       FROM h JOIN n USING (feature) GROUP BY feature),
u AS (SELECT * FROM ww UNION ALL SELECT * FROM ks UNION ALL SELECT * FROM ps),
th AS (SELECT * FROM (VALUES {_TH}) v(feature, threshold)),
sc AS (SELECT u.feature, max(s) AS drift_score FROM u GROUP BY u.feature),
fs AS (SELECT sc.feature, drift_score, coalesce(th.threshold, 0.2) AS threshold, drift_score > coalesce(th.threshold, 0.2) AS drifted
       FROM sc LEFT JOIN th USING (feature))"""


@register("feature_drift_scores", dbl=["drift_score", "threshold"], sql=f"{_SCORES_SQL} SELECT * FROM fs")
def q_feature_drift_scores(spark, sf):
    return H.feature_drift_scores(_long(spark, sf))


@register("drift_report", dbl=["mean_score"], sql=f"""{_SCORES_SQL},
r AS (SELECT avg(drift_score) AS mean_score, max(CAST(drifted AS INTEGER)) AS d,
             coalesce(list_sort(list(feature) FILTER (WHERE drifted)), []) AS drifted_features,
             list_transform(list_sort(list({{'k': -drift_score, 'f': feature}}))[1:5], lambda x: x.f) AS top_features FROM fs)
SELECT mean_score, d = 1 AS drift_detected,
       CASE WHEN mean_score > 0.4 THEN 'high' WHEN mean_score > 0.2 THEN 'medium' ELSE 'low' END AS severity,
       drifted_features, top_features,
       CASE WHEN len(drifted_features) = 0 THEN ['No drift detected. Continue monitoring.']
            ELSE ['Drift detected in ' || len(drifted_features) || ' features',
                  'Top drifted features: ' || array_to_string(top_features, ', '),
                  'Consider retraining model with new data', 'Review data pipeline for changes',
                  'Validate data quality and consistency'] END AS recommendations FROM r""")
def q_drift_report(spark, sf):
    return H.drift_report(H.feature_drift_scores(_long(spark, sf)))


_COMP_SQL = f"""{_UH},
kl AS (SELECT feature, sum(p * ln(p / q)) AS kl, sqrt(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2)))) AS js FROM pq GROUP BY feature),
e7 AS (SELECT feature, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM l WHERE sample = 'reference' GROUP BY feature),
b7 AS (SELECT l.feature, l.sample, {_ge_count('e7.e[2:10]', 9)} AS bin FROM l JOIN e7 USING (feature) WHERE l.value >= e7.e[1] AND l.value <= e7.e[11]),
h7 AS (SELECT k.feature, k.bin, count_if(b7.sample = 'reference') AS r, count_if(b7.sample = 'current') AS c
       FROM ({_BINS10}) k LEFT JOIN b7 ON k.feature = b7.feature AND k.bin = b7.bin GROUP BY k.feature, k.bin),
n7 AS (SELECT feature, count_if(sample = 'reference') AS nr, count_if(sample = 'current') AS nc FROM l GROUP BY feature),
psi AS (SELECT feature, sum(((c + 1e-6) / nc - (r + 1e-6) / nr) * ln(((c + 1e-6) / nc) / ((r + 1e-6) / nr))) AS psi FROM h7 JOIN n7 USING (feature) GROUP BY feature),
cc AS (SELECT feature, value, count_if(sample = 'reference') AS r, count_if(sample = 'current') AS c FROM l GROUP BY feature, value),
cw AS (SELECT feature, CAST(sum(r) OVER (PARTITION BY feature ORDER BY value) AS DOUBLE) / sum(r) OVER (PARTITION BY feature) AS Fr,
              CAST(sum(c) OVER (PARTITION BY feature ORDER BY value) AS DOUBLE) / sum(c) OVER (PARTITION BY feature) AS Fc FROM cc),
ks AS (SELECT feature, max(abs(Fr - Fc)) AS ks_statistic FROM cw GROUP BY feature),
cd AS (SELECT psi.feature, psi, kl, js, ks_statistic, psi > 0.2 OR kl > 0.1 OR js > 0.1 OR ks_statistic > 0.1 AS drifted
       FROM psi JOIN kl USING (feature) JOIN ks USING (feature))"""


@register("comprehensive_drift", dbl=["psi", "kl", "js", "ks_statistic"], sql=f"{_COMP_SQL} SELECT * FROM cd")
def q_comprehensive_drift(spark, sf):
    return H.comprehensive_drift(_long(spark, sf))


@register("comprehensive_verdict", dbl=["drift_share"], sql=f"""{_COMP_SQL}
SELECT avg(CAST(drifted AS DOUBLE)) AS drift_share, count(*) AS n_features,
       CASE WHEN avg(CAST(drifted AS DOUBLE)) > 0.3 THEN 'HIGH' WHEN avg(CAST(drifted AS DOUBLE)) > 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS overall_drift FROM cd""")
def q_comprehensive_verdict(spark, sf):
    return H.comprehensive_verdict(H.comprehensive_drift(_long(spark, sf)))


_MET_LONG = """
WITH c AS (SELECT model, count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 0 AND y_pred = 1) AS fp,
                  count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 1 AND y_pred = 1) AS tp FROM scored_v GROUP BY model),
m AS (SELECT model, 'recall' AS metric, CAST(tp AS DOUBLE) / (tp + fn) AS value FROM c
      UNION ALL SELECT model, 'precision', CAST(tp AS DOUBLE) / (tp + fp) FROM c
      UNION ALL SELECT model, 'accuracy', CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) FROM c)"""


def _metrics_long(spark, sf, model):
    t = M.threshold_metrics(scored(spark, sf), group_cols=["model"]).where(F.col("model") == model)
    return t.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                        for m in ("recall", "precision", "accuracy")])).alias("s")).select("s.*")


@register("model_drift", dbl=["cur", "base", "change"], sql=f"""{_MET_LONG}
SELECT a.metric, a.value AS cur, b.value AS base,
       CASE WHEN b.value = 0 THEN abs(a.value - b.value) ELSE abs(a.value - b.value) / abs(b.value) END AS change,
       CASE WHEN b.value = 0 THEN abs(a.value - b.value) ELSE abs(a.value - b.value) / abs(b.value) END > 0.02 AS drifted
FROM (SELECT * FROM m WHERE model = 'm1') a JOIN (SELECT * FROM m WHERE model = 'm2') b USING (metric)""")
def q_model_drift(spark, sf):
    return H.model_drift(_metrics_long(spark, sf, "m1"), _metrics_long(spark, sf, "m2"), threshold=0.02)


@register("concept_drift", dbl=["recent_accuracy", "earlier_accuracy"], sql="""
WITH r AS (SELECT row_number() OVER (ORDER BY k) - 1 AS rn, CAST(y_true = y_pred AS DOUBLE) AS ok FROM scored_v),
n AS (SELECT count(*) AS n FROM r),
w AS (SELECT range AS win FROM range(0, (SELECT n FROM n)) WHERE range * 50 < (SELECT n FROM n) - 100),
a AS (SELECT win, avg(ok) AS acc FROM w JOIN r ON r.rn >= win * 50 AND r.rn < win * 50 + 100 GROUP BY win),
m AS (SELECT max(win) AS mx FROM a)
SELECT avg(CASE WHEN win > mx - 3 THEN acc END) AS recent_accuracy, avg(CASE WHEN win <= mx - 3 THEN acc END) AS earlier_accuracy,
       count(*) AS n_windows,
       coalesce(count(*) > 3 AND avg(CASE WHEN win <= mx - 3 THEN acc END) - avg(CASE WHEN win > mx - 3 THEN acc END) > 0.15, false) AS concept_drift
FROM a, m""")
def q_concept_drift(spark, sf):
    return H.concept_drift(scored(spark, sf), ["k"], "y_true", "y_pred")


@register("drift_history_summary", dbl=["detected_ratio", "latest_score"], sql="""
WITH r AS (SELECT * FROM runs_v WHERE run_date > DATE '2024-02-29' - 30),
s AS (SELECT count(*) AS n_reports, avg(CAST(drift_score > 0.2 AS DOUBLE)) AS detected_ratio,
             arg_max(drift_score, (run_date, run_id)) AS latest_score FROM r),
f AS (SELECT list_transform(list_sort(list({'k': -n, 'f': feature}))[1:10], lambda x: x.f) AS top_features
      FROM (SELECT feature, count(*) AS n FROM r WHERE drift_score > 0.2 GROUP BY feature) x)
SELECT n_reports, detected_ratio, latest_score,
       CASE WHEN latest_score > 0.4 THEN 'high' WHEN latest_score > 0.2 THEN 'medium' ELSE 'low' END AS latest_severity, top_features
FROM s, f""")
def q_drift_history_summary(spark, sf):
    return H.drift_history_summary(runs(spark, sf), F.lit("2024-02-29").cast("date"))


@register("recent_drift_checks", sql="""
WITH e AS (SELECT run_date, feature, max(drift_score) > 0.2 AS drifted FROM runs_v WHERE run_date IS NOT NULL GROUP BY run_date, feature),
c AS (SELECT run_date, avg(CAST(coalesce(drifted, false) AS DOUBLE)) AS share,
             coalesce(list_sort(list(feature) FILTER (WHERE drifted)), []) AS drifting_features FROM e GROUP BY run_date),
k AS (SELECT *, CASE WHEN share > 0.3 THEN 'HIGH' WHEN share > 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
             row_number() OVER (ORDER BY run_date DESC) AS rn FROM c)
SELECT count(*) AS total_checks, count_if(rn <= 10) AS recent_checks, count_if(rn <= 10 AND risk = 'HIGH') AS recent_drift_count,
       coalesce(arg_max(risk, run_date), 'UNKNOWN') AS overall_risk,
       coalesce(arg_max(drifting_features, run_date), []) AS drifting_features FROM k""")
def q_recent_drift_checks(spark, sf):
    return H.recent_drift_checks(H.drift_checks(runs(spark, sf)))


# ---------------------------------------------------------------- fairness
def _fair_sql(src, group):
    return f"""
WITH g AS (SELECT {group}, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
                  count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn, count(*) AS count
           FROM ({src}) s GROUP BY {group}),
fm AS (SELECT {group}, count, tp, fp, fn, tn,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS tpr, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0.0) AS fpr,
         coalesce(CAST(fn AS DOUBLE) / nullif(fn + tp, 0), 0.0) AS fnr, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0) AS tnr,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
         coalesce(CAST(tp + tn AS DOUBLE) / nullif(count, 0), 0.0) AS accuracy, coalesce(CAST(tp + fp AS DOUBLE) / nullif(count, 0), 0.0) AS selection_rate
       FROM g),
fmf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM fm)"""


_FAIR_DBL = ["tpr", "fpr", "fnr", "tnr", "precision", "recall", "f1", "accuracy", "selection_rate"]
_DOC_SRC = "SELECT d.lang, l.quality AS y_true, CAST(d.n_chars > 500 AS INTEGER) AS y_pred FROM documents d JOIN labels l USING (doc_id)"


@register("group_fairness", dbl=_FAIR_DBL, sql=_fair_sql("SELECT * FROM scored_v", "gender") + " SELECT * FROM fmf")
def q_group_fairness(spark, sf):
    return FA.group_fairness(scored(spark, sf), "gender")


@register("group_fairness_documents", dbl=_FAIR_DBL, sql=_fair_sql(_DOC_SRC, "lang") + " SELECT * FROM fmf")
def q_group_fairness_documents(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("lang", F.col("quality").alias("y_true"), (F.col("n_chars") > 500).cast("int").alias("y_pred"))
    return FA.group_fairness(d, "lang")


def _disp_sql(src, group):
    return _fair_sql(src, group) + f""",
mj AS (SELECT arg_max({{'g': {group}, 'par': tpr + fpr, 'tpr': tpr, 'sr': selection_rate}}, (count, {group})) AS m, count(*) AS k FROM fmf),
dp AS (SELECT fmf.{group}, mj.m.g AS reference_group,
         CASE WHEN mj.m.par = 0 THEN 1.0 ELSE (tpr + fpr) / mj.m.par END AS demographic_parity,
         CASE WHEN mj.m.tpr = 0 THEN 1.0 ELSE tpr / mj.m.tpr END AS equal_opportunity,
         CASE WHEN mj.m.par = 0 THEN 1.0 ELSE (tpr + fpr) / mj.m.par END AS disparate_impact,
         CASE WHEN mj.m.sr = 0 THEN 1.0 ELSE selection_rate / mj.m.sr END AS selection_rate_ratio
       FROM fmf, mj WHERE mj.k >= 2 AND fmf.{group} <> mj.m.g)"""


_AGEBAND = "SELECT *, CASE WHEN age < 35 THEN 'under35' WHEN age < 50 THEN '35to49' WHEN age < 65 THEN '50to64' ELSE '65plus' END AS age_band FROM scored_v"


def _ageband(spark, sf):
    return scored(spark, sf).withColumn("age_band", F.expr(
        "CASE WHEN age < 35 THEN 'under35' WHEN age < 50 THEN '35to49' WHEN age < 65 THEN '50to64' ELSE '65plus' END"))


@register("group_disparity", dbl=["demographic_parity", "equal_opportunity", "disparate_impact", "selection_rate_ratio"],
          sql=_disp_sql(_AGEBAND, "age_band") + " SELECT * FROM dp")
def q_group_disparity(spark, sf):
    return FA.group_disparity(FA.group_fairness(_ageband(spark, sf), "age_band"), "age_band")


_VIOL = """,
lg AS (SELECT {g}, 'demographic_parity' AS metric, demographic_parity AS value FROM dp
       UNION ALL SELECT {g}, 'equal_opportunity', equal_opportunity FROM dp
       UNION ALL SELECT {g}, 'disparate_impact', disparate_impact FROM dp),
v AS (SELECT {g}, metric, value FROM lg WHERE value < {t}
      UNION ALL SELECT {g}, 'small_group', CAST(count AS DOUBLE) / (SELECT sum(count) FROM fmf) FROM fmf
      WHERE count < 0.05 * (SELECT sum(count) FROM fmf))"""


@register("fairness_violations", dbl=["value"], sql=_disp_sql(_DOC_SRC, "lang") + _VIOL.format(g="lang", t=0.95) + " SELECT * FROM v")
def q_fairness_violations(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("lang", F.col("quality").alias("y_true"), (F.col("n_chars") > 500).cast("int").alias("y_pred"))
    m = FA.group_fairness(d, "lang")
    return FA.fairness_violations(m, FA.group_disparity(m, "lang"), "lang", threshold=0.95)


@register("fairness_severity", dbl=["min_ratio"], sql=_disp_sql(_DOC_SRC, "lang") + _VIOL.format(g="lang", t=0.95) + """
SELECT count(*) AS n_violations, min(CASE WHEN metric <> 'small_group' THEN value END) AS min_ratio,
       CASE WHEN count(*) = 0 THEN 'low' WHEN count(*) > 3 THEN 'critical'
            WHEN coalesce(min(CASE WHEN metric <> 'small_group' THEN value END) < 0.95 * 0.95, false) THEN 'high'
            WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM v""")
def q_fairness_severity(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("lang", F.col("quality").alias("y_true"), (F.col("n_chars") > 500).cast("int").alias("y_pred"))
    m = FA.group_fairness(d, "lang")
    return FA.fairness_severity(FA.fairness_violations(m, FA.group_disparity(m, "lang"), "lang", 0.95), 0.95)


@register("fairness_threshold_table", sql=_fair_sql(_AGEBAND, "age_band") + """
SELECT age_band, recall >= 0.8 AS recall_ok, precision >= 0.8 AS precision_ok, f1 >= 0.8 AS f1_ok,
       recall >= 0.8 AND precision >= 0.8 AND f1 >= 0.8 AS all_ok FROM fmf""")
def q_fairness_threshold_table(spark, sf):
    return FA.fairness_threshold_table(FA.group_fairness(_ageband(spark, sf), "age_band"), "age_band")


@register("bias_history_summary", sql="""
WITH r AS (SELECT * FROM runs_v WHERE run_date > DATE '2024-02-29' - 30),
s AS (SELECT count(*) AS n_reports, CAST(sum(n_violations) AS BIGINT) AS total_violations, count(DISTINCT feature) AS n_attributes,
             list_sort(list(DISTINCT feature)) AS attributes, arg_max(n_violations, (run_date, run_id)) AS latest_violations FROM r)
SELECT *, CASE WHEN latest_violations = 0 THEN 'low' WHEN latest_violations > 3 THEN 'critical'
               WHEN latest_violations >= 2 THEN 'medium' ELSE 'low' END AS latest_severity FROM s""")
def q_bias_history_summary(spark, sf):
    return FA.bias_history_summary(runs(spark, sf), F.lit("2024-02-29").cast("date"))


# ---------------------------------------------------------------- outcomes
_OUT_SQL = """
WITH p AS (SELECT k AS prediction_id, y_pred AS predicted, y_prob, age, glucose, bmi FROM scored_v),
o AS (SELECT k AS prediction_id, y_true AS actual_outcome, visit_ts + to_days(CAST(k % 30 AS INTEGER)) AS outcome_ts FROM scored_v WHERE k % 4 <> 0),
j AS (SELECT p.*, o.actual_outcome, o.outcome_ts, CAST(p.predicted = o.actual_outcome AS INTEGER) AS correct FROM p JOIN o USING (prediction_id))"""


def _joined(spark, sf):
    s = scored(spark, sf)
    p = s.select(F.col("k").alias("prediction_id"), F.col("y_pred").alias("predicted"), "y_prob", "age", "glucose", "bmi")
    o = s.where("k % 4 <> 0").select(F.col("k").alias("prediction_id"), F.col("y_true").alias("actual_outcome"),
                                     F.expr("visit_ts + make_dt_interval(CAST(k % 30 AS INT))").alias("outcome_ts"))
    return O.join_outcomes(p, o)


@register("join_outcomes", dbl=["y_prob", "glucose", "bmi"], sql=_OUT_SQL + " SELECT * FROM j")
def q_join_outcomes(spark, sf):
    return _joined(spark, sf)


@register("retraining_set", dbl=["glucose", "bmi"], sql=_OUT_SQL + """
SELECT age, glucose, bmi, actual_outcome AS target, prediction_id, correct FROM j""")
def q_retraining_set(spark, sf):
    return O.retraining_set(_joined(spark, sf), ["age", "glucose", "bmi"])


@register("accuracy_trend", dbl=["accuracy", "overall_accuracy", "last_n_accuracy"], sql=_OUT_SQL + """,
m AS (SELECT date_trunc('month', outcome_ts) AS month, avg(correct) AS accuracy, count(*) AS n FROM j GROUP BY 1),
e AS (SELECT arg_min(accuracy, month) AS f, arg_max(accuracy, month) AS l FROM m),
r AS (SELECT avg(correct) AS last_n_accuracy FROM (SELECT correct FROM j ORDER BY outcome_ts DESC, prediction_id DESC LIMIT 100) x),
ov AS (SELECT avg(correct) AS overall_accuracy FROM j)
SELECT m.*, ov.overall_accuracy, r.last_n_accuracy, CASE WHEN e.l > e.f THEN 'improving' ELSE 'declining' END AS trend FROM m, e, r, ov""")
def q_accuracy_trend(spark, sf):
    return O.accuracy_trend(_joined(spark, sf))


@register("retrain_decision", dbl=["recent_accuracy"], sql=_OUT_SQL + """,
r AS (SELECT avg(correct) AS recent_accuracy, count(*) AS recent_count FROM (SELECT correct FROM j ORDER BY outcome_ts DESC, prediction_id DESC LIMIT 100) x),
a AS (SELECT date_diff('day', max(outcome_ts), TIMESTAMP '2024-06-30 00:00:00') AS age_days FROM j)
SELECT recent_accuracy, recent_count,
       len(list_filter([CASE WHEN recent_count >= 50 AND recent_accuracy < 0.75 THEN 'low recent accuracy' END,
                        CASE WHEN age_days > 30 THEN 'model too old' END], lambda x: x IS NOT NULL)) > 0 AS retrain
FROM r, a""")
def q_retrain_decision(spark, sf):
    j = _joined(spark, sf)
    r = j.orderBy(F.col("outcome_ts").desc(), F.col("prediction_id").desc()).limit(100).agg(
        F.avg("correct").alias("recent_accuracy"), F.count(F.lit(1)).alias("recent_count"))
    a = j.agg(F.datediff(F.lit("2024-06-30").cast("date"), F.to_date(F.max("outcome_ts"))).alias("age_days"))
    d = r.crossJoin(a).select("recent_accuracy", "recent_count", O.retrain_decision(
        F.lit("LOW"), F.col("recent_accuracy"), F.col("recent_count"), F.col("age_days")).alias("d"))
    return d.select("recent_accuracy", "recent_count", F.col("d.retrain").alias("retrain"))


@register("promotion_gate", dbl=["cand_recall", "cand_accuracy", "cur_recall", "cur_accuracy"], sql="""
WITH c AS (SELECT model, count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 0 AND y_pred = 1) AS fp,
                  count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 1 AND y_pred = 1) AS tp FROM scored_v GROUP BY model),
m AS (SELECT model, CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy FROM c),
j AS (SELECT a.recall AS cand_recall, a.accuracy AS cand_accuracy, b.recall AS cur_recall, b.accuracy AS cur_accuracy
      FROM (SELECT * FROM m WHERE model = 'm1') a, (SELECT * FROM m WHERE model = 'm2') b)
SELECT *, list_filter([CASE WHEN cand_recall < 0.8 THEN 'recall below threshold' END,
                       CASE WHEN cand_accuracy < 0.6 THEN 'accuracy below threshold' END,
                       CASE WHEN cand_recall - cur_recall < 0.01 THEN 'insufficient improvement' END], lambda x: x IS NOT NULL) AS errors,
       len(list_filter([CASE WHEN cand_recall < 0.8 THEN 1 END, CASE WHEN cand_accuracy < 0.6 THEN 1 END,
                        CASE WHEN cand_recall - cur_recall < 0.01 THEN 1 END], lambda x: x IS NOT NULL)) = 0 AS promote FROM j""")
def q_promotion_gate(spark, sf):
    t = M.threshold_metrics(scored(spark, sf), group_cols=["model"])
    cand = t.where("model = 'm1'").select("recall", "accuracy", F.lit(None).cast("boolean").alias("golden_pass"),
                                          F.lit(None).cast("int").alias("fairness_violations"))
    cur = t.where("model = 'm2'").select("recall", "accuracy")
    g = O.promotion_gate(cand, cur)
    return g.select("cand_recall", "cand_accuracy", "cur_recall", "cur_accuracy", "errors", "promote")


@register("canary_compare")
def q_canary_compare(spark, sf):
    from sparkclin.operators.rules import classify_risk
    s = scored(spark, sf).select("track", F.col("y_prob").alias("probability"),
                                 classify_risk(F.col("y_prob") * 100).alias("risk_level"))
    return O.canary_compare(s)


def _erf_sql(x):
    from sparkclin.operators.drift import _ERF_A, _ERF_P
    t = f"(1.0 / (1.0 + {_ERF_P} * abs({x})))"
    poly = f"{t} * ({_ERF_A[0]} + {t} * ({_ERF_A[1]} + {t} * ({_ERF_A[2]} + {t} * ({_ERF_A[3]} + {t} * {_ERF_A[4]}))))"
    y = f"(1.0 - {poly} * exp(-abs({x}) * abs({x})))"
    return f"CASE WHEN {x} < 0 THEN -{y} ELSE {y} END"


_FD_COLS = ["glucose", "bmi", "insulin", "age"]
_FD_LONG = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM patients_v WHERE {c} IS NOT NULL"
                                for c in _FD_COLS)


@register("fit_distribution", dbl=["d_normal", "d_exponential", "d_uniform"], sql=f"""
WITH l AS ({_FD_LONG}),
p AS (SELECT feature, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature),
c AS (SELECT feature, value, count(*) AS c FROM l GROUP BY feature, value),
k AS (SELECT c.*, sum(c) OVER (PARTITION BY c.feature ORDER BY value) AS cum, p.n, p.m, p.s, p.lo, p.hi FROM c JOIN p USING (feature)),
f AS (SELECT *, 0.5 * (1 + ({_erf_sql('((value - m) / (s * sqrt(2.0)))')})) AS fn,
             CASE WHEN value < lo THEN 0.0 ELSE 1 - exp(-(value - lo) / (m - lo)) END AS fe,
             least(1.0, greatest(0.0, (value - lo) / (hi - lo))) AS fu FROM k),
d AS (SELECT feature, max(greatest(fn - (cum - c) / n, cum / n - fn)) AS d_normal,
             max(greatest(fe - (cum - c) / n, cum / n - fe)) AS d_exponential,
             max(greatest(fu - (cum - c) / n, cum / n - fu)) AS d_uniform FROM f GROUP BY feature)
SELECT *, list_sort([{{'d': d_normal, 'i': 0, 'k': 'normal'}}, {{'d': d_exponential, 'i': 1, 'k': 'exponential'}},
                     {{'d': d_uniform, 'i': 2, 'k': 'uniform'}}])[1].k AS best_fit FROM d""")
def q_fit_distribution(spark, sf):
    return H.fit_distribution(patients(spark, sf), _FD_COLS, ("normal", "exponential", "uniform"), with_pvalue=False)


@register("fit_distribution_families")
def q_fit_distribution_families(spark, sf):
    """All five families with p-values (incomplete gamma and beta integrals are beyond SQL)."""
    return H.fit_distribution(patients(spark, sf), _FD_COLS)
