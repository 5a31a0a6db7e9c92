"""Registered queries for group E (training, scoring, calibration, explanation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.operators import metrics as M
from sparkclin.operators import calibration as C
from sparkclin.operators import model as E
from sparkclin.operators import shapley as S
from sparkclin.plans.registry import register
from sparkclin.session import stored
from sparkclin.sources.views import patients, scored

COEF = {"glucose": 0.03, "bmi": 0.08, "age": 0.02}
FEATS = ["glucose", "bmi", "age", "insulin", "diabetes_pedigree"]


def _d(x):
    return f"CAST({x} AS DOUBLE)"


@register("class_weights", dbl=["weight"], sql="""
WITH c AS (SELECT y_true, count(*) AS nc FROM scored_v GROUP BY y_true),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT c.y_true, c.nc, CAST(t.n AS DOUBLE) / (t.k * c.nc) AS weight FROM c, t""")
def q_class_weights(spark, sf):
    s = scored(spark, sf).select("y_true")
    w = E.class_weights(s, "y_true")
    return w.groupBy("y_true", "weight").agg(F.count(F.lit(1)).alias("nc")).select("y_true", "nc", "weight")


@register("stratified_folds", sql="""
SELECT y_true, fold, count(*) AS n FROM (
  SELECT y_true, CAST((row_number() OVER (PARTITION BY y_true ORDER BY CAST('0x' || substr(md5(patient_id), 1, 8) AS BIGINT), patient_id) - 1) % 5 AS INTEGER) AS fold
  FROM scored_v) t GROUP BY y_true, fold""")
def q_stratified_folds(spark, sf):
    f = E.stratified_folds(scored(spark, sf).select("patient_id", "y_true"), "y_true", "patient_id", 5)
    return f.groupBy("y_true", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_fold_members", sql="""
SELECT patient_id, y_true, CAST((row_number() OVER (PARTITION BY y_true ORDER BY CAST('0x' || substr(md5(patient_id), 1, 8) AS BIGINT), patient_id) - 1) % 5 AS INTEGER) AS fold
FROM scored_v""")
def q_stratified_fold_members(spark, sf):
    return E.stratified_folds(scored(spark, sf).select("patient_id", "y_true"), "y_true", "patient_id", 5)


_LOGIT = "(((" + _d(-7.08) + "".join(f" + {_d(w)} * {_d(c)})" for c, w in COEF.items())


@register("score_linear", dbl=["probability", "risk_score", "confidence"], sql=f"""
SELECT patient_id, p AS probability, p * 100 AS risk_score,
       CASE WHEN p * 100 < 30 THEN 'Low Risk' WHEN p * 100 < 60 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_level,
       least(abs(p - 0.5) * 2, 0.99) AS confidence
FROM (SELECT patient_id, 1.0 / (1.0 + exp(-{_LOGIT})) AS p FROM patients_v) t""")
def q_score_linear(spark, sf):
    p = patients(spark, sf).select("patient_id", *COEF)
    return E.score_linear(p, COEF, -7.08).drop(*COEF)


_TM = """
SELECT model, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
       coalesce(CAST(tp + tn AS DOUBLE) / nullif(tn + fp + fn + tp, 0), 0.0) AS accuracy
FROM (SELECT model, count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 0 AND y_pred = 1) AS fp,
             count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 1 AND y_pred = 1) AS tp FROM scored_v GROUP BY model) c"""


@register("select_best_model", dbl=["recall", "accuracy"], sql=f"SELECT * FROM ({_TM}) m ORDER BY recall DESC, model LIMIT 1")
def q_select_best_model(spark, sf):
    m = M.threshold_metrics(scored(spark, sf), group_cols=["model"]).select("model", "recall", "accuracy")
    return E.select_best_model(m, "recall", "model")


_TEMPS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]


@register("calibrate_temperature", dbl=["temperature", "log_loss"], sql=f"""
WITH g AS (SELECT * FROM (VALUES {', '.join(f'({_d(t)})' for t in _TEMPS)}) v(temperature)),
z AS (SELECT ln(CAST(y_prob AS DOUBLE) / (1 - CAST(y_prob AS DOUBLE) + 1e-6)) AS z, y_true FROM scored_v),
p AS (SELECT temperature, y_true, greatest(least(1 / (1 + exp(-z / temperature)), 1 - CAST(1e-15 AS DOUBLE)), CAST(1e-15 AS DOUBLE)) AS pc FROM z, g),
l AS (SELECT temperature, avg(-(CASE WHEN y_true = 1 THEN ln(pc) ELSE ln(1 - pc) END)) AS log_loss FROM p GROUP BY temperature)
SELECT temperature, log_loss, temperature = (SELECT arg_min(temperature, (log_loss, temperature)) FROM l) AS is_best FROM l""")
def q_calibrate_temperature(spark, sf):
    return E.temperature_grid(scored(spark, sf), "y_prob", "y_true", _TEMPS)


# Missing features take the table's median (D17): every patient is explained.
_EXPL_SRC = f"""SELECT patient_id, {', '.join(f'coalesce({c}, md_{c}) AS {c}' for c in COEF)}
  FROM patients_v, (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS md_{c}' for c in COEF)} FROM patients_v) md"""
_ARR = ", ".join(f"{{'k': -abs({_d(w)} * ({c} - m_{c})), 'f': '{c}', 'c': {_d(w)} * ({c} - m_{c})}}" for c, w in COEF.items())
_EXPLAIN_SQL = f"""
WITH src AS ({_EXPL_SRC}),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in COEF)} FROM src),
a AS (SELECT patient_id, glucose, bmi, age, list_sort([{_ARR}]) AS arr FROM src, m)"""


def _imputed(df, cols):
    """Columns as doubles with nulls replaced by their medians."""
    from sparkclin.operators import prep as P
    return P.impute_simple(df, cols, "median")


@register("explain_linear", dbl=["top_contribution"], sql=f"""
{_EXPLAIN_SQL}
SELECT patient_id, list_transform(arr[1:5], lambda x: x.f) AS top_factors, arr[1].c AS top_contribution FROM a""")
def q_explain_linear(spark, sf):
    p = _imputed(patients(spark, sf).select("patient_id", *COEF), list(COEF))
    x = E.explain_linear(p, COEF, id_cols=["patient_id"])
    return x.select("patient_id", "top_factors", F.col("contributing_factors")[0]["contribution"].alias("top_contribution"))


@register("top_factors", dbl=["magnitude"], sql=f"""
{_EXPLAIN_SQL}
SELECT patient_id, arr[1].f AS feature, CASE WHEN arr[1].c > 0 THEN 'positive' ELSE 'negative' END AS direction,
       CASE WHEN arr[1].c > 0 THEN 'increases' ELSE 'decreases' END AS impact,
       abs(arr[1].c) AS magnitude FROM a""")
def q_top_factors(spark, sf):
    p = _imputed(patients(spark, sf).select("patient_id", *COEF), list(COEF))
    x = E.explain_linear(p, COEF, id_cols=["patient_id"])
    f = F.col("contributing_factors")[0]
    return x.select("patient_id", f["feature"].alias("feature"), f["direction"].alias("direction"),
                    f["impact"].alias("impact"), f["magnitude"].alias("magnitude"))


@register("global_importance", dbl=["mean_abs_contribution"], sql=f"""
{_EXPLAIN_SQL},
e AS (SELECT unnest(arr) AS x FROM a)
SELECT x.f AS feature, avg(abs(x.c)) AS mean_abs_contribution FROM e GROUP BY x.f
ORDER BY mean_abs_contribution DESC, feature LIMIT 10""")
def q_global_importance(spark, sf):
    p = _imputed(patients(spark, sf).select("patient_id", *COEF), list(COEF))
    return E.global_importance(p, COEF)


@register("explanation_text", sql=f"""
{_EXPLAIN_SQL},
t AS (SELECT patient_id, glucose, bmi, age,
        list_transform(list_filter(arr[1:5], lambda x: x.c > 0.05), lambda x: x.f) AS risk,
        list_transform(list_filter(arr[1:5], lambda x: x.c < -0.05), lambda x: x.f) AS prot,
        list_filter([CASE WHEN glucose > 126 THEN format('Glucose ({{:.1f}} mg/dL) is elevated (>126 mg/dL)', CAST(glucose AS DOUBLE)) END,
                     CASE WHEN bmi > 30 THEN format('BMI ({{:.1f}}) indicates obesity', CAST(bmi AS DOUBLE)) END,
                     CASE WHEN age > 60 THEN format('Age ({{:.0f}} years) is a significant risk factor', CAST(age AS DOUBLE)) END],
                    lambda x: x IS NOT NULL) AS fnd FROM a)
SELECT patient_id, concat(
   CASE WHEN len(risk) > 0 THEN 'Risk is primarily driven by: ' || array_to_string(risk, ', ') || '. '
        ELSE 'No significant risk factors identified. ' END,
   CASE WHEN len(prot) > 0 THEN 'Protective factors include: ' || array_to_string(prot, ', ') || '. ' ELSE '' END,
   CASE WHEN len(fnd) > 0 THEN 'Clinically relevant findings: ' || array_to_string(fnd, '. ') ELSE '' END) AS clinical_explanation FROM t""")
def q_explanation_text(spark, sf):
    p = _imputed(patients(spark, sf).select("patient_id", *COEF), list(COEF))
    x = E.explain_linear(p, COEF, id_cols=["patient_id"])
    return E.explanation_text(x).select("patient_id", "clinical_explanation")


_NOTE_ROWS = ", ".join(f"('{f}', '{t}')" for f, t in E.CLINICAL_NOTES.items())


@register("clinical_notes", dbl=["mean_abs_contribution"], sql=f"""
{_EXPLAIN_SQL},
e AS (SELECT unnest(arr) AS x FROM a),
g AS (SELECT x.f AS feature, avg(abs(x.c)) AS mean_abs_contribution FROM e GROUP BY x.f ORDER BY mean_abs_contribution DESC, feature LIMIT 10),
n AS (SELECT * FROM (VALUES {_NOTE_ROWS}) v(feature, note))
SELECT g.feature, g.mean_abs_contribution, coalesce(n.note, 'Clinical significance of ' || g.feature || ' should be evaluated') AS note
FROM g LEFT JOIN n USING (feature)""")
def q_clinical_notes(spark, sf):
    p = _imputed(patients(spark, sf).select("patient_id", *COEF), list(COEF))
    return E.clinical_notes(E.global_importance(p, COEF))


# ------------------------------------------------------------- Spark ML fits (rows-only checks)
def _train_frame(spark, sf):
    s = scored(spark, sf).select("patient_id", *FEATS, F.col("y_true").cast("double").alias("target"))
    return stored(_imputed(s, FEATS), "train")  # fits read it many times: medians are found once


@register("train_logistic")
def q_train_logistic(spark, sf):
    m = E.train_logistic(_train_frame(spark, sf), FEATS)
    return E.feature_importance(m, FEATS)


@register("train_forest")
def q_train_forest(spark, sf):
    m = E.train_forest(_train_frame(spark, sf), FEATS, n_trees=20, max_depth=5)
    return E.feature_importance(m, FEATS)


@register("train_boosted")
def q_train_boosted(spark, sf):
    m = E.train_boosted(_train_frame(spark, sf), FEATS, max_iter=10, max_depth=3)
    return E.feature_importance(m, FEATS)


@register("grid_search_cv")
def q_grid_search_cv(spark, sf):
    d = _train_frame(spark, sf).withColumnRenamed("patient_id", "id")
    cv = E.grid_search_cv(d, FEATS, "target", k=3, grid={"regParam": [0.0, 0.01], "elasticNetParam": [0.0, 1.0]},
                          parallelism=2)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(cv.avgMetrics)], "grid_point int, mean_recall double")


# Fixed values of the random search: draws, folds and the C of the logistic grid (src/components/model_training.py:53-58, 287).
SEARCH_DRAWS, SEARCH_FOLDS = 50, 5
SEARCH_C = [0.001, 0.01, 0.1, 1, 10, 100]


@register("random_search_cv")
def q_random_search_cv(spark, sf):
    """50 draws of 54 points: each C as 1/(C·n) and three shares of n, l2 / mixed / l1, balanced or equal weights."""
    d = _train_frame(spark, sf).withColumnRenamed("patient_id", "id").withColumn("unit", F.lit(1.0))
    n = max(d.count(), 1) * (SEARCH_FOLDS - 1) / SEARCH_FOLDS  # rows a fold's model is fitted on
    grid = {"regParam": [0.0, 0.01, 0.1] + [1.0 / (c * n) for c in SEARCH_C], "elasticNetParam": [0.0, 0.5, 1.0],
            "weightCol": ["weight", "unit"]}
    cv = E.grid_search_cv(d, FEATS, "target", k=SEARCH_FOLDS, grid=grid, random_draws=SEARCH_DRAWS, together=True)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(cv.avgMetrics)], "draw int, mean_recall double")


@register("baseline_cv")
def q_baseline_cv(spark, sf):
    d = _train_frame(spark, sf).withColumnRenamed("patient_id", "id")
    cv = E.grid_search_cv(d, FEATS, "target", k=3, grid=None, parallelism=1)
    return spark.createDataFrame([(float(cv.avgMetrics[0]),)], "mean_recall double")


@register("score_batch")
def q_score_batch(spark, sf):
    from sparkclin.operators import rules as G
    d = _train_frame(spark, sf)
    m = E.train_logistic(d, FEATS)
    allp = scored(spark, sf).select("patient_id", *FEATS)
    fb = G.fallback_score(G.safe_defaults(allp.select("patient_id", "glucose", "bmi", "age")))
    return E.score_batch(m, allp, FEATS, fallback=fb, key="patient_id")


def _oof(spark, sf):
    """Every patient scored by the one of five logistic models that has not seen it."""
    d = _train_frame(spark, sf)
    return C.out_of_fold_scores(d, ["glucose", "bmi", "age"], "target", "patient_id",
                                lambda x: E.train_logistic(x, ["glucose", "bmi", "age"]), parallelism=3)[0]


@register("calibrate_platt")
def q_calibrate_platt(spark, sf):
    return C.fit_sigmoids(_oof(spark, sf)).drop("fold")


@register("calibrate_platt_folds")
def q_calibrate_platt_folds(spark, sf):
    """One sigmoid a fold, for an ensemble of the fold models."""
    return C.fit_sigmoids(_oof(spark, sf), by_fold=True)


@register("calibrate_isotonic")
def q_calibrate_isotonic(spark, sf):
    return C.isotonic_blocks(_oof(spark, sf))


_ISO = ["lo", "hi", "value", "weight"]


@register("isotonic_blocks", dbl=_ISO, sql="""
WITH RECURSIVE pts AS (SELECT CAST(round(y_prob, 1) AS DOUBLE) AS x, sum(CAST(y_true AS DOUBLE)) AS t, CAST(count(*) AS DOUBLE) AS w
             FROM scored_v WHERE y_prob IS NOT NULL GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM pts),
-- value of point i: the greatest over j <= i of the least over k >= i of the mean of points j..k
c AS (SELECT i, sum(t) OVER (ORDER BY i) AS ct, sum(w) OVER (ORDER BY i) AS cw, t, w, x FROM p),
m AS (SELECT a.i AS j, b.i AS k, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.i <= b.i),
v AS (SELECT i, max(least_mean) AS value FROM (SELECT c.i, m.j, min(m.mean) AS least_mean FROM c JOIN m ON m.j <= c.i AND m.k >= c.i
      GROUP BY c.i, m.j) GROUP BY i)
SELECT min(x) AS lo, max(x) AS hi, v.value, sum(w) AS weight FROM v JOIN p USING (i) GROUP BY v.value""")
def q_isotonic_blocks(spark, sf):
    s = scored(spark, sf).select(F.round("y_prob", 1).alias("score"), F.col("y_true").alias("target"))
    return C.isotonic_blocks(s)


@register("calibrated_scores")
def q_calibrated_scores(spark, sf):
    """Every out-of-fold score with its isotonic value."""
    s = stored(_oof(spark, sf).select("patient_id", "score", "target"), "scores")
    return C.apply_isotonic(s, C.isotonic_blocks(s)).drop("target")


def _background(d):
    """A seeded hash sample of the whole table."""
    return d.orderBy(F.md5("patient_id"), "patient_id").limit(S.BACKGROUND_ROWS)


@register("explain_sampled")
def q_explain_sampled(spark, sf):
    d = _train_frame(spark, sf)
    cols = ["glucose", "bmi", "age"]
    return S.explain_sampled(S.model_predictor(E.train_logistic(d, cols)), d, _background(d), cols, "patient_id")


@register("explain_sampled_linear", dbl=["contribution"], sql=f"""
WITH d AS (SELECT patient_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in COEF)} FROM patients_v WHERE glucose IS NOT NULL),
b AS (SELECT * FROM d ORDER BY md5(patient_id), patient_id LIMIT 50),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in COEF)} FROM b)
{' UNION ALL '.join(f"SELECT patient_id, '{c}' AS feature, {w} * ({c} - m_{c}) AS contribution FROM d, m" for c, w in COEF.items())}""")
def q_explain_sampled_linear(spark, sf):
    """The margin of a linear model: sampled shares equal the exact contributions."""
    d = patients(spark, sf).select("patient_id", *COEF).where("glucose IS NOT NULL")
    predict = S.linear_predictor(list(COEF.values()), -7.08, margin=True)
    return S.explain_sampled(predict, d, _background(d), list(COEF), "patient_id")
