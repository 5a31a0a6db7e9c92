"""Registered queries for group G (risk rules, decisions, review) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.operators import quality as B
from sparkclin.operators import rules as G
from sparkclin.plans.registry import register
from sparkclin.plans.scoring import AGE_BAND_EDGES, FLAGSHIP_COEF, FLAGSHIP_INTERCEPT, flagship
from sparkclin.sources.views import patients, reviews, scored


def _d(x):
    return f"CAST({x} AS DOUBLE)"


def _band(col, edges, labels):
    return "CASE " + " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                              for lo, hi, lab in zip(edges[:-1], edges[1:], labels)) + " END"


_SCORED_COLS = ["patient_id", "k", "visit_ts", "age", "sex", "gender", "pregnancies", "glucose", "blood_pressure",
                "skin_thickness", "insulin", "bmi", "diabetes_pedigree", "entity_id", "y_prob", "y_true", "sample",
                "track", "model"]
_VALID = " AND ".join(f"NOT coalesce({r.when}, false)" for r in B.range_rules(B.CLINICAL_RANGES, "error", _SCORED_COLS))
_LOGIT = "(" * len(FLAGSHIP_COEF) + _d(FLAGSHIP_INTERCEPT) + "".join(
    f" + {_d(w)} * {_d(c)})" for c, w in FLAGSHIP_COEF.items())

_FLAGSHIP_SQL = f"""
WITH v AS (SELECT * FROM scored_v WHERE {_VALID}),
m AS (SELECT quantile_cont(glucose, 0.5) AS mg, quantile_cont(blood_pressure, 0.5) AS mb FROM v),
i AS (SELECT v.age, v.y_true, v.bmi, coalesce(v.glucose, m.mg) AS glucose, coalesce(v.blood_pressure, m.mb) AS blood_pressure FROM v, m),
f AS (SELECT *, CAST(coalesce(blood_pressure > 80, false) AS INTEGER) AS bp_risk FROM i),
s AS (SELECT *, 1.0 / (1.0 + exp(-{_LOGIT})) AS probability FROM f),
t AS (SELECT *, probability * 100 AS risk_score, {_band('age', *AGE_BAND_EDGES)} AS age_band,
             CAST(probability > 0.5 AS INTEGER) AS y_hat FROM s)
SELECT age_band, tn, fp, fn, tp, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision, n, mean_risk, n_high_risk
FROM (SELECT age_band, count_if(y_true = 0 AND y_hat = 0) AS tn, count_if(y_true = 0 AND y_hat = 1) AS fp,
             count_if(y_true = 1 AND y_hat = 0) AS fn, count_if(y_true = 1 AND y_hat = 1) AS tp, count(*) AS n,
             avg(risk_score) AS mean_risk, count_if(risk_score >= 60) AS n_high_risk
      FROM t GROUP BY age_band) g"""


@register("flagship_scoring", dbl=["recall", "precision", "mean_risk"], sql=_FLAGSHIP_SQL)
def q_flagship(spark, sf):
    return flagship(spark, sf)


_RISK = "CASE WHEN y_prob * 100 < 30 THEN 'Low Risk' WHEN y_prob * 100 < 60 THEN 'Moderate Risk' ELSE 'High Risk' END"
_CONF = "least(abs(y_prob - 0.5) * 2, 0.99)"


@register("classify_risk", dbl=["confidence"], sql=f"""
SELECT patient_id, {_RISK} AS risk_level, {_CONF} AS confidence FROM scored_v""")
def q_classify_risk(spark, sf):
    s = scored(spark, sf)
    return s.select("patient_id", G.classify_risk(F.col("y_prob") * 100).alias("risk_level"),
                    G.confidence_score(F.col("y_prob")).alias("confidence"))


_CL = """CASE WHEN y_prob >= 0.8 THEN 'High Confidence' WHEN y_prob >= 0.6 THEN 'Moderate Confidence'
              WHEN y_prob >= 0.4 THEN 'Low Confidence' ELSE 'Inconclusive' END"""


@register("confidence_level", sql=f"""
SELECT {_CL} AS level, y_prob >= 0.8 IS FALSE AS requires_review,
       CASE WHEN y_prob >= 0.8 THEN 'APPROVE' WHEN y_prob >= 0.6 THEN 'REVIEW' WHEN y_prob >= 0.4 THEN 'REVIEW_URGENT' ELSE 'REJECT' END AS action,
       CASE WHEN y_prob >= 0.8 THEN 'LOW' WHEN y_prob >= 0.6 THEN 'MEDIUM' WHEN y_prob >= 0.4 THEN 'HIGH' ELSE 'CRITICAL' END AS priority,
       count(*) AS n
FROM scored_v GROUP BY 1, 2, 3, 4""")
def q_confidence_level(spark, sf):
    s = scored(spark, sf).select(G.confidence_level(F.col("y_prob")).alias("c"))
    return s.groupBy(F.col("c.level").alias("level"), F.col("c.requires_review").alias("requires_review"),
                     F.col("c.action").alias("action"), F.col("c.priority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"))


@register("clinical_decision", sql=f"""
SELECT patient_id,
  CASE WHEN y_prob >= 0.7 THEN 'HIGH RISK' WHEN y_prob >= 0.4 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS risk_status,
  CASE WHEN y_prob > 0.5 THEN 'Disease Present' ELSE 'No Disease' END AS prediction,
  {_CL} AS confidence, y_prob < 0.8 AS requires_human_review,
  len(CASE WHEN y_prob >= 0.7 THEN ['a','b','c'] WHEN y_prob >= 0.4 THEN ['a','b','c'] ELSE ['a','b','c'] END)
    + CASE WHEN y_prob < 0.8 THEN 1 ELSE 0 END AS n_actions
FROM scored_v""")
def q_clinical_decision(spark, sf):
    s = G.clinical_decision(scored(spark, sf).select("patient_id", F.col("y_prob").alias("probability")))
    return s.select("patient_id", "risk_status", "prediction", "confidence", "requires_human_review",
                    F.size("actions").cast("bigint").alias("n_actions"))


_FB_FIELDS = ["glucose", "bmi", "age", "blood_pressure", "pregnancies", "diabetes_pedigree"]


def _fallback_sql(src):
    terms = [("glucose", "glucose", 126, 3), ("bmi", "bmi", 30, 2), ("age", "age", 45, 1),
             ("blood_pressure", "blood_pressure", 80, 1), ("pregnancies", "pregnancies", 5, 1),
             ("family_history", "diabetes_pedigree", 0.5, 2)]
    total = " + ".join(f"CASE WHEN coalesce(CAST({src_c} AS DOUBLE) >= {_d(t)}, false) THEN {w} ELSE 0 END"
                       for f, src_c, t, w in terms)
    return total


@register("fallback_score", dbl=["risk_score", "confidence"], sql=f"""
WITH d AS (SELECT patient_id, coalesce(glucose, 100) AS glucose, coalesce(bmi, 25) AS bmi, coalesce(age, 50) AS age,
                  coalesce(blood_pressure, 75) AS blood_pressure, coalesce(pregnancies, 0) AS pregnancies, diabetes_pedigree
           FROM patients_v),
t AS (SELECT patient_id, CAST({_fallback_sql('d')} AS INTEGER) AS total_score FROM d)
SELECT patient_id, total_score,
       CASE WHEN total_score >= 7 THEN 'High Risk' WHEN total_score >= 4 THEN 'Moderate Risk' ELSE 'Low Risk' END AS risk_level,
       CAST(least(100, 30 + total_score * 10) AS DOUBLE) AS risk_score, CAST(0.8 AS DOUBLE) AS confidence FROM t""")
def q_fallback_score(spark, sf):
    p = G.safe_defaults(patients(spark, sf).select("patient_id", *_FB_FIELDS))
    return G.fallback_score(p).select("patient_id", "total_score", "risk_level", "risk_score", "confidence")


@register("safe_defaults", dbl=["glucose", "blood_pressure"], sql="""
SELECT patient_id, coalesce(glucose, 100) AS glucose, coalesce(blood_pressure, 75) AS blood_pressure FROM patients_v""")
def q_safe_defaults(spark, sf):
    p = patients(spark, sf).select("patient_id", "glucose", "blood_pressure")
    return G.safe_defaults(p)


@register("conservative_bump", dbl=["risk_score"], sql=f"""
WITH d AS (SELECT patient_id, coalesce(glucose, 100) AS glucose, coalesce(bmi, 25) AS bmi, coalesce(age, 50) AS age,
                  coalesce(blood_pressure, 75) AS blood_pressure, coalesce(pregnancies, 0) AS pregnancies, diabetes_pedigree
           FROM patients_v),
t AS (SELECT patient_id, CAST({_fallback_sql('d')} AS INTEGER) AS total_score FROM d)
SELECT patient_id, least(100.0, CAST(least(100, 30 + total_score * 10) AS DOUBLE) + 15.0) AS risk_score,
       CASE WHEN total_score >= 4 THEN 'High Risk' ELSE 'Moderate Risk' END AS risk_level FROM t""")
def q_conservative_bump(spark, sf):
    p = G.safe_defaults(patients(spark, sf).select("patient_id", *_FB_FIELDS))
    return G.conservative_bump(G.fallback_score(p)).select("patient_id", "risk_score", "risk_level")


@register("apply_overrides", dbl=["risk_score", "confidence"], sql="""
WITH s AS (SELECT k, y_prob * 100 AS risk_score, 'model' AS risk_level, abs(y_prob - 0.5) * 2 AS confidence FROM scored_v),
o AS (SELECT o_orderkey AS k, CAST(o_totalprice / 1000 AS DOUBLE) AS risk_score, 'Manual' AS risk_level FROM orders WHERE o_orderkey % 9 = 0)
SELECT s.k, o.risk_score IS NOT NULL AND o.risk_level IS NOT NULL AS overridden,
       CASE WHEN o.risk_score IS NOT NULL AND o.risk_level IS NOT NULL THEN least(100.0, greatest(0.0, o.risk_score)) ELSE s.risk_score END AS risk_score,
       CASE WHEN o.risk_score IS NOT NULL AND o.risk_level IS NOT NULL THEN o.risk_level ELSE s.risk_level END AS risk_level,
       CASE WHEN o.risk_score IS NOT NULL AND o.risk_level IS NOT NULL THEN 0.9 ELSE s.confidence END AS confidence
FROM s LEFT JOIN o ON s.k = o.k""")
def q_apply_overrides(spark, sf):
    from sparkclin.sources.io import table
    s = scored(spark, sf).select("k", (F.col("y_prob") * 100).alias("risk_score"), F.lit("model").alias("risk_level"),
                                 (F.abs(F.col("y_prob") - 0.5) * 2).alias("confidence"))
    o = table(spark, sf, "orders").where("o_orderkey % 9 = 0").select(
        F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("risk_score"), F.lit("Manual").alias("risk_level"))
    return G.apply_overrides(s, o, "k").select("k", "overridden", "risk_score", "risk_level", "confidence")


@register("detect_dataset_type", sql="""
SELECT CASE WHEN 0 > (CAST(glucose IS NOT NULL AS INTEGER) + CAST(bmi IS NOT NULL AS INTEGER) + CAST(pregnancies IS NOT NULL AS INTEGER)
        + CAST(insulin IS NOT NULL AS INTEGER) + CAST(diabetes_pedigree IS NOT NULL AS INTEGER)) THEN 'heart_disease' ELSE 'diabetes' END AS dataset_type,
       count(*) AS n FROM patients_v GROUP BY 1""")
def q_detect_dataset_type(spark, sf):
    p = patients(spark, sf)
    return p.groupBy(G.detect_dataset_type(p).alias("dataset_type")).agg(F.count(F.lit(1)).alias("n"))


_TRIG_LIST = ["CAST(k % 50 <> 0 AS BOOLEAN) AS model_available", "k % 70 = 1 AS timeout", "glucose IS NULL AS invalid_input",
              "least(abs(y_prob - 0.5) * 2, 0.99) AS conf", "k % 90 = 2 AS breaker"]
_TRIG_COLS = ", ".join(_TRIG_LIST)


@register("fallback_trigger", sql=f"""
SELECT reason, reason <> 'normal_operation' AS flag, count(*) AS n FROM (
  SELECT CASE WHEN model_available = false THEN 'model_unavailable' WHEN coalesce(timeout, false) THEN 'model_timeout'
              WHEN coalesce(invalid_input, false) THEN 'invalid_input' WHEN coalesce(conf, 1.0) < 0.5 THEN 'high_uncertainty'
              WHEN coalesce(breaker, false) THEN 'circuit_breaker_open' ELSE 'normal_operation' END AS reason
  FROM (SELECT {_TRIG_COLS} FROM scored_v) c) t GROUP BY reason""")
def q_fallback_trigger(spark, sf):
    c = scored(spark, sf).selectExpr(*_TRIG_LIST)
    t = c.select(G.fallback_trigger(F.col("model_available"), F.col("timeout"), F.col("invalid_input"),
                                    F.col("conf"), F.col("breaker")).alias("t"))
    return t.groupBy(F.col("t.reason").alias("reason"), F.col("t.flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@register("fallback_stats", dbl=["fallback_rate"], sql=f"""
WITH r AS (SELECT CASE WHEN model_available = false THEN 'model_unavailable' WHEN coalesce(timeout, false) THEN 'model_timeout'
              WHEN coalesce(invalid_input, false) THEN 'invalid_input' WHEN coalesce(conf, 1.0) < 0.5 THEN 'high_uncertainty'
              WHEN coalesce(breaker, false) THEN 'circuit_breaker_open' ELSE 'normal_operation' END AS reason
           FROM (SELECT {_TRIG_COLS} FROM scored_v) c),
f AS (SELECT reason, reason <> 'normal_operation' AS fallback FROM r),
tot AS (SELECT count(*) AS total, count_if(fallback) AS n_fallback FROM f)
SELECT b.reason, b.n, tot.total, tot.n_fallback, CAST(tot.n_fallback AS DOUBLE) / tot.total AS fallback_rate,
       CAST(tot.n_fallback AS DOUBLE) / tot.total > 0.1 AS alert
FROM (SELECT reason, count(*) AS n FROM f WHERE fallback GROUP BY reason) b, tot""")
def q_fallback_stats(spark, sf):
    c = scored(spark, sf).selectExpr(*_TRIG_LIST)
    t = c.select(G.fallback_trigger(F.col("model_available"), F.col("timeout"), F.col("invalid_input"),
                                    F.col("conf"), F.col("breaker")).alias("t"))
    f = t.select(F.col("t.reason").alias("reason"), F.col("t.flag").alias("fallback"))
    return G.fallback_stats(f)


_STATUS = "CASE WHEN y_prob >= 0.7 THEN 'HIGH RISK' WHEN y_prob >= 0.4 THEN 'MODERATE RISK' ELSE 'LOW RISK' END"


@register("needs_review", sql=f"""
SELECT needs, priority, count(*) AS n FROM (
  SELECT coalesce(({_CL}) = 'Low Confidence', false) OR y_prob < 0.3 OR ({_STATUS}) = 'HIGH RISK' OR k % 50 = 0 AS needs,
         CASE WHEN ({_STATUS}) = 'HIGH RISK' AND ({_CL}) = 'Low Confidence' THEN 'CRITICAL'
              WHEN ({_STATUS}) = 'HIGH RISK' THEN 'HIGH'
              WHEN ({_CL}) = 'Low Confidence' AND ({_STATUS}) <> 'LOW RISK' THEN 'MEDIUM' ELSE 'LOW' END AS priority
  FROM scored_v) t GROUP BY needs, priority""")
def q_needs_review(spark, sf):
    s = scored(spark, sf)
    d = G.clinical_decision(s.select("k", F.col("y_prob").alias("probability")))
    r = d.select(G.needs_review(F.col("confidence"), F.col("probability"), F.col("risk_status"),
                                F.col("k") % 50 == 0).alias("needs"),
                 G.review_priority(F.col("risk_status"), F.col("confidence")).alias("priority"))
    return r.groupBy("needs", "priority").agg(F.count(F.lit(1)).alias("n"))


_PRIO = "CASE priority_code WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END"


def _reviews_with_priority(spark, sf):
    return reviews(spark, sf).withColumn("priority", F.expr(_PRIO))


@register("pending_reviews", sql=f"""
SELECT review_id, priority, CAST(CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END AS INTEGER) AS priority_rank
FROM (SELECT *, {_PRIO} AS priority FROM reviews_v) r WHERE status = 'pending'""")
def q_pending_reviews(spark, sf):
    return G.pending_reviews(_reviews_with_priority(spark, sf)).select("review_id", "priority", "priority_rank")


@register("apply_reviews", sql=f"""
WITH r AS (SELECT *, {_PRIO} AS priority FROM reviews_v),
v AS (SELECT review_id, 'dr_' || CAST(review_id % 7 AS VARCHAR) AS reviewer, review_id % 3 <> 0 AS approved, created_at AS reviewed_at
      FROM reviews_v WHERE review_id % 8 IN (0, 1))
SELECT status, reviewer IS NOT NULL AS has_reviewer, count(*) AS n FROM (
  SELECT CASE WHEN r.status = 'pending' AND v.approved IS NOT NULL THEN CASE WHEN v.approved THEN 'approved' ELSE 'rejected' END ELSE r.status END AS status,
         CASE WHEN r.status = 'pending' AND v.approved IS NOT NULL THEN v.reviewer END AS reviewer
  FROM r LEFT JOIN v USING (review_id)) t GROUP BY 1, 2""")
def q_apply_reviews(spark, sf):
    r = _reviews_with_priority(spark, sf)
    v = reviews(spark, sf).where("review_id % 8 IN (0, 1)").select(
        "review_id", F.concat(F.lit("dr_"), (F.col("review_id") % 7).cast("string")).alias("reviewer"),
        (F.col("review_id") % 3 != 0).alias("approved"), F.col("created_at").alias("reviewed_at"))
    a = G.apply_reviews(r, v)
    return a.groupBy("status", F.col("reviewer").isNotNull().alias("has_reviewer")).agg(F.count(F.lit(1)).alias("n"))


@register("review_stats", dbl=["approval_rate", "avg_review_minutes"], sql=f"""
WITH r AS (SELECT *, {_PRIO} AS priority FROM reviews_v),
d AS (SELECT map_from_entries(list((priority, n) ORDER BY priority)) AS priority_distribution
      FROM (SELECT priority, count(*) AS n FROM r WHERE status IN ('approved', 'rejected') GROUP BY priority) x)
SELECT count(*) AS total_reviews, count_if(status = 'pending') AS pending_count,
       count_if(status IN ('approved', 'rejected')) AS reviewed_count,
       count_if(status = 'approved') * 100.0 / count_if(status IN ('approved', 'rejected')) AS approval_rate,
       avg(CASE WHEN status IN ('approved', 'rejected') THEN CAST(review_minutes AS DOUBLE) END) AS avg_review_minutes,
       any_value(d.priority_distribution) AS priority_distribution
FROM r, d""")
def q_review_stats(spark, sf):
    return G.review_stats(_reviews_with_priority(spark, sf))


@register("review_tickets", sql="""
SELECT 'REV_' || CAST(k AS VARCHAR) AS ticket_id, k,
       CASE WHEN y_prob >= 0.6 THEN 'REVIEW' WHEN y_prob >= 0.4 THEN 'REVIEW_URGENT' ELSE 'REJECT' END AS action,
       CASE WHEN y_prob >= 0.6 THEN 'MEDIUM' WHEN y_prob >= 0.4 THEN 'HIGH' ELSE 'CRITICAL' END AS priority
FROM scored_v WHERE y_prob < 0.8""")
def q_review_tickets(spark, sf):
    s = scored(spark, sf).select("k", F.col("y_prob").alias("probability"))
    return G.review_tickets(s, "k").select("ticket_id", "k", "action", "priority")


@register("patient_report", dbl=["risk_score"], sql="""
SELECT patient_id, y_prob * 100 AS risk_score, lvl AS risk_level,
       CASE WHEN y_prob * 100 < 30 THEN 'Low risk. Continue preventive care and routine monitoring.'
            WHEN y_prob * 100 < 60 THEN 'Moderate risk. Consider additional screening and lifestyle modifications.'
            ELSE 'High risk. Immediate clinical intervention recommended.' END AS interpretation,
       CASE WHEN lvl = 'High Risk' THEN 'Follow up within 1 week' WHEN lvl = 'Low Risk' THEN 'Follow up in 6 months'
            ELSE 'Follow up within 4 weeks' END AS follow_up,
       CASE WHEN lvl = 'High Risk' THEN 'Urgent' WHEN lvl = 'Low Risk' THEN 'Routine' ELSE 'High' END AS priority,
       CAST(CASE WHEN lvl = 'High Risk' THEN 5 WHEN lvl = 'Moderate Risk' THEN 4 ELSE 4 END AS INTEGER) AS n_materials,
       CAST(7 AS INTEGER) AS n_monitoring
FROM (SELECT *, CASE WHEN k % 11 = 0 THEN 'Unknown' WHEN y_prob * 100 < 30 THEN 'Low Risk' WHEN y_prob * 100 < 60 THEN 'Moderate Risk'
                     ELSE 'High Risk' END AS lvl FROM scored_v) t""")
def q_patient_report(spark, sf):
    s = scored(spark, sf).select("patient_id", (F.col("y_prob") * 100).alias("risk_score"), F.expr(
        "CASE WHEN k % 11 = 0 THEN 'Unknown' WHEN y_prob * 100 < 30 THEN 'Low Risk' WHEN y_prob * 100 < 60 THEN 'Moderate Risk' "
        "ELSE 'High Risk' END").alias("risk_level"))
    r = G.patient_report(s)
    return r.select("patient_id", "risk_score", "risk_level", "interpretation", "follow_up", "priority",
                    F.size("educational_materials").alias("n_materials"), F.size("monitoring_plan").alias("n_monitoring"))


_COND = ("CASE WHEN glucose >= 126 THEN 'Diabetes' WHEN blood_pressure >= 90 THEN 'HYPERTENSION' "
         "WHEN age > 60 THEN 'heart_disease' ELSE 'none' END")


def _guide_values():
    rows = []
    for cond, crit, prim, alts, mon, life, ref in G.GUIDELINES:
        rows.append(f"('{cond}', '{prim}', {alts!r}, {life!r}, {ref!r}, {len(crit)}, {len(mon)})".replace('"', "'"))
    return ", ".join(rows)


@register("guideline_lookup", sql=f"""
WITH g AS (SELECT * FROM (VALUES {_guide_values()}) v(condition, primary_treatment, alternative_treatments, lifestyle,
                                                    referral_criteria, n_criteria, n_monitoring))
SELECT p.patient_id, p.condition, g.primary_treatment, g.alternative_treatments, g.lifestyle, g.referral_criteria,
       CAST(g.n_criteria AS INTEGER) AS n_criteria, CAST(g.n_monitoring AS INTEGER) AS n_monitoring
FROM (SELECT patient_id, {_COND} AS condition FROM patients_v) p LEFT JOIN g ON lower(p.condition) = g.condition""")
def q_guideline_lookup(spark, sf):
    p = patients(spark, sf).select("patient_id", F.expr(_COND).alias("condition"))
    r = G.guideline_lookup(p, "condition", G.guideline_table(spark))
    return r.select("patient_id", "condition", "primary_treatment", "alternative_treatments", "lifestyle",
                    "referral_criteria", F.size("diagnostic_criteria").alias("n_criteria"),
                    F.size("monitoring").alias("n_monitoring")).withColumn(
        "n_criteria", F.when(F.col("primary_treatment").isNull(), None).otherwise(F.col("n_criteria"))).withColumn(
        "n_monitoring", F.when(F.col("primary_treatment").isNull(), None).otherwise(F.col("n_monitoring")))


_MEDS = [("metformin", "glucose > 126"), ("insulin", "glucose > 170"), ("aspirin", "age > 60"),
         ("warfarin", "k % 13 = 0"), ("ibuprofen", "bmi > 35"), ("lisinopril", "blood_pressure > 90"),
         ("spironolactone", "blood_pressure > 110"), ("potassium_supplements", "k % 7 = 0"),
         ("captopril", "k % 17 = 0"), ("furosemide", "blood_pressure > 120")]
_DRUGS_SQL = ", ".join(f"CASE WHEN {c} THEN '{d}' END" for d, c in _MEDS)
_PAIRS_SQL = ", ".join(f"('{a}', '{b}', '{s}', '{m}', '{g}')" for a, b, s, m, g in G.INTERACTIONS)


@register("interaction_pairs", sql=f"""
WITH l AS (SELECT patient_id, [{_DRUGS_SQL}] AS drugs FROM patients_v),
t AS (SELECT * FROM (VALUES {_PAIRS_SQL}) v(a, b, severity, mechanism, management)),
p AS (SELECT least(a, b) AS drug, greatest(a, b) AS other, severity, mechanism, management FROM t)
SELECT l.patient_id, p.drug AS drug_a, p.other AS drug_b, p.severity, p.mechanism, p.management
FROM l JOIN p ON list_contains(l.drugs, p.drug) AND list_contains(l.drugs, p.other)""")
def q_interaction_pairs(spark, sf):
    p = patients(spark, sf)
    meds = p.select("patient_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(d)) for d, c in _MEDS])))
                    .alias("drug"))
    return G.interaction_pairs(meds, G.interaction_table(spark))
