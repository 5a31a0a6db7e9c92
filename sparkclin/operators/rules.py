"""G: risk rules, fallback scoring, decisions and review queues.

The rule documents are small fixed tables; they are compiled into column
expressions (one projection, no shuffle) rather than joined row by row, so
scoring a table is a map-only stage whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import ordinal

# Fixed values that must equal the reference's fallback rule file:
# (factor, threshold, weight) per disease, and the score thresholds of each level in order.
DIABETES_FACTORS = [("glucose", 126, 3), ("bmi", 30, 2), ("age", 45, 1), ("blood_pressure", 80, 1),
                    ("pregnancies", 5, 1), ("family_history", 0.5, 2)]
DIABETES_LEVELS = [("High Risk", 7), ("Moderate Risk", 4), ("Low Risk", 0)]
HEART_FACTORS = [("age", 55, 2), ("cholesterol", 240, 2), ("blood_pressure_systolic", 140, 2),
                 ("blood_pressure_diastolic", 90, 1), ("smoking", 1, 2), ("diabetes", 1, 2),
                 ("family_history", 1, 1), ("obesity", 30, 1)]
HEART_LEVELS = [("High Risk", 8), ("Moderate Risk", 4), ("Low Risk", 0)]
# Data field → rule factor name.
FACTOR_ALIASES = {"diabetes_pedigree": "family_history", "chol": "cholesterol",
                  "trestbps": "blood_pressure_systolic"}
# Safe defaults for missing inputs.
SAFE_DEFAULTS = {"glucose": 100, "bmi": 25, "age": 50, "blood_pressure": 75, "cholesterol": 200,
                 "pregnancies": 0, "insulin": 50, "skin_thickness": 25}
LEVEL_BUMP = {"Low Risk": "Moderate Risk", "Moderate Risk": "High Risk", "High Risk": "High Risk"}
DIABETES_FIELDS = ["glucose", "bmi", "pregnancies", "insulin", "diabetes_pedigree"]
HEART_FIELDS = ["chol", "trestbps", "thalach", "exang", "oldpeak"]


def classify_risk(score: Column) -> Column:
    """G1: <30 Low, <60 Moderate, else High."""
    return F.when(score < 30, "Low Risk").when(score < 60, "Moderate Risk").otherwise("High Risk")


def confidence_score(p: Column) -> Column:
    """min(|p − 0.5|·2, 0.99)."""
    return F.least(F.abs(p - 0.5) * 2, F.lit(0.99))


def confidence_level(p: Column, high: float = 0.8, moderate: float = 0.6, low: float = 0.4) -> Column:
    """struct(level, requires_review, action, message, priority) from the probability."""
    def arm(level, review, action, msg, prio):
        return F.struct(F.lit(level).alias("level"), F.lit(review).alias("requires_review"),
                        F.lit(action).alias("action"), F.lit(msg).alias("message"), F.lit(prio).alias("priority"))
    return (F.when(p >= high, arm("High Confidence", False, "APPROVE", "High confidence prediction - safe to act", "LOW"))
            .when(p >= moderate, arm("Moderate Confidence", True, "REVIEW",
                                     "Moderate confidence - physician review recommended", "MEDIUM"))
            .when(p >= low, arm("Low Confidence", True, "REVIEW_URGENT",
                                "Low confidence - immediate physician review required", "HIGH"))
            .otherwise(arm("Inconclusive", True, "REJECT", "Inconclusive - cannot make clinical decision", "CRITICAL")))


def clinical_decision(df: DataFrame, prob: str = "probability", high: float = 0.7, moderate: float = 0.4) -> DataFrame:
    """Risk status, recommendation, actions (review action appended), prediction at 0.5."""
    p = F.col(prob)
    cl = confidence_level(p)
    status = F.when(p >= high, "HIGH RISK").when(p >= moderate, "MODERATE RISK").otherwise("LOW RISK")
    rec = (F.when(p >= high, "URGENT: Immediate clinical evaluation required")
           .when(p >= moderate, "Clinical evaluation recommended").otherwise("Continue routine monitoring"))
    acts = (F.when(p >= high, F.array(*[F.lit(x) for x in ["Immediate clinical assessment", "Confirm with additional tests",
                                                          "Consider specialist consultation"]]))
            .when(p >= moderate, F.array(*[F.lit(x) for x in ["Schedule clinical assessment", "Review risk factors",
                                                              "Consider preventive interventions"]]))
            .otherwise(F.array(*[F.lit(x) for x in ["Continue preventive monitoring", "Maintain healthy lifestyle",
                                                    "Schedule routine follow-up"]])))
    acts = F.when(cl["requires_review"], F.array_append(acts, F.lit("Human review recommended"))).otherwise(acts)
    return df.select("*", status.alias("risk_status"), rec.alias("recommendation"), acts.alias("actions"),
                     F.when(p > 0.5, "Disease Present").otherwise("No Disease").alias("prediction"),
                     cl["level"].alias("confidence"), cl["requires_review"].alias("requires_human_review"))


def safe_defaults(df: DataFrame, defaults: dict = SAFE_DEFAULTS) -> DataFrame:
    """Fill missing inputs with the safe defaults (only columns that exist)."""
    return df.fillna({k: v for k, v in defaults.items() if k in df.columns})


def fallback_score(df: DataFrame, disease: str = "diabetes", aliases: dict = FACTOR_ALIASES) -> DataFrame:
    """Weighted rule score over the rule factors present in the data.

    total = Σ weight where value ≥ threshold; level = first level (in order)
    whose score threshold the total reaches; risk_score = min(100, 30 + 10·total);
    confidence = min(0.9, 0.5 + n_factors/20); factor details as an array of structs.
    """
    factors, levels = (DIABETES_FACTORS, DIABETES_LEVELS) if disease == "diabetes" else (HEART_FACTORS, HEART_LEVELS)
    by_factor = {f: f for f in df.columns}
    by_factor.update({a: src for src, a in aliases.items() if src in df.columns})
    present = [(f, t, w, by_factor[f]) for f, t, w in factors if f in by_factor]
    elevated = [F.coalesce(F.col(src).cast("double") >= F.lit(float(t)), F.lit(False)) for f, t, w, src in present]
    total = sum((F.when(e, F.lit(w)).otherwise(0) for e, (f, t, w, src) in zip(elevated, present)), F.lit(0))
    details = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(src).cast("double").alias("value"),
                                 F.lit(float(t)).alias("threshold"), F.lit(w).alias("weight"),
                                 F.when(e, "elevated").otherwise("normal").alias("status"))
                        for e, (f, t, w, src) in zip(elevated, present)])
    level = None
    for name, thr in levels:
        level = F.when(F.col("total_score") >= thr, name) if level is None else level.when(F.col("total_score") >= thr, name)
    level = level.otherwise("Low Risk")
    out = df.withColumn("total_score", total.cast("int"))
    return out.select("*", level.alias("risk_level"),
                      F.least(F.lit(100), 30 + F.col("total_score") * 10).cast("double").alias("risk_score"),
                      F.lit(min(0.9, 0.5 + len(present) / 20)).alias("confidence"), details.alias("factor_details"))


def conservative_bump(df: DataFrame, bump: float = 15.0) -> DataFrame:
    """+15 (max 100) and one level up."""
    m = F.create_map(*[F.lit(x) for kv in LEVEL_BUMP.items() for x in kv])
    return (df.withColumn("risk_score", F.least(F.lit(100.0), F.col("risk_score") + bump))
            .withColumn("risk_level", F.coalesce(m[F.col("risk_level")], F.col("risk_level"))))


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A manual (score, level) replaces the rule result, score clamped 0–100, confidence 0.9."""
    o = overrides.select(key, F.col("risk_score").alias("__os"), F.col("risk_level").alias("__ol"))
    j = df.join(o, key, "left")
    has = F.col("__os").isNotNull() & F.col("__ol").isNotNull()
    return (j.withColumn("overridden", has)
            .withColumn("risk_score", F.when(has, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("__os").cast("double"))))
                        .otherwise(F.col("risk_score")))
            .withColumn("risk_level", F.when(has, F.col("__ol")).otherwise(F.col("risk_level")))
            .withColumn("confidence", F.when(has, F.lit(0.9)).otherwise(F.col("confidence")))
            .drop("__os", "__ol"))


def detect_dataset_type(df: DataFrame) -> Column:
    """Diabetes when at least as many diabetes fields as heart fields are non-null."""
    def cnt(fields):
        return sum((F.col(f).isNotNull().cast("int") for f in fields if f in df.columns), F.lit(0))
    return F.when(cnt(HEART_FIELDS) > cnt(DIABETES_FIELDS), "heart_disease").otherwise("diabetes")


def fallback_trigger(model_available: Column, timeout: Column, invalid_input: Column, confidence: Column,
                     breaker_open: Column, confidence_threshold: float = 0.5) -> Column:
    """struct(flag, reason) for the first firing trigger in order."""
    reason = (F.when(model_available == F.lit(False), "model_unavailable")
              .when(F.coalesce(timeout, F.lit(False)), "model_timeout")
              .when(F.coalesce(invalid_input, F.lit(False)), "invalid_input")
              .when(F.coalesce(confidence, F.lit(1.0)) < confidence_threshold, "high_uncertainty")
              .when(F.coalesce(breaker_open, F.lit(False)), "circuit_breaker_open")
              .otherwise("normal_operation"))
    return F.struct((reason != "normal_operation").alias("flag"), reason.alias("reason"))


def fallback_stats(df: DataFrame, flag: str = "fallback", reason: str = "reason", alert_rate: float = 0.1) -> DataFrame:
    """Per reason counts and the overall fallback rate with its alert flag."""
    by = df.where(F.col(flag)).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("n_fallback"))
    rate = tot.select("*", (F.col("n_fallback") / F.col("total")).alias("fallback_rate"),
                      (F.col("n_fallback") / F.col("total") > alert_rate).alias("alert"))
    return by.crossJoin(F.broadcast(rate))


# ------------------------------------------------------------------ review
PRIORITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def needs_review(confidence: Column, probability: Column, risk_status: Column, fallback: Column,
                 low_threshold: float = 0.3) -> Column:
    """Low confidence, probability below 0.3, high risk, or a fallback result."""
    return ((F.coalesce(confidence == "Low Confidence", F.lit(False)))
            | (F.coalesce(probability, F.lit(0.0)) < low_threshold)
            | F.coalesce(risk_status == "HIGH RISK", F.lit(False))
            | F.coalesce(fallback, F.lit(False)))


def review_priority(risk_status: Column, confidence: Column) -> Column:
    """CRITICAL / HIGH / MEDIUM / LOW from risk status and confidence label."""
    hi = F.coalesce(risk_status, F.lit("LOW RISK")) == "HIGH RISK"
    low_conf = F.coalesce(confidence, F.lit("High Confidence")) == "Low Confidence"
    return (F.when(hi & low_conf, "CRITICAL").when(hi, "HIGH")
            .when(low_conf & (F.coalesce(risk_status, F.lit("LOW RISK")) != "LOW RISK"), "MEDIUM").otherwise("LOW"))


def pending_reviews(reviews: DataFrame, priority: str | None = None, priority_col: str = "priority",
                    id_col: str = "review_id") -> DataFrame:
    """Pending items, optionally one priority, ordered CRITICAL → LOW (id breaks ties)."""
    p = reviews.where(F.col("status") == "pending")
    if priority:
        p = p.where(F.col(priority_col) == priority)
    rank = F.coalesce(ordinal(F.col(priority_col), PRIORITY_ORDER), F.lit(99))
    return p.withColumn("priority_rank", rank).orderBy("priority_rank", id_col)


def apply_reviews(reviews: DataFrame, verdicts: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Verdicts (id, reviewer, approved, reviewed_at) applied to pending items only."""
    v = verdicts.select(id_col, F.col("reviewer").alias("__r"), F.col("approved").alias("__a"),
                        F.col("reviewed_at").alias("__t"))
    j = reviews.join(v, id_col, "left").withColumn(
        "__hit", (F.col("status") == "pending") & F.col("__a").isNotNull())
    hit = F.col("__hit")
    return (j.withColumn("status", F.when(hit, F.when(F.col("__a"), "approved").otherwise("rejected"))
                         .otherwise(F.col("status")))
            .withColumn("reviewer", F.when(hit, F.col("__r")))
            .withColumn("reviewed_at", F.when(hit, F.col("__t")))
            .drop("__r", "__a", "__t", "__hit"))


def review_stats(reviews: DataFrame, minutes_col: str = "review_minutes", priority_col: str = "priority") -> DataFrame:
    """Totals, pending, reviewed, approval %, mean minutes to review, priority distribution."""
    done = F.col("status").isin("approved", "rejected")
    dist = (reviews.where(done).groupBy(priority_col).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(priority_col), F.col("n")))))
                 .alias("priority_distribution")))
    s = reviews.agg(F.count(F.lit(1)).alias("total_reviews"), F.count_if(F.col("status") == "pending").alias("pending_count"),
                    F.count_if(done).alias("reviewed_count"),
                    (F.count_if(F.col("status") == "approved") * 100.0 / F.count_if(done)).alias("approval_rate"),
                    F.avg(F.when(done, F.col(minutes_col).cast("double"))).alias("avg_review_minutes"))
    return s.crossJoin(dist)


def review_tickets(df: DataFrame, id_col: str, prob: str = "probability") -> DataFrame:
    """One ticket per row needing review: id, action, priority, message."""
    cl = confidence_level(F.col(prob))
    return (df.where(cl["requires_review"])
            .select(F.concat(F.lit("REV_"), F.col(id_col).cast("string")).alias("ticket_id"), id_col,
                    cl["action"].alias("action"), cl["priority"].alias("priority"), cl["message"].alias("message"),
                    F.lit("pending").alias("status")))


# ------------------------------------------------------------------ G20 patient report
# Fixed values that must equal the reference: guideline recommendations, follow-up and priority per
# (disease, risk key); monitoring plans and educational materials per risk level.
REPORT_GUIDELINES = {
    ("diabetes", "high_risk"): (["Immediate clinical evaluation recommended", "Perform fasting glucose test and HbA1c",
                                 "Consult with endocrinologist", "Start diabetes education program",
                                 "Lifestyle modification: diet and exercise"], "Follow up within 1 week", "Urgent"),
    ("diabetes", "moderate_risk"): (["Schedule comprehensive metabolic panel", "Review family history",
                                     "Implement dietary changes", "Increase physical activity", "Monitor glucose levels"],
                                    "Follow up within 4 weeks", "High"),
    ("diabetes", "low_risk"): (["Maintain healthy lifestyle", "Regular exercise (30 mins/day)",
                                "Balanced diet with low glycemic index", "Annual screening", "Monitor for symptoms"],
                               "Follow up in 6 months", "Routine"),
    ("heart_disease", "high_risk"): (["Immediate cardiac evaluation", "Stress test and ECG recommended",
                                      "Consult with cardiologist", "Start cardiac medications if indicated",
                                      "Lifestyle: diet, exercise, smoking cessation"], "Follow up within 1 week", "Urgent"),
    ("heart_disease", "moderate_risk"): (["Comprehensive lipid panel", "Review cardiovascular risk factors",
                                          "Dietary consultation", "Exercise stress test", "Monitor blood pressure"],
                                         "Follow up within 4 weeks", "High"),
    ("heart_disease", "low_risk"): (["Maintain cardiovascular health", "Regular exercise (30 mins/day)",
                                     "Heart-healthy diet", "Annual cardiovascular screening", "Monitor for symptoms"],
                                    "Follow up in 6 months", "Routine"),
}
MONITORING_BASE = ["Track vital signs monthly", "Monitor for symptoms", "Maintain medication compliance"]
MONITORING_PLANS = {
    "High Risk": ["Daily blood glucose monitoring", "Weekly blood pressure checks", "Monthly lab work",
                  "Quarterly specialist review"],
    "Moderate Risk": ["Blood glucose monitoring 3x per week", "Bi-weekly blood pressure checks", "Every 3 months lab work",
                      "Semi-annual specialist review"],
    "Low Risk": ["Blood glucose monitoring weekly", "Monthly blood pressure checks", "Every 6 months lab work",
                 "Annual specialist review"],
}
EDUCATION = {
    "High Risk": ["Diabetes: A Comprehensive Guide", "Nutrition for Managing Diabetes", "Exercise Guidelines for Diabetes",
                  "Medication Management Guide", "Emergency Preparedness"],
    "Moderate Risk": ["Understanding Diabetes Risk", "Healthy Eating Guidelines", "Physical Activity Recommendations",
                      "Stress Management"],
    "Low Risk": ["Diabetes Prevention Program", "Nutrition and Wellness Guide", "Exercise for Health", "Healthy Living Tips"],
}


def _arr(xs):
    return F.array(*[F.lit(x) for x in xs])


def patient_report(df: DataFrame, disease: str = "diabetes", score: str = "risk_score", level: str = "risk_level",
                   factors: str | None = None) -> DataFrame:
    """Interpretation, guideline recommendations / follow-up / priority (moderate when the
    level is unknown), monitoring plan, educational materials and the top-5 factors."""
    spark = df.sparkSession
    g = spark.createDataFrame([(d, k, recs, fu, pr) for (d, k), (recs, fu, pr) in REPORT_GUIDELINES.items() if d == disease],
                              "disease string, risk_key string, recommendations array<string>, follow_up string, priority string")
    key = F.regexp_replace(F.lower(F.col(level)), " ", "_")
    known = F.coalesce(key.isin(*[k for (d, k) in REPORT_GUIDELINES if d == disease]), F.lit(False))
    x = df.withColumn("__rk", F.when(known, key).otherwise(F.lit("moderate_risk")))
    j = x.join(F.broadcast(g.drop("disease")), x["__rk"] == g["risk_key"], "left").drop("risk_key", "__rk")
    s = F.col(score)
    interp = (F.when(s < 30, "Low risk. Continue preventive care and routine monitoring.")
              .when(s < 60, "Moderate risk. Consider additional screening and lifestyle modifications.")
              .otherwise("High risk. Immediate clinical intervention recommended."))
    lvl = F.col(level)
    plan = (F.when(lvl == "High Risk", _arr(MONITORING_PLANS["High Risk"] + MONITORING_BASE))
            .when(lvl == "Moderate Risk", _arr(MONITORING_PLANS["Moderate Risk"] + MONITORING_BASE))
            .otherwise(_arr(MONITORING_PLANS["Low Risk"] + MONITORING_BASE)))
    mats = (F.when(lvl == "High Risk", _arr(EDUCATION["High Risk"]))
            .when(lvl == "Moderate Risk", _arr(EDUCATION["Moderate Risk"])).otherwise(_arr(EDUCATION["Low Risk"])))
    out = j.select("*", interp.alias("interpretation"), plan.alias("monitoring_plan"), mats.alias("educational_materials"))
    if factors:
        out = out.withColumn(factors, F.slice(F.col(factors), 1, 5))
    return out


# ------------------------------------------------------------------ G18 / G19 rule documents
# Fixed values that must equal the reference's guideline document (condition → guidance).
GUIDELINES = [
    ("diabetes", {"fasting_glucose": "≥ 126 mg/dL", "hba1c": "≥ 6.5%", "oral_glucose_tolerance": "≥ 200 mg/dL"},
     "Lifestyle modifications and Metformin", ["SGLT2 inhibitors", "GLP-1 agonists", "DPP-4 inhibitors"],
     {"hba1c": "Every 3-6 months", "blood_pressure": "Every visit", "lipid_profile": "Annually"},
     ["Diet: Low glycemic index, portion control", "Exercise: 150 min/week moderate activity",
      "Weight: 5-10% reduction if overweight"],
     ["HbA1c > 9%", "Frequent hypoglycemia", "Complications present"]),
    ("heart_disease", {"ecg": "ST-T wave changes", "stress_test": "Positive for ischemia", "cardiac_enzymes": "Elevated"},
     "Aspirin and Statins", ["Beta-blockers", "ACE inhibitors", "Calcium channel blockers"],
     {"ecg": "As needed", "lipid_profile": "Every 3-6 months", "blood_pressure": "Every visit"},
     ["Diet: Heart-healthy, low sodium", "Exercise: Cardiac rehabilitation", "Smoking cessation"],
     ["Unstable angina", "Heart failure symptoms", "Complex arrhythmias"]),
    ("hypertension", {"systolic": "≥ 140 mmHg", "diastolic": "≥ 90 mmHg"},
     "ACE inhibitors and lifestyle changes", ["ARBs", "Calcium channel blockers", "Diuretics"],
     {"blood_pressure": "Home monitoring daily", "renal_function": "Annually", "electrolytes": "As needed"},
     ["Diet: DASH diet", "Exercise: 150 min/week", "Reduce sodium to < 1500mg/day"],
     ["Resistant hypertension", "Secondary causes", "End-organ damage"]),
]
# Drug interaction document (drug, interacting drug, severity, mechanism, management).
INTERACTIONS = [
    ("metformin", "insulin", "Moderate", "Additive hypoglycemic effect", "Monitor glucose, adjust insulin dose"),
    ("metformin", "captopril", "Minor", "Potential interaction", "No special precautions needed"),
    ("metformin", "furosemide", "Moderate", "Potential interaction", "Monitor for signs of lactic acidosis"),
    ("aspirin", "warfarin", "Major", "Increased bleeding risk", "Monitor INR, consider avoiding combination"),
    ("aspirin", "ibuprofen", "Moderate", "Decreased antiplatelet effect", "Avoid combination if possible"),
    ("lisinopril", "potassium_supplements", "Moderate", "Increased potassium levels", "Monitor potassium levels"),
    ("lisinopril", "spironolactone", "Moderate", "Additive hyperkalemia risk", "Monitor potassium levels closely"),
]


def guideline_table(spark) -> DataFrame:
    """The guideline document as a small table (normally ``load_rule_tables`` on the JSON)."""
    return spark.createDataFrame(GUIDELINES, "condition string, diagnostic_criteria map<string,string>, "
                                             "primary_treatment string, alternative_treatments array<string>, "
                                             "monitoring map<string,string>, lifestyle array<string>, "
                                             "referral_criteria array<string>")


def guideline_lookup(df: DataFrame, condition_col: str, guidelines: DataFrame) -> DataFrame:
    """Case-insensitive condition → criteria, treatment, monitoring, lifestyle, referral
    (unknown conditions keep NULL guidance). The guideline side is a fixed small document."""
    g = guidelines.withColumnRenamed("condition", "__cond")
    return df.join(F.broadcast(g), F.lower(F.col(condition_col)) == F.col("__cond"), "left").drop("__cond")


def interaction_table(spark) -> DataFrame:
    """Both orders of every documented pair, so a lookup by either drug finds it."""
    t = spark.createDataFrame(INTERACTIONS, "drug string, other string, severity string, mechanism string, management string")
    return t.unionByName(t.select(F.col("other").alias("drug"), F.col("drug").alias("other"), "severity", "mechanism",
                                  "management"))


def interaction_pairs(meds: DataFrame, pairs: DataFrame, patient: str = "patient_id", drug: str = "drug") -> DataFrame:
    """Documented interactions among each patient's medications.

    Each medication row is joined to the (broadcast) interaction table on its
    drug, then back to the medication list on (patient, other drug): two
    equi-joins whose output is only the interacting pairs, never every pair
    of a patient's list. Pairs are reported once (drug_a < drug_b).
    """
    m = meds.select(F.col(patient), F.lower(F.col(drug)).alias("drug")).distinct()
    a = m.join(F.broadcast(pairs), "drug")
    b = m.select(F.col(patient), F.col("drug").alias("other"))
    j = a.join(b, [patient, "other"]).where(F.col("drug") < F.col("other"))
    return j.select(patient, F.col("drug").alias("drug_a"), F.col("other").alias("drug_b"), "severity", "mechanism",
                    "management")
