"""Registered queries for group B (quality and validation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.operators import quality as B
from sparkclin.plans.registry import register
from sparkclin.sources.io import table
from sparkclin.sources.views import patients, scored

PCOLS = ["age", "pregnancies", "glucose", "blood_pressure", "skin_thickness", "insulin", "bmi",
         "diabetes_pedigree"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# B1 -----------------------------------------------------------------------
_ALL_P = ["patient_id", "k", "visit_ts", "age", "sex", "gender", "pregnancies", "glucose",
          "blood_pressure", "skin_thickness", "insulin", "bmi", "diabetes_pedigree", "entity_id"]


@register("missing_profile", dbl=["missing_pct"], sql="SELECT * FROM (" + _union([
    f"SELECT '{c}' AS col_name, count_if({c} IS NULL) AS missing_count, "
    f"CAST(count_if({c} IS NULL) AS DOUBLE) * 100 / count(*) AS missing_pct FROM patients_v" for c in _ALL_P])
    + ") t WHERE missing_count > 0")
def q_missing_profile(spark, sf):
    return B.missing_profile(patients(spark, sf))


# B2
@register("duplicate_count", sql="""
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM patients_v GROUP BY gender, age, pregnancies) t""")
def q_duplicate_count(spark, sf):
    return B.duplicate_count(patients(spark, sf).select("gender", "age", "pregnancies"))


# B4
def _iqr_sql(cols, k, src):
    qs = ", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS q_{c}" for c in cols)
    lo = lambda c: f"(q_{c}[1] - {k} * (q_{c}[2] - q_{c}[1]))"
    hi = lambda c: f"(q_{c}[2] + {k} * (q_{c}[2] - q_{c}[1]))"
    cnt = ", ".join(f"count_if({c} < {lo(c)} OR {c} > {hi(c)}) AS n_{c}" for c in cols)
    rows = _union([f"SELECT '{c}' AS col_name, {_d(f'q_{c}[1]')} AS q1, {_d(f'q_{c}[2]')} AS q3, "
                   f"{_d(lo(c))} AS lower, {_d(hi(c))} AS upper, n_{c} AS n_outliers FROM qs, cs" for c in cols])
    return (f"WITH qs AS (SELECT {qs} FROM {src}), cs AS (SELECT {cnt} FROM {src}, qs) "
            f"SELECT * FROM ({rows}) t WHERE n_outliers > 0")


LCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("iqr_outliers", dbl=["q1", "q3", "lower", "upper"], sql=_iqr_sql(PCOLS + ["k"], 1.5, "patients_v"))
def q_iqr_outliers(spark, sf):
    return B.iqr_outliers(patients(spark, sf), PCOLS + ["k"], 1.5)


@register("iqr_outliers_lineitem", dbl=["q1", "q3", "lower", "upper"], sql=_iqr_sql(LCOLS, 1.5, "lineitem"))
def q_iqr_outliers_lineitem(spark, sf):
    return B.iqr_outliers(table(spark, sf, "lineitem"), LCOLS, 1.5)


# B5
@register("zscore_outliers", sql=(
    "WITH st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in LCOLS)
    + " FROM lineitem), cs AS (SELECT " + ", ".join(
        f"count_if(abs({c} - m_{c}) / s_{c} > 3) AS n_{c}" for c in LCOLS) + " FROM lineitem, st) "
    + _union([f"SELECT '{c}' AS col_name, n_{c} AS n_outliers FROM cs" for c in LCOLS])))
def q_zscore_outliers(spark, sf):
    return B.zscore_outliers(table(spark, sf, "lineitem"), LCOLS)


# B6
@register("describe_numeric", dbl=["mean", "std", "min", "p25", "p50", "p75", "max"], sql=_union([
    f"SELECT '{c}' AS col_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"{_d(f'min({c})')} AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, {_d(f'max({c})')} AS max FROM patients_v" for c in PCOLS]))
def q_describe_numeric(spark, sf):
    return B.describe_numeric(patients(spark, sf), PCOLS)


# B7
_PAIRS = [(a, b) for i, a in enumerate(PCOLS) for b in PCOLS[i + 1:]]


@register("correlation_pairs", dbl=["r"], sql="SELECT * FROM (" + _union([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({_d(a)}, {_d(b)}) AS r FROM patients_v"
    for a, b in _PAIRS]) + ") t WHERE abs(r) > 0.02")
def q_correlation_pairs(spark, sf):
    return B.correlation_pairs(patients(spark, sf), PCOLS, threshold=0.02)


# B8
_RANGE_RULES = B.range_rules(B.CLINICAL_RANGES, "error", _ALL_P) + B.range_rules(B.EXPECTED_RANGES, "warning", _ALL_P)


def _rules_sql(rules, src="patients_v", ids=("patient_id",)):
    idl = ", ".join(ids)
    return _union([f"SELECT {idl}, '{r.field}' AS field, '{r.message}' AS message, "
                   f"{_d(r.value or r.field)} AS value, '{r.severity}' AS severity FROM {src} WHERE {r.when}"
                   for r in rules])


@register("validate_ranges", dbl=["value"], sql=_rules_sql(_RANGE_RULES))
def q_validate_ranges(spark, sf):
    p = patients(spark, sf)
    return B.explode_issues(B.apply_rules(p, _RANGE_RULES), ["patient_id"])


# B19
_WARN = [r for r in B.WARNING_RULES if r.field in _ALL_P and "exang" not in r.when and "chol" not in r.when
         and "trestbps" not in r.when]


@register("soft_clinical_warnings", dbl=["value"], sql=_rules_sql(_WARN))
def q_soft_clinical_warnings(spark, sf):
    return B.soft_clinical_warnings(patients(spark, sf), ["patient_id"])


# B9
@register("require_any_value", sql=f"""
SELECT count(*) AS n_rows,
       count_if(coalesce({', '.join(_d(c) for c in ['pregnancies', 'glucose', 'blood_pressure', 'skin_thickness', 'insulin', 'bmi', 'diabetes_pedigree', 'sex'])}) IS NULL) AS n_invalid
FROM patients_v""")
def q_require_any_value(spark, sf):
    p = patients(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(B.require_any_value(p)).alias("n_invalid"))


# B10
@register("validate_enum", sql="""
SELECT event_id, 'event_type' AS field, event_type AS value FROM events
WHERE event_type IS NOT NULL AND event_type NOT IN ('view', 'click', 'signup', 'purchase')""")
def q_validate_enum(spark, sf):
    return B.validate_enum(table(spark, sf, "events"), "event_type", ["view", "click", "signup", "purchase"],
                           ["event_id"])


# B11
@register("check_plausibility", dbl=["share_obese_hyperglycemic"], sql="""
SELECT *, share_obese_hyperglycemic <= 0.5 AS obese_share_ok, n_young_multiparous = 0 AS young_pregnancy_ok
FROM (SELECT avg(CASE WHEN bmi > 30 AND glucose > 200 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_obese_hyperglycemic,
             count_if(age < 20 AND pregnancies > 3) AS n_young_multiparous FROM patients_v) t""")
def q_check_plausibility(spark, sf):
    return B.check_plausibility(patients(spark, sf))


# B12
@register("check_class_balance", dbl=["ratio"], sql="""
SELECT *, CAST(min_count AS DOUBLE) / max_count AS ratio,
       CASE WHEN n_classes < 2 THEN 'fail' WHEN CAST(min_count AS DOUBLE) / max_count < 0.1 THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT count(*) AS n_classes, min(n) AS min_count, max(n) AS max_count
      FROM (SELECT y_true, count(*) AS n FROM scored_v GROUP BY y_true) a) b""")
def q_check_class_balance(spark, sf):
    return B.check_class_balance(scored(spark, sf), "y_true", warn_ratio=0.1)


# B14
@register("check_critical_missing", sql="SELECT * FROM (" + _union([
    f"SELECT '{c}' AS col_name, count_if({c} IS NULL) AS missing_count, "
    f"CAST(count_if({c} IS NULL) AS VARCHAR) || ' missing values in critical column {c}' AS message FROM patients_v"
    for c in ["glucose", "bmi", "age"]]) + ") t WHERE missing_count > 0")
def q_check_critical_missing(spark, sf):
    return B.check_critical_missing(patients(spark, sf))


# B15
@register("check_unique_key", sql="""
SELECT entity_id, count(*) AS n FROM patients_v WHERE entity_id IS NOT NULL GROUP BY entity_id HAVING count(*) > 1""")
def q_check_unique_key(spark, sf):
    return B.check_unique_key(patients(spark, sf), "entity_id")


# B16
@register("check_formats", sql=f"""
SELECT c_custkey, coalesce(regexp_matches(c_mktsegment, '{B.ID_PATTERN}'), false) AS id_ok,
       coalesce(regexp_matches(c_name, '{B.NAME_PATTERN.replace("'", "''")}'), true) AS name_ok
FROM customer""")
def q_check_formats(spark, sf):
    c = table(spark, sf, "customer")
    return B.check_formats(c, id_col="c_mktsegment", name_col="c_name").select("c_custkey", "id_ok", "name_ok")


# B17
@register("age_from_dob", sql="""
SELECT o_orderkey, CAST(2024 - year(o_orderdate) - CASE WHEN 6 < month(o_orderdate)
       OR (6 = month(o_orderdate) AND 30 < day(o_orderdate)) THEN 1 ELSE 0 END AS BIGINT) AS age_years
FROM orders""")
def q_age_from_dob(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", B.age_from_dob(F.col("o_orderdate"), F.lit("2024-06-30").cast("date"))
                    .cast("bigint").alias("age_years"))


# B18
@register("check_score_level", sql="""
SELECT level, ok, count(*) AS n FROM (
  SELECT CASE WHEN y_pred = 1 THEN 'High Risk' ELSE 'Low Risk' END AS level,
         coalesce(contains(lower(CASE WHEN y_pred = 1 THEN 'High Risk' ELSE 'Low Risk' END),
                  lower(CASE WHEN y_prob * 100 >= 60 THEN 'High' WHEN y_prob * 100 >= 30 THEN 'Moderate' ELSE 'Low' END)), false) AS ok
  FROM scored_v) t GROUP BY level, ok""")
def q_check_score_level(spark, sf):
    s = scored(spark, sf).select(F.when(F.col("y_pred") == 1, "High Risk").otherwise("Low Risk").alias("level"),
                                 (F.col("y_prob") * 100).alias("score"))
    return (s.select("level", B.check_score_level(F.col("score"), F.col("level")).alias("ok"))
            .groupBy("level", "ok").agg(F.count(F.lit(1)).alias("n")))


# B20
@register("validation_summary", sql=f"""
SELECT n_errors = 0 AS is_valid, * FROM (
  SELECT count_if(severity = 'error') AS n_errors, count_if(severity = 'warning') AS n_warnings,
         count_if(severity = 'info') AS n_infos FROM ({_rules_sql(_RANGE_RULES + _WARN)}) i) t""")
def q_validation_summary(spark, sf):
    p = patients(spark, sf)
    issues = B.explode_issues(B.apply_rules(p, _RANGE_RULES + _WARN), ["patient_id"])
    return B.validation_summary(issues)


# Expected values for every 10th patient; actual = the stand-in score.
_GOLD_EXPECTED_SQL = """
SELECT k AS case_id, 'risk_score' AS field, 'interval' AS kind, CAST(0 AS DOUBLE) AS lo, CAST(50 AS DOUBLE) AS hi,
       CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM patients_v WHERE k % 10 = 0
UNION ALL
SELECT k, 'risk_score', 'approx', NULL, NULL, CAST(50 AS DOUBLE), NULL FROM patients_v WHERE k % 10 = 1
UNION ALL
SELECT k, 'risk_level', 'exact', NULL, NULL, NULL, 'High' FROM patients_v WHERE k % 10 = 2"""
_GOLD_ACTUAL_SQL = """
SELECT k AS case_id, 'risk_score' AS field, y_prob * 100 AS value, CAST(NULL AS VARCHAR) AS text FROM scored_v WHERE k % 7 <> 3
UNION ALL
SELECT k, 'risk_level', NULL, CASE WHEN y_prob * 100 < 30 THEN 'Low' WHEN y_prob * 100 < 60 THEN 'Moderate' ELSE 'High' END
FROM scored_v WHERE k % 7 <> 3"""


@register("golden_compare", sql=f"""
SELECT coalesce(e.case_id, a.case_id) AS case_id, coalesce(e.field, a.field) AS field, e.kind,
  coalesce(CASE WHEN e.kind IS NULL THEN false
       WHEN a.value IS NULL AND a.text IS NULL THEN false
       WHEN e.kind = 'interval' THEN a.value BETWEEN e.lo AND e.hi
       WHEN e.kind = 'approx' THEN abs(a.value - e.value) <= 0.01 * greatest(1.0, abs(e.value))
       ELSE a.text = e.text END, false) AS passed
FROM ({_GOLD_EXPECTED_SQL}) e FULL OUTER JOIN ({_GOLD_ACTUAL_SQL}) a ON e.case_id = a.case_id AND e.field = a.field
WHERE coalesce(e.case_id, a.case_id) % 10 < 3""")
def q_golden_compare(spark, sf):
    from sparkclin.sources.views import view_sql  # noqa: F401
    p = patients(spark, sf)
    s = scored(spark, sf)
    exp = (p.where("k % 10 = 0").selectExpr("k AS case_id", "'risk_score' AS field", "'interval' AS kind",
                                            "CAST(0 AS DOUBLE) AS lo", "CAST(50 AS DOUBLE) AS hi",
                                            "CAST(NULL AS DOUBLE) AS value", "CAST(NULL AS STRING) AS text")
           .unionByName(p.where("k % 10 = 1").selectExpr("k AS case_id", "'risk_score' AS field", "'approx' AS kind",
                                                         "CAST(NULL AS DOUBLE) AS lo", "CAST(NULL AS DOUBLE) AS hi",
                                                         "CAST(50 AS DOUBLE) AS value", "CAST(NULL AS STRING) AS text"))
           .unionByName(p.where("k % 10 = 2").selectExpr("k AS case_id", "'risk_level' AS field", "'exact' AS kind",
                                                         "CAST(NULL AS DOUBLE) AS lo", "CAST(NULL AS DOUBLE) AS hi",
                                                         "CAST(NULL AS DOUBLE) AS value", "'High' AS text")))
    act = (s.where("k % 7 <> 3").selectExpr("k AS case_id", "'risk_score' AS field", "y_prob * 100 AS value",
                                            "CAST(NULL AS STRING) AS text")
           .unionByName(s.where("k % 7 <> 3").selectExpr(
               "k AS case_id", "'risk_level' AS field", "CAST(NULL AS DOUBLE) AS value",
               "CASE WHEN y_prob * 100 < 30 THEN 'Low' WHEN y_prob * 100 < 60 THEN 'Moderate' ELSE 'High' END AS text")))
    return B.golden_compare(act, exp, "case_id").where("case_id % 10 < 3")


# B22
def _quality_report_sql():
    cols = PCOLS
    parts = ["SELECT 'shape' AS section, CAST(NULL AS VARCHAR) AS col_name, 'rows' AS metric, "
             "CAST(count(*) AS DOUBLE) AS value FROM patients_v",
             f"SELECT 'shape', NULL, 'columns', CAST({len(_ALL_P)} AS DOUBLE)"]
    parts += [f"SELECT 'missing', '{c}', 'missing_count', CAST(count_if({c} IS NULL) AS DOUBLE) FROM patients_v "
              f"HAVING count_if({c} IS NULL) > 0" for c in _ALL_P]
    parts.append("SELECT 'duplicates', NULL, 'n_duplicates', CAST(coalesce(sum(c - 1), 0) AS DOUBLE) FROM "
                 f"(SELECT count(*) AS c FROM patients_v GROUP BY {', '.join(_ALL_P)}) d")
    parts.append(f"SELECT 'outliers', col_name, 'n_outliers', CAST(n_outliers AS DOUBLE) FROM ("
                 f"{_iqr_sql(cols, 1.5, 'patients_v')}) o")
    for c in cols:
        for m, e in [("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", _d(f"min({c})")),
                     ("p25", f"quantile_cont({c}, 0.25)"), ("p50", f"quantile_cont({c}, 0.5)"),
                     ("p75", f"quantile_cont({c}, 0.75)"), ("max", _d(f"max({c})"))]:
            parts.append(f"SELECT 'describe', '{c}', '{m}', {e} FROM patients_v")
    parts += [f"SELECT 'correlation', '{a}~{b}', 'r', r FROM (SELECT corr({_d(a)}, {_d(b)}) AS r FROM patients_v) c "
              f"WHERE abs(r) > 0.8" for a, b in _PAIRS]
    return "SELECT * FROM (" + _union(parts) + ") t"


@register("quality_report", dbl=["value"], sql=_quality_report_sql())
def q_quality_report(spark, sf):
    return B.quality_report(patients(spark, sf), PCOLS)
