"""B: data quality profiles and validation rules.

Profiles are single-pass aggregates over all requested columns (one scan,
map-side partial aggregation, one tiny final stage), then exploded to long
form. Row-level validation is a declarative rule list compiled into one
projection: ``array(when(violation, struct(...)))`` filtered of NULLs, so it
stays inside whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import column_quantiles, numeric_columns, q, rows_from_struct_array, with_constants

# Fixed values that must equal the reference: clinical field ranges
# (field, low, high), inclusive on both ends.
CLINICAL_RANGES = [
    ("age", 0, 120), ("sex", 0, 1), ("pregnancies", 0, 20), ("glucose", 0, 300),
    ("blood_pressure", 0, 200), ("skin_thickness", 0, 100), ("insulin", 0, 1000),
    ("bmi", 10, 60), ("diabetes_pedigree", 0, 3), ("cp", 0, 3), ("trestbps", 0, 300),
    ("chol", 0, 600), ("fbs", 0, 1), ("restecg", 0, 2), ("thalach", 50, 250),
    ("exang", 0, 1), ("oldpeak", 0, 10), ("slope", 0, 2), ("ca", 0, 4), ("thal", 0, 3),
    ("target", 0, 1),
]

# Tighter "expected" ranges used for clamping and warnings.
EXPECTED_RANGES = [
    ("glucose", 70, 140), ("blood_pressure", 60, 120), ("bmi", 18.5, 30), ("age", 18, 65),
    ("chol", 120, 240), ("thalach", 100, 200), ("trestbps", 90, 140),
]

CLINICAL_FIELDS = ["pregnancies", "glucose", "blood_pressure", "skin_thickness", "insulin", "bmi",
                   "diabetes_pedigree", "sex", "cp", "trestbps", "chol", "fbs", "restecg",
                   "thalach", "exang", "oldpeak", "slope", "ca", "thal"]

ID_PATTERN = r"^[A-Z0-9]{4,20}$"
NAME_PATTERN = r"^[a-zA-Z\s\-\.']+$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


@dataclass(frozen=True)
class Rule:
    """A violation predicate (SQL text) with the issue it produces."""
    field: str
    when: str
    message: str
    severity: str = "error"
    value: str | None = None  # expression for the reported value; default the field


# ------------------------------------------------------------------ profiles
def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """B1: (column, missing_count, missing_pct) for columns with missing values."""
    cols = cols or df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(q(c)).isNull()).alias(c) for c in cols])
    structs = [F.struct(F.lit(c).alias("col_name"), F.col(q(c)).alias("missing_count"),
                        (F.col(q(c)) * 100.0 / F.col("__n")).alias("missing_pct")) for c in cols]
    return rows_from_struct_array(one, structs).where(F.col("missing_count") > 0)


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """B2: number of rows that repeat an earlier row over ``cols``."""
    cols = cols or df.columns
    g = df.groupBy(*[F.col(q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def column_types(df: DataFrame) -> DataFrame:
    """Column → type name (driver metadata, size = number of columns)."""
    spark = df.sparkSession
    return spark.createDataFrame([(n, t) for n, t in df.dtypes], "column string, dtype string")


def _quantile_stats(c: str, probs: list[float], approx: bool) -> Column:
    arr = "array(" + ", ".join(str(p) for p in probs) + ")"
    fn = f"percentile_approx({q(c)}, {arr}, 10000)" if approx else f"percentile({q(c)}, {arr})"
    return F.expr(fn)


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 1.5,
                 approx: bool = False) -> DataFrame:
    """Per numeric column rows outside [Q1 − k·IQR, Q3 + k·IQR]; only columns with any.

    Quartiles come from one aggregate (exact ``percentile``; ``approx=True``
    for very wide or huge inputs), joined back as a one-row broadcast.
    """
    cols = cols or numeric_columns(df)
    qs = column_quantiles(df, cols, [0.25, 0.75], approx)
    j = with_constants(df.select(*[F.col(q(c)) for c in cols]), qs)
    def lo(i): return F.col(f"__q_{i}")[0] - k * (F.col(f"__q_{i}")[1] - F.col(f"__q_{i}")[0])
    def hi(i): return F.col(f"__q_{i}")[1] + k * (F.col(f"__q_{i}")[1] - F.col(f"__q_{i}")[0])
    counts = j.agg(*[F.count_if((F.col(q(c)) < lo(i)) | (F.col(q(c)) > hi(i))).alias(f"__n_{i}")
                     for i, c in enumerate(cols)])
    out = with_constants(counts, qs)
    structs = [F.struct(F.lit(c).alias("col_name"), F.col(f"__q_{i}")[0].cast("double").alias("q1"),
                        F.col(f"__q_{i}")[1].cast("double").alias("q3"), lo(i).cast("double").alias("lower"),
                        hi(i).cast("double").alias("upper"), F.col(f"__n_{i}").alias("n_outliers"))
               for i, c in enumerate(cols)]
    return rows_from_struct_array(out, structs).where(F.col("n_outliers") > 0)


def zscore_outliers(df: DataFrame, cols: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """Per column count of |x − mean| / std(ddof=1) > z."""
    cols = cols or numeric_columns(df)
    st = df.agg(*[F.avg(q(c)).alias(f"__m_{i}") for i, c in enumerate(cols)],
                *[F.stddev_samp(q(c)).alias(f"__s_{i}") for i, c in enumerate(cols)])
    j = with_constants(df.select(*[F.col(q(c)) for c in cols]), st)
    counts = j.agg(*[F.count_if(F.abs(F.col(q(c)) - F.col(f"__m_{i}")) / F.col(f"__s_{i}") > z)
                     .alias(f"__n_{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("col_name"), F.col(f"__n_{i}").alias("n_outliers")) for i, c in enumerate(cols)]
    return rows_from_struct_array(counts, structs)


def describe_numeric(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std, min, 25/50/75 %, max per numeric column (exact quartiles)."""
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(q(c)).alias(f"__c_{i}"), F.avg(q(c)).alias(f"__m_{i}"),
                 F.stddev_samp(q(c)).alias(f"__s_{i}"), F.min(q(c)).cast("double").alias(f"__lo_{i}"),
                 F.max(q(c)).cast("double").alias(f"__hi_{i}")]
    one = df.agg(*aggs).crossJoin(column_quantiles(df, cols, [0.25, 0.5, 0.75], approx,
                                                   prefix="__p_"))
    structs = [F.struct(F.lit(c).alias("col_name"), F.col(f"__c_{i}").alias("count"),
                        F.col(f"__m_{i}").alias("mean"), F.col(f"__s_{i}").alias("std"),
                        F.col(f"__lo_{i}").alias("min"), F.col(f"__p_{i}")[0].cast("double").alias("p25"),
                        F.col(f"__p_{i}")[1].cast("double").alias("p50"),
                        F.col(f"__p_{i}")[2].cast("double").alias("p75"), F.col(f"__hi_{i}").alias("max"))
               for i, c in enumerate(cols)]
    return rows_from_struct_array(one, structs)


def correlation_pairs(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Pearson r of every pair i<j with |r| > threshold, in one aggregate."""
    cols = cols or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(F.col(q(a)).cast("double"), F.col(q(b)).cast("double")).alias(f"__r_{n}")
                   for n, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"__r_{n}").alias("r"))
               for n, (a, b) in enumerate(pairs)]
    return rows_from_struct_array(one, structs).where(F.abs(F.col("r")) > threshold)


# -------------------------------------------------------------- rule engine
def range_rules(ranges=CLINICAL_RANGES, severity: str = "error", cols: list[str] | None = None) -> list[Rule]:
    out = []
    for f, lo, hi in ranges:
        if cols is not None and f not in cols:
            continue
        out.append(Rule(f, f"{q(f)} < {lo} OR {q(f)} > {hi}",
                        f"{f} outside [{lo}, {hi}]", severity))
    return out


# Soft clinical warnings (B19): value checks and disease rules.
WARNING_RULES = [
    Rule("glucose", "glucose > 200", "Extreme glucose level > 200 mg/dL", "warning"),
    Rule("glucose", "glucose < 70", "Low glucose level < 70 mg/dL", "warning"),
    Rule("bmi", "bmi > 40", "Extreme BMI > 40", "warning"),
    Rule("bmi", "bmi < 15", "Very low BMI < 15", "warning"),
    Rule("age", "age > 100", "Unusual age > 100", "warning"),
    Rule("blood_pressure", "blood_pressure > 180", "Severe hypertension > 180 mm Hg", "warning"),
    Rule("blood_pressure", "blood_pressure < 40", "Low blood pressure < 40 mm Hg", "warning"),
    Rule("bmi", "bmi > 35", "BMI > 35 - High risk", "warning"),
    Rule("pregnancies", "age < 20 AND pregnancies > 3", "Young patient with multiple pregnancies", "warning"),
    Rule("chol", "chol > 300", "Very high cholesterol > 300 mg/dL", "warning"),
    Rule("trestbps", "trestbps > 160", "Severe hypertension > 160 mm Hg", "warning"),
    Rule("exang", "age > 65 AND exang = 1", "Elderly patient with exercise angina", "warning"),
]


def rules_for(df: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Keep the rules whose referenced field exists in ``df``."""
    have = set(df.columns)
    return [r for r in rules if r.field in have and all(
        tok not in r.when or tok in have for tok in ("chol", "trestbps", "exang", "age", "pregnancies"))]


def issues_column(rules: list[Rule]) -> Column:
    """array<struct(field, message, value, severity)> of the violated rules."""
    items = [F.when(F.expr(f"coalesce({r.when}, false)"),
                    F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("message"),
                             F.expr(r.value or q(r.field)).cast("double").alias("value"),
                             F.lit(r.severity).alias("severity"))) for r in rules]
    if not items:
        return F.array().cast("array<struct<field:string,message:string,value:double,severity:string>>")
    return F.array_compact(F.array(*items))


def violates_any(rules: list[Rule]) -> Column:
    """TRUE when any rule is violated: a plain boolean predicate for filtering (no array built)."""
    expr = F.lit(False)
    for r in rules:
        expr = expr | F.expr(f"coalesce({r.when}, false)")
    return expr


def apply_rules(df: DataFrame, rules: list[Rule], out_col: str = "issues") -> DataFrame:
    """K7 form: per-row multi-output validation as an array column."""
    return df.withColumn(out_col, issues_column(rules))


def explode_issues(df: DataFrame, id_cols: list[str], issues_col: str = "issues") -> DataFrame:
    return df.select(*id_cols, F.explode(issues_col).alias("__i")).select(*id_cols, "__i.*")


def validate_ranges(df: DataFrame, id_cols: list[str], ranges=CLINICAL_RANGES,
                    severity: str = "error") -> DataFrame:
    """One row per (record, field) outside its range."""
    rules = range_rules(ranges, severity, df.columns)
    return explode_issues(apply_rules(df, rules), id_cols)


def soft_clinical_warnings(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Per-row warnings; rules whose fields are absent are skipped."""
    return explode_issues(apply_rules(df, rules_for(df, WARNING_RULES)), id_cols)


def require_any_value(df: DataFrame, fields: list[str] | None = None) -> Column:
    """TRUE when every present clinical field is NULL (the row is invalid)."""
    fields = [f for f in (fields or CLINICAL_FIELDS) if f in df.columns]
    return F.coalesce(*[F.col(q(f)).cast("double") for f in fields]).isNull()


def validate_enum(df: DataFrame, col: str, allowed: list[str], id_cols: list[str]) -> DataFrame:
    """Rows whose non-null value is outside the allowed set."""
    return (df.where(F.col(col).isNotNull() & ~F.col(col).isin(*allowed))
            .select(*id_cols, F.lit(col).alias("field"), F.col(col).cast("string").alias("value")))


def check_plausibility(df: DataFrame) -> DataFrame:
    """Share of (bmi>30 & glucose>200) and count of (age<20 & pregnancies>3)."""
    share = F.avg(F.when((F.col("bmi") > 30) & (F.col("glucose") > 200), 1.0).otherwise(0.0))
    young = F.count_if((F.col("age") < 20) & (F.col("pregnancies") > 3))
    return df.agg(share.alias("share_obese_hyperglycemic"), young.alias("n_young_multiparous")).select(
        "*", (F.col("share_obese_hyperglycemic") <= 0.5).alias("obese_share_ok"),
        (F.col("n_young_multiparous") == 0).alias("young_pregnancy_ok"))


def check_class_balance(df: DataFrame, target: str = "target", warn_ratio: float = 0.01) -> DataFrame:
    """Classes, min/max counts, ratio, status (fail < 2 classes, warn below ratio)."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    s = c.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_count"), F.max("n").alias("max_count"))
    ratio = F.col("min_count") / F.col("max_count")
    return s.select("*", ratio.alias("ratio"),
                    F.when(F.col("n_classes") < 2, "fail").when(ratio < warn_ratio, "warn")
                    .otherwise("ok").alias("status"))


# The strict training schema (diabetes columns, all non-null).
STRICT_TRAINING_COLUMNS = ["pregnancies", "glucose", "blood_pressure", "skin_thickness", "insulin",
                           "bmi", "diabetes_pedigree", "age", "target"]


def check_strict_schema(df: DataFrame, required: list[str] = STRICT_TRAINING_COLUMNS) -> DataFrame:
    """Missing / unexpected columns (driver metadata) and null counts of present ones."""
    missing = [c for c in required if c not in df.columns]
    extra = [c for c in df.columns if c not in required]
    present = [c for c in required if c in df.columns]
    nulls = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(c) for c in present]) if present else \
        df.sparkSession.range(1).select()
    structs = [F.struct(F.lit(c).alias("col_name"), F.col(q(c)).cast("bigint").alias("n_null"),
                        F.lit("present").alias("state")) for c in present]
    structs += [F.struct(F.lit(c).alias("col_name"), F.lit(None).cast("bigint").alias("n_null"),
                         F.lit("missing").alias("state")) for c in missing]
    structs += [F.struct(F.lit(c).alias("col_name"), F.lit(None).cast("bigint").alias("n_null"),
                         F.lit("unexpected").alias("state")) for c in extra]
    return rows_from_struct_array(nulls, structs)


def check_critical_missing(df: DataFrame, critical=("glucose", "bmi", "age")) -> DataFrame:
    """Warning rows for critical columns with missing values."""
    prof = missing_profile(df, [c for c in critical if c in df.columns])
    return prof.select("col_name", "missing_count", F.concat(
        F.col("missing_count").cast("string"), F.lit(" missing values in critical column "),
        F.col("col_name")).alias("message"))


def check_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Non-null keys that occur more than once."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def check_formats(df: DataFrame, id_col: str | None = None, name_col: str | None = None,
                  email_col: str | None = None) -> DataFrame:
    """Format flags (NULL names / emails pass)."""
    out = []
    if id_col:
        out.append(F.coalesce(F.col(id_col).rlike(ID_PATTERN), F.lit(False)).alias("id_ok"))
    if name_col:
        out.append(F.coalesce(F.col(name_col).rlike(NAME_PATTERN), F.lit(True)).alias("name_ok"))
    if email_col:
        out.append(F.coalesce(F.col(email_col).rlike(EMAIL_PATTERN), F.lit(True)).alias("email_ok"))
    return df.select("*", *out)


def age_from_dob(dob: Column, as_of: Column, stored_age: Column | None = None) -> Column:
    """Whole years between birth date and ``as_of``, birthday aware."""
    y = (F.year(as_of) - F.year(dob)
         - F.when((F.month(as_of) < F.month(dob)) |
                  ((F.month(as_of) == F.month(dob)) & (F.dayofmonth(as_of) < F.dayofmonth(dob))), 1).otherwise(0))
    return y if stored_age is None else F.coalesce(y, stored_age)


def check_score_level(score: Column, level: Column) -> Column:
    """TRUE when the level agrees with the score band (≥60 High, 30–60 Moderate, <30 Low)."""
    expect = F.when(score >= 60, "High").when(score >= 30, "Moderate").otherwise("Low")
    return F.coalesce(F.lower(level).contains(F.lower(expect)), F.lit(False))


def validation_summary(issues: DataFrame, severity_col: str = "severity") -> DataFrame:
    """is_valid, and counts of errors / warnings / infos."""
    return issues.agg(
        F.count_if(F.col(severity_col) == "error").alias("n_errors"),
        F.count_if(F.col(severity_col) == "warning").alias("n_warnings"),
        F.count_if(F.col(severity_col) == "info").alias("n_infos"),
    ).select((F.col("n_errors") == 0).alias("is_valid"), "*")


def golden_compare(actual: DataFrame, expected: DataFrame, key: str = "case_id",
                   tol: float = 0.01) -> DataFrame:
    """Compare actual vs expected rows per case and expectation kind.

    ``expected(case_id, field, kind, lo, hi, value, text)`` with kind in
    interval / approx / exact; ``actual(case_id, field, value, text)``.
    A full outer join keeps cases missing on either side as failures.
    """
    a = actual.select(key, "field", F.col("value").alias("a_value"), F.col("text").alias("a_text"))
    j = expected.join(a, [key, "field"], "full_outer")
    ok = (F.when(F.col("kind").isNull(), F.lit(False))
          .when(F.col("a_value").isNull() & F.col("a_text").isNull(), F.lit(False))
          .when(F.col("kind") == "interval", F.col("a_value").between(F.col("lo"), F.col("hi")))
          .when(F.col("kind") == "approx",
                F.abs(F.col("a_value") - F.col("value")) <= tol * F.greatest(F.lit(1.0), F.abs(F.col("value"))))
          .otherwise(F.col("a_text") == F.col("text")))
    return j.select(key, "field", "kind", F.coalesce(ok, F.lit(False)).alias("passed"))


def golden_summary(results: DataFrame, key: str = "case_id") -> DataFrame:
    per_case = results.groupBy(key).agg(F.min(F.col("passed").cast("int")).alias("ok"))
    return per_case.agg(F.count(F.lit(1)).alias("n_cases"), F.sum("ok").cast("bigint").alias("n_passed"),
                        F.avg("ok").alias("pass_rate"))


def quality_report(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, approx: bool = False) -> DataFrame:
    """One long-form report (section, col_name, metric, value) over B1, B2, B4, B6, B7.

    Three passes over the input whatever the number of columns: one aggregate
    holds the row count, every column's missing count, the describe statistics
    (with quartiles) and all pairwise correlations; a second counts IQR
    outliers against those quartiles (a one-row broadcast); the third is the
    duplicate group-by. The one-row profile feeds every section, so its
    exchange is shared.
    """
    cols = cols or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(F.col(q(c)).isNull()).alias(f"__miss_{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(cols):
        x = F.col(q(c))
        aggs += [F.avg(x).alias(f"__m_{i}"), F.stddev_samp(x).alias(f"__s_{i}"), F.min(x).cast("double").alias(f"__lo_{i}"),
                 F.max(x).cast("double").alias(f"__hi_{i}")]
    aggs += [F.corr(F.col(q(a)).cast("double"), F.col(q(b)).cast("double")).alias(f"__r_{n}") for n, (a, b) in enumerate(pairs)]
    prof = df.agg(*aggs).crossJoin(column_quantiles(df, cols, [0.25, 0.5, 0.75], approx,
                                                    prefix="__p_"))

    def row(section, col, metric, value):
        return F.struct(F.lit(section).alias("section"), F.lit(col).cast("string").alias("col_name"),
                        F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    items = [row("shape", None, "rows", F.col("__rows")), row("shape", None, "columns", F.lit(float(len(df.columns))))]
    items += [F.when(F.col(f"__miss_{i}") > 0, row("missing", c, "missing_count", F.col(f"__miss_{i}")))
              for i, c in enumerate(df.columns)]
    for i, c in enumerate(cols):
        for metric, e in [("mean", F.col(f"__m_{i}")), ("std", F.col(f"__s_{i}")), ("min", F.col(f"__lo_{i}")),
                          ("p25", F.col(f"__p_{i}")[0]), ("p50", F.col(f"__p_{i}")[1]), ("p75", F.col(f"__p_{i}")[2]),
                          ("max", F.col(f"__hi_{i}"))]:
            items.append(row("describe", c, metric, e))
    items += [F.when(F.abs(F.col(f"__r_{n}")) > 0.8, row("correlation", f"{a}~{b}", "r", F.col(f"__r_{n}")))
              for n, (a, b) in enumerate(pairs)]
    base = prof.select(F.explode(F.array_compact(F.array(*items))).alias("s")).select("s.*")

    qs = prof.select(*[F.col(f"__p_{i}").alias(f"__q_{i}") for i in range(len(cols))])
    j = with_constants(df.select(*[F.col(q(c)) for c in cols]), qs)
    def lo(i): return F.col(f"__q_{i}")[0] - k * (F.col(f"__q_{i}")[2] - F.col(f"__q_{i}")[0])
    def hi(i): return F.col(f"__q_{i}")[2] + k * (F.col(f"__q_{i}")[2] - F.col(f"__q_{i}")[0])
    counts = j.agg(*[F.count_if((F.col(q(c)) < lo(i)) | (F.col(q(c)) > hi(i))).alias(f"__n_{i}") for i, c in enumerate(cols)])
    out_items = [F.when(F.col(f"__n_{i}") > 0, row("outliers", c, "n_outliers", F.col(f"__n_{i}"))) for i, c in enumerate(cols)]
    outl = counts.select(F.explode(F.array_compact(F.array(*out_items))).alias("s")).select("s.*")
    dup = duplicate_count(df).select(F.lit("duplicates").alias("section"), F.lit(None).cast("string").alias("col_name"),
                                     F.lit("n_duplicates").alias("metric"), F.col("n_duplicates").cast("double").alias("value"))
    return base.unionByName(outl).unionByName(dup)
