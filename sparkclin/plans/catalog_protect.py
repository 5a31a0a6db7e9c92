"""Registered queries for group C (input protection and privacy)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.operators import privacy as PV
from sparkclin.operators import protect as PR
from sparkclin.operators import robust as RB
from sparkclin.plans.registry import register
from sparkclin.sources.io import table
from sparkclin.sources.views import patients, reqlog


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits_sql(col):
    arms = ", ".join(f"CASE WHEN coalesce(regexp_matches({col}, {_lit('(?i)' + p)}), false) THEN "
                     f"{{'field': '{col}', 'type': '{t}', 'severity': '{s}'}} END" for p, t, s in PR.INJECTION_PATTERNS)
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


def _inj_sql(tbl, key, col):
    return f"""
WITH h AS (SELECT {key}, {_hits_sql(col)} AS hits FROM {tbl})
SELECT {key}, CASE WHEN len(list_filter(hits, lambda s: s.severity IN ('CRITICAL', 'HIGH'))) > 0 THEN 'CRITICAL'
                  WHEN len(hits) > 0 THEN 'MEDIUM' ELSE 'NONE' END AS injection_level,
       CAST(len(hits) AS INTEGER) AS n_hits,
       CAST(len(list_filter(hits, lambda s: s.severity NOT IN ('CRITICAL', 'HIGH'))) AS INTEGER) AS n_warnings,
       list_transform(hits, lambda s: s.type || ':' || s.field) AS signatures FROM h"""


@register("detect_injection", sql=_inj_sql("documents", "doc_id", "text"))
def q_detect_injection(spark, sf):
    d = PR.detect_injection(table(spark, sf, "documents").select("doc_id", "text"), ["text"])
    return d.select("doc_id", "injection_level", F.size("injection_hits").alias("n_hits"), "n_warnings", "signatures")


@register("detect_injection_pages", sql=_inj_sql("pages", "page_id", "html"))
def q_detect_injection_pages(spark, sf):
    d = PR.detect_injection(table(spark, sf, "pages").select("page_id", "html"), ["html"])
    return d.select("page_id", "injection_level", F.size("injection_hits").alias("n_hits"), "n_warnings", "signatures")


@register("sanitize_text", sql=f"SELECT page_id, translate(html, {_lit(PR.DANGEROUS_CHARS)}, '') AS html FROM pages")
def q_sanitize_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", PR.sanitize_text(F.col("html")).alias("html"))


_RAW = ("CASE WHEN k % 13 = 0 THEN 'x' || CAST(k AS VARCHAR) WHEN glucose IS NULL THEN NULL ELSE CAST(glucose AS VARCHAR) END")


@register("coerce_types", dbl=["glucose"], sql=f"""
SELECT patient_id, try_cast(trim(g) AS DOUBLE) AS glucose,
       CAST(CASE WHEN g IS NOT NULL AND try_cast(trim(g) AS DOUBLE) IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_errors,
       CAST(CASE WHEN g IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_warnings
FROM (SELECT patient_id, {_RAW} AS g FROM patients_v) t""")
def q_coerce_types(spark, sf):
    p = patients(spark, sf).select("patient_id", F.expr(_RAW.replace("VARCHAR", "STRING")).alias("glucose"))
    c = PR.coerce_types(p, ["glucose"])
    return c.select("patient_id", "glucose", F.size("coerce_errors").alias("n_errors"),
                    F.size("coerce_warnings").alias("n_warnings"))


_CL_FIELDS = ["glucose", "blood_pressure", "bmi", "age"]


def _clamp_sql():
    cr = {f: (lo, hi) for f, lo, hi in PR.CLINICAL_RANGES}
    er = {f: (lo, hi) for f, lo, hi in PR.EXPECTED_RANGES}
    cols, errs, warns = [], [], []
    for f in _CL_FIELDS:
        lo, hi = cr[f]
        elo, ehi = er[f]
        x = f"CAST({f} AS DOUBLE)"
        bad = f"({x} < {lo} OR {x} > {hi})"
        cols.append(f"CASE WHEN {bad} THEN least(greatest({x}, CAST({lo} AS DOUBLE)), CAST({hi} AS DOUBLE)) "
                    f"ELSE least(greatest({x}, CAST({elo} AS DOUBLE)), CAST({ehi} AS DOUBLE)) END AS {f}")
        errs.append(f"CASE WHEN coalesce({bad}, false) THEN 1 ELSE 0 END")
        warns.append(f"CASE WHEN coalesce(NOT {bad} AND {x} < {elo}, false) THEN 1 ELSE 0 END")
        warns.append(f"CASE WHEN coalesce(NOT {bad} AND {x} > {ehi}, false) THEN 1 ELSE 0 END")
    return (f"SELECT patient_id, {', '.join(cols)}, CAST({' + '.join(errs)} AS INTEGER) AS n_errors, "
            f"CAST({' + '.join(warns)} AS INTEGER) AS n_warnings FROM patients_v")


@register("clamp_ranges", dbl=_CL_FIELDS, sql=_clamp_sql())
def q_clamp_ranges(spark, sf):
    c = PR.clamp_ranges(patients(spark, sf).select("patient_id", *_CL_FIELDS), _CL_FIELDS)
    return c.select("patient_id", *_CL_FIELDS, F.size("range_errors").alias("n_errors"),
                    F.size("range_warnings").alias("n_warnings"))


_ZF = ["pregnancies", "glucose", "blood_pressure", "skin_thickness", "insulin", "bmi", "diabetes_pedigree", "age"]


@register("row_zscore_anomaly", dbl=["max_row_z"], sql=f"""
WITH a AS (SELECT patient_id, list_filter([{', '.join(f'CAST({c} AS DOUBLE)' for c in _ZF)}], lambda x: x IS NOT NULL) AS v FROM patients_v),
b AS (SELECT patient_id, v, list_avg(v) AS m FROM a),
c AS (SELECT patient_id, v, m, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)) AS sd FROM b)
SELECT patient_id, list_max(list_transform(v, lambda x: CASE WHEN sd > 0 THEN abs(x - m) / sd ELSE 0.0 END)) AS max_row_z,
       CAST(len(list_filter(v, lambda x: sd > 0 AND abs(x - m) / sd > 3)) AS INTEGER) AS n_anomalies FROM c""")
def q_row_zscore_anomaly(spark, sf):
    z = PR.row_zscore(patients(spark, sf).select("patient_id", *_ZF), _ZF)
    return z.select("patient_id", "max_row_z", F.size("anomaly_signatures").alias("n_anomalies"))


_CTX = ["CASE WHEN user_id % 3 = 0 THEN '192.168.1.' || CAST(user_id AS VARCHAR) ELSE '8.8.' || CAST(user_id AS VARCHAR) END AS ip",
        "CASE endpoint WHEN '/error' THEN 'curl/8.0' WHEN '/view' THEN 'Mozilla/5.0' ELSE 'Python-Requests/2.0' END AS ua",
        "latency_ms * 2 AS req"]


@register("context_checks", sql=f"""
SELECT event_id, coalesce(NOT (starts_with(ip, '192.168.') OR starts_with(ip, '10.')), false) AS external_ip,
       coalesce(req > 1000, false) AS rate_exceeded,
       coalesce(len(list_filter({[a for a in PR.SUSPICIOUS_AGENTS]!r}, lambda a: contains(lower(ua), a))) > 0, false) AS suspicious_agent
FROM (SELECT event_id, {', '.join(_CTX)} FROM reqlog_v) t""".replace('"', "'"))
def q_context_checks(spark, sf):
    r = reqlog(spark, sf).selectExpr("event_id", *[c.replace("VARCHAR", "STRING") for c in _CTX])
    c = r.select("event_id", PR.context_checks(F.col("ip"), F.col("req"), F.col("ua")).alias("c"))
    return c.select("event_id", "c.*")


def _protect_sql():
    cr = {f: (lo, hi) for f, lo, hi in PR.CLINICAL_RANGES}
    er = {f: (lo, hi) for f, lo, hi in PR.EXPECTED_RANGES}
    warn_terms, err_terms = [], []
    for f in _CL_FIELDS:
        lo, hi = cr[f]
        elo, ehi = er[f]
        x = f"CAST({f} AS DOUBLE)"
        warn_terms += [f"CASE WHEN {f} IS NULL THEN 1 ELSE 0 END",
                       f"CASE WHEN coalesce(NOT ({x} < {lo} OR {x} > {hi}) AND {x} < {elo}, false) THEN 1 ELSE 0 END",
                       f"CASE WHEN coalesce(NOT ({x} < {lo} OR {x} > {hi}) AND {x} > {ehi}, false) THEN 1 ELSE 0 END"]
        err_terms.append(f"CASE WHEN coalesce({x} < {lo} OR {x} > {hi}, false) THEN 1 ELSE 0 END")
    g_lo, g_hi = er["glucose"]
    return f"""
WITH t AS (SELECT patient_id, glucose, ({' + '.join(err_terms)}) AS n_err, ({' + '.join(warn_terms)}) AS n_warn FROM patients_v),
a AS (SELECT *, CASE WHEN n_err > 0 THEN 'HIGH' ELSE 'NONE' END AS threat_level FROM t),
b AS (SELECT *, CASE WHEN threat_level = 'CRITICAL' THEN 'block' WHEN threat_level = 'HIGH' THEN 'sanitize'
                     WHEN n_warn > 0 THEN 'warn' ELSE 'allow' END AS action FROM a)
SELECT patient_id, threat_level, action, action <> 'block' AS is_safe, CAST(n_warn AS INTEGER) AS warning_count,
       CASE WHEN action <> 'block' THEN least(greatest(CAST(glucose AS DOUBLE), {float(g_lo)}), {float(g_hi)}) ELSE {(g_lo + g_hi) / 2.0} END AS glucose
FROM b"""


@register("protect_batch", dbl=["glucose"], sql=_protect_sql())
def q_protect_batch(spark, sf):
    p = PR.protect_batch(patients(spark, sf).select("patient_id", *_CL_FIELDS), _CL_FIELDS)
    return p.select("patient_id", "threat_level", "action", "is_safe", "warning_count", "glucose")


def _doc_protected(spark, sf):
    d = PR.detect_injection(table(spark, sf, "documents").select("doc_id", "text"), ["text"])
    return d.select("doc_id", F.col("injection_level").alias("threat_level"),
                    PR.resolve_action(F.col("injection_level"), F.col("n_warnings")).alias("action"),
                    F.col("signatures").alias("all_signatures"))


_DOC_PROT = _inj_sql("documents", "doc_id", "text")


@register("threat_summary", dbl=["block_rate"], sql=f"""
WITH p AS ({_DOC_PROT}),
q AS (SELECT *, CASE WHEN injection_level = 'CRITICAL' THEN 'block' WHEN injection_level = 'HIGH' THEN 'sanitize'
                     WHEN injection_level = 'MEDIUM' OR n_warnings > 0 THEN 'warn' ELSE 'allow' END AS action FROM p),
s AS (SELECT count(*) AS total, count_if(action = 'block') AS blocked, count_if(action = 'sanitize') AS sanitized,
             count_if(action = 'warn') AS warned FROM q),
g AS (SELECT sig, count(*) AS n FROM (SELECT unnest(signatures) AS sig FROM q) u GROUP BY sig ORDER BY n DESC, sig LIMIT 10),
t AS (SELECT list_transform(list_sort(list({{'k': -n, 's': sig, 'n': n}})), lambda x: {{'signature': x.s, 'n': x.n}}) AS top_signatures FROM g)
SELECT s.*, CAST(blocked AS DOUBLE) / total AS block_rate, t.top_signatures FROM s, t""")
def q_threat_summary(spark, sf):
    return PR.threat_summary(_doc_protected(spark, sf))


@register("security_audit_rows", sql=f"""
SELECT doc_id, injection_level AS threat_level, 'block' AS action, signatures AS all_signatures
FROM ({_DOC_PROT}) p WHERE injection_level IN ('HIGH', 'CRITICAL')""")
def q_security_audit_rows(spark, sf):
    p = _doc_protected(spark, sf)
    return p.where(F.col("threat_level").isin("HIGH", "CRITICAL")).select("doc_id", "threat_level", "action", "all_signatures")


@register("mahalanobis_outliers")
def q_mahalanobis_outliers(spark, sf):
    p = patients(spark, sf).select("patient_id", "glucose", "bmi", "insulin", "age")
    fit = RB.mahalanobis_fit(p, ["glucose", "bmi", "insulin", "age"])
    return RB.mahalanobis_outliers(p, fit).select("patient_id", "anomaly_score", "is_adversarial")


# ---------------------------------------------------------------- privacy
_SALT = "query salt"


@register("hash_pii")
def q_hash_pii(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return PV.hash_pii_df(d, "text", _SALT)


@register("pii_counts", sql="SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, {_lit(p)})) AS INTEGER) AS n_{n}" for n, p in PV.PII_PATTERNS) + " FROM documents")
def q_pii_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *PV.pii_counts(F.col("text")))


def _redact_sql(col):
    out = col
    for _, p in PV.PII_PATTERNS:
        out = f"regexp_replace({out}, {_lit(p)}, '[REDACTED]', 'g')"
    return out


@register("redact_pii", sql=f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def q_redact_pii(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return PV.redact_pii_df(d, "text")


@register("mask_sensitive_fields", sql="""
SELECT CASE WHEN length(patient_id) > 8 THEN '****' || right(patient_id, 4) ELSE '****' END AS patient_id,
       CASE WHEN length(CAST(k AS VARCHAR)) > 4 THEN '****' || right(CAST(k AS VARCHAR), 4) ELSE '****' END AS zip_code,
       gender FROM patients_v""")
def q_mask_sensitive_fields(spark, sf):
    p = patients(spark, sf).select("patient_id", F.col("k").alias("zip_code"), "gender")
    return PV.mask_sensitive_fields(p)


@register("redact_secrets", sql="SELECT page_id, CASE WHEN url IS NOT NULL THEN '[REDACTED]' END AS password, length(html) AS n FROM pages")
def q_redact_secrets(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("password"), F.length("html").cast("bigint").alias("n"))
    return PV.redact_secrets(p)


_CONTACT = [
    "lower(replace(c_name, '#', '.')) || '@example.com' AS email",
    "CASE WHEN c_custkey % 4 = 0 THEN 'ab@x.org' ELSE lower(c_mktsegment) || '@mail.example' END AS email2",
    "'(' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ') 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone",
    "lpad(CAST(c_custkey * 7919 AS VARCHAR), 16, '4') AS credit_card",
    "lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ssn",
]


def _contacts(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", *[c.replace("VARCHAR", "STRING") for c in _CONTACT])


def _mask_email_sql(c):
    loc = f"split_part({c}, '@', 1)"
    return (f"CASE WHEN NOT contains({c}, '@') THEN {c} WHEN length({loc}) <= 3 THEN {loc} || '@*******' "
            f"ELSE substr({loc}, 1, 2) || '****@' || substr({c}, instr({c}, '@') + 1) END")


def _digits_sql(c):
    return f"regexp_replace({c}, '\\D', '', 'g')"


def _mask_sql():
    d = _digits_sql
    return (f"{_mask_email_sql('email')} AS email, {_mask_email_sql('email2')} AS email2, "
            f"CASE WHEN length({d('phone')}) <= 4 THEN phone ELSE substr({d('phone')}, 1, 2) || '****' || right({d('phone')}, 4) END AS phone, "
            f"CASE WHEN length({d('credit_card')}) <= 4 THEN credit_card ELSE '****' || right({d('credit_card')}, 4) END AS credit_card, "
            f"CASE WHEN length({d('ssn')}) <> 9 THEN ssn ELSE '***-**-' || right({d('ssn')}, 4) END AS ssn")


@register("mask_fields", sql=f"SELECT c_custkey, {_mask_sql()} FROM (SELECT c_custkey, {', '.join(_CONTACT)} FROM customer) t")
def q_mask_fields(spark, sf):
    c = _contacts(spark, sf)
    return c.select("c_custkey", PV.mask_email(F.col("email")).alias("email"), PV.mask_email(F.col("email2")).alias("email2"),
                    PV.mask_phone(F.col("phone")).alias("phone"), PV.mask_card(F.col("credit_card")).alias("credit_card"),
                    PV.mask_ssn(F.col("ssn")).alias("ssn"))


@register("anonymize_columns", sql=f"""
SELECT c_custkey, {_mask_email_sql('email')} AS email, email2,
       CASE WHEN length({_digits_sql('phone')}) <= 4 THEN phone ELSE substr({_digits_sql('phone')}, 1, 2) || '****' || right({_digits_sql('phone')}, 4) END AS phone,
       CASE WHEN length({_digits_sql('credit_card')}) <= 4 THEN credit_card ELSE '****' || right({_digits_sql('credit_card')}, 4) END AS credit_card,
       CASE WHEN length({_digits_sql('ssn')}) <> 9 THEN ssn ELSE '***-**-' || right({_digits_sql('ssn')}, 4) END AS ssn
FROM (SELECT c_custkey, {', '.join(_CONTACT)} FROM customer) t""")
def q_anonymize_columns(spark, sf):
    return PV.anonymize_columns(_contacts(spark, sf))


_KEY = "0123456789abcdef0123456789abcdef"
_KEY2 = "fedcba9876543210fedcba9876543210"


@register("encrypt_roundtrip", sql="SELECT count(*) AS n, count(*) AS n_equal FROM customer")
def q_encrypt_roundtrip(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    enc = PV.encrypt_columns(c.withColumn("secret", F.col("c_name")), ["secret"], _KEY, aad="sparkclin")
    dec = PV.decrypt_columns(enc, ["secret"], _KEY, aad="sparkclin")
    return dec.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("secret") == F.col("c_name")).alias("n_equal"))


@register("rotate_encrypted_columns", sql="SELECT count(*) AS n, count(*) AS n_equal FROM customer")
def q_rotate_encrypted_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    enc = PV.encrypt_columns(c.withColumn("secret", F.col("c_name")), ["secret"], _KEY)
    rot = PV.rotate_encrypted_columns(enc, ["secret"], _KEY, _KEY2)
    dec = PV.decrypt_columns(rot, ["secret"], _KEY2)
    return dec.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("secret") == F.col("c_name")).alias("n_equal"))


@register("sanitize_nested")
def q_sanitize_nested(spark, sf):
    c = table(spark, sf, "customer")
    nested = c.select("c_custkey", F.struct(F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"),
                                            F.array(F.concat(F.col("c_name"), F.lit(" wrote to john.doe@example.com")))
                                            .alias("notes")).alias("patient"),
                      F.create_map(F.lit("email"), F.lit("a.b@example.com"), F.lit("city"), F.col("c_mktsegment")).alias("meta"))
    return PV.sanitize_nested(nested, _SALT)
