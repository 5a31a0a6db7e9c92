"""Input protection for batches and streams.

Every check is a column expression over the row (type coercion, range
clamps, 31 compiled regex flags, in-row z-scores), combined into one
projection; the batch never leaves the JVM except for the optional
Mahalanobis fit, whose d×d constants are tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import q, with_constants
from sparkclin.operators.quality import CLINICAL_RANGES, EXPECTED_RANGES

# Fixed values that must equal the reference: injection patterns (pattern, type, severity), in order.
INJECTION_PATTERNS = [
    (r"SELECT\s+.*\s+FROM", "sql_injection", "CRITICAL"),
    (r"INSERT\s+INTO", "sql_injection", "CRITICAL"),
    (r"DROP\s+TABLE", "sql_injection", "CRITICAL"),
    (r"UNION\s+SELECT", "sql_injection", "CRITICAL"),
    (r"DELETE\s+FROM", "sql_injection", "CRITICAL"),
    (r"UPDATE\s+.*\s+SET", "sql_injection", "CRITICAL"),
    (r"OR\s+1\s*=\s*1", "sql_injection", "HIGH"),
    (r"OR\s+'1'\s*=\s*'1'", "sql_injection", "HIGH"),
    (r"';.*--", "sql_injection", "CRITICAL"),
    (r"<script>.*</script>", "xss", "HIGH"),
    (r"onerror\s*=", "xss", "HIGH"),
    (r"onload\s*=", "xss", "HIGH"),
    (r"javascript:", "xss", "HIGH"),
    (r"alert\s*\(", "xss", "MEDIUM"),
    (r"eval\s*\(", "xss", "HIGH"),
    (r";\s*exec\s*", "command_injection", "CRITICAL"),
    (r";\s*ping\s*", "command_injection", "CRITICAL"),
    (r";\s*curl\s*", "command_injection", "CRITICAL"),
    (r"\$\{.*\}", "command_injection", "HIGH"),
    (r"`.*`", "command_injection", "HIGH"),
    (r"\|.*sh", "command_injection", "CRITICAL"),
    (r"\.\./", "path_traversal", "HIGH"),
    (r"\.\.\\", "path_traversal", "HIGH"),
    (r"/etc/passwd", "path_traversal", "CRITICAL"),
    (r"C:\\Windows", "path_traversal", "CRITICAL"),
    (r"NaN|Infinity|-Infinity", "data_poisoning", "HIGH"),
    (r"None|NULL|null", "data_poisoning", "MEDIUM"),
    (r"gopher://", "protocol_attack", "CRITICAL"),
    (r"file://", "protocol_attack", "HIGH"),
    (r"data://", "protocol_attack", "CRITICAL"),
    (r"http://.*\?", "protocol_attack", "LOW"),
]
# For each pattern above (same order), lower-case literals of which at least one must occur in
# any text the pattern matches. They only gate the regex (a cheap ``contains`` before ``rlike``).
REQUIRED_LITERALS = [
    ["select"], ["insert"], ["drop"], ["union"], ["delete"], ["update"], ["="], ["'1'"], ["--"],
    ["<script>"], ["onerror"], ["onload"], ["javascript:"], ["alert"], ["eval"],
    ["exec"], ["ping"], ["curl"], ["${"], ["`"], ["|"],
    ["../"], ["..\\"], ["/etc/passwd"], ["c:\\windows"],
    ["nan", "infinity"], ["none", "null"],
    ["gopher://"], ["file://"], ["data://"], ["http://"],
]
# Characters removed by the sanitizer; suspicious user agents.
DANGEROUS_CHARS = "<>&'\";`$|"
SUSPICIOUS_AGENTS = ["curl", "wget", "python-requests", "scrapy", "nmap"]
LEVELS = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
BOOLEAN_FIELDS = ["exang", "fbs", "target", "smoking"]


def _lvl(name: str) -> Column:
    return F.lit(LEVELS.index(name))


def level_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), ordinal + 1)


def coerce_types(df: DataFrame, numeric: list[str], boolean: list[str] | None = None) -> DataFrame:
    """String inputs to their expected types; failures are errors (numeric → HIGH).

    Adds ``coerce_errors`` and ``coerce_warnings`` arrays and replaces the
    columns with their typed values (numeric wins for fields in both lists).
    """
    boolean = [b for b in (boolean or []) if b not in numeric]
    errs, warns, out = [], [], {}
    for c in numeric:
        s = F.col(q(c)).cast("string")
        v = F.trim(s).try_cast("double")
        out[c] = v
        errs.append(F.when(s.isNotNull() & v.isNull(), F.concat(F.lit(f"Invalid numeric value for {c}: "), s)))
        warns.append(F.when(s.isNull(), F.lit(f"Null value for {c}")))
    for c in boolean:
        s = F.lower(F.col(q(c)).cast("string"))
        v = F.when(s.isin("true", "1", "yes"), True).when(s.isin("false", "0", "no"), False)
        out[c] = v
        errs.append(F.when(s.isNotNull() & v.isNull(), F.concat(F.lit(f"Invalid boolean value for {c}: "), s)))
    notnull = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return df.select(*[out.get(c, F.col(q(c))).alias(c) for c in df.columns],
                     notnull(errs).alias("coerce_errors"), notnull(warns).alias("coerce_warnings"))


def clamp_ranges(df: DataFrame, fields: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Outside the clinical range → error (HIGH); inside it, values beyond the expected
    range are clamped to it with a warning. Out-of-range values are clamped to the clinical
    range when the action is sanitize (the reference leaves them; see SURVEY §9 #12)."""
    cr = {f: (lo, hi) for f, lo, hi in CLINICAL_RANGES}
    er = {f: (lo, hi) for f, lo, hi in EXPECTED_RANGES}
    fields = [f for f in (fields or list(cr)) if f in df.columns and f in cr]
    errs, warns, rep = [], [], {}
    for f in fields:
        x = F.col(q(f)).cast("double")
        lo, hi = cr[f]
        bad = (x < lo) | (x > hi)
        errs.append(F.when(bad, F.concat(F.lit(f"{f} value "), x.cast("string"), F.lit(f" outside clinical range [{lo}, {hi}]"))))
        val = F.when(bad, F.lit(None).cast("double") if strict else F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))
        if f in er:
            elo, ehi = er[f]
            warns.append(F.when(~bad & (x < elo), F.lit(f"{f} below expected range [{elo}, {ehi}], clamped")))
            warns.append(F.when(~bad & (x > ehi), F.lit(f"{f} above expected range [{elo}, {ehi}], clamped")))
            val = val.otherwise(F.least(F.greatest(x, F.lit(float(elo))), F.lit(float(ehi))))
        else:
            val = val.otherwise(x)
        rep[f] = val
    nn = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return df.select(*[rep.get(c, F.col(q(c))).alias(c) for c in df.columns],
                     nn(errs).alias("range_errors"), nn(warns).alias("range_warnings"))


def with_injection_flags(df: DataFrame, text_cols: list[str], patterns=INJECTION_PATTERNS) -> DataFrame:
    """C3 flags: one boolean column per (text column, pattern), then the hit array.

    The lower-cased text is computed once in its own projection (referenced
    by every gate, so the optimizer keeps it materialised), each pattern is a
    literal ``rlike`` behind a cheap ``contains`` gate, and the hit array is
    assembled from the plain boolean columns afterwards.
    """
    gates = REQUIRED_LITERALS if patterns is INJECTION_PATTERNS else [None] * len(patterns)
    low = {c: f"__low_{i}" for i, c in enumerate(text_cols)}
    x = df.select("*", *[F.lower(F.col(q(c))).alias(low[c]) for c in text_cols])
    flags, meta = [], []
    for ci, c in enumerate(text_cols):
        for pi, ((pat, typ, sev), lits) in enumerate(zip(patterns, gates)):
            hit = F.col(q(c)).rlike("(?i)" + pat)
            if lits:
                gate = None
                for lit in lits:
                    g = F.col(low[c]).contains(lit)
                    gate = g if gate is None else gate | g
                hit = F.when(gate, hit).otherwise(F.lit(False))
            name = f"__f_{ci}_{pi}"
            flags.append(F.coalesce(hit, F.lit(False)).alias(name))
            meta.append((name, c, typ, sev))
    x = x.select(*df.columns, *flags)
    items = [F.when(F.col(n), F.struct(F.lit(c).alias("field"), F.lit(t).alias("type"), F.lit(s).alias("severity")))
             for n, c, t, s in meta]
    return x.select(*df.columns, F.filter(F.array(*items), lambda v: v.isNotNull()).alias("injection_hits"))


def injection_hits(text_cols: list[str], patterns=INJECTION_PATTERNS) -> Column:
    """C3 as a single column expression (for callers composing their own projection)."""
    items = []
    for c in text_cols:
        for pat, typ, sev in patterns:
            items.append(F.when(F.coalesce(F.col(q(c)).rlike("(?i)" + pat), F.lit(False)),
                                F.struct(F.lit(c).alias("field"), F.lit(typ).alias("type"), F.lit(sev).alias("severity"))))
    return F.array_compact(F.array(*items))


def detect_injection(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Hits, signatures (type:field), level (CRITICAL when any CRITICAL/HIGH hit),
    warning count (MEDIUM / LOW hits only warn)."""
    x = with_injection_flags(df, text_cols)
    h = F.col("injection_hits")
    hard = F.exists(h, lambda s: s["severity"].isin("CRITICAL", "HIGH"))
    return x.select("*", F.transform(h, lambda s: F.concat(s["type"], F.lit(":"), s["field"])).alias("signatures"),
                    F.when(hard, "CRITICAL").when(F.size(h) > 0, "MEDIUM").otherwise("NONE").alias("injection_level"),
                    F.size(F.filter(h, lambda s: ~s["severity"].isin("CRITICAL", "HIGH"))).alias("n_warnings"))


def sanitize_text(col: Column) -> Column:
    """C4: drop < > & ' " ; ` $ |."""
    return F.translate(col, DANGEROUS_CHARS, "")


def row_zscore(df: DataFrame, fields: list[str], threshold: float = 3.0) -> DataFrame:
    """Z-score of each present numeric value within its own row (population std)."""
    arr = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.col(q(f)).cast("double").alias("v")) for f in fields]),
                   lambda s: s["v"].isNotNull())
    x = df.withColumn("__a", arr)
    n = F.size("__a")
    mean = F.aggregate("__a", F.lit(0.0), lambda acc, s: acc + s["v"]) / n
    x = x.withColumn("__m", mean)
    var = F.aggregate("__a", F.lit(0.0), lambda acc, s: acc + (s["v"] - F.col("__m")) * (s["v"] - F.col("__m"))) / n
    x = x.withColumn("__sd", F.sqrt(var))
    z = F.transform("__a", lambda s: F.struct(s["f"].alias("f"), F.when(F.col("__sd") > 0, F.abs(s["v"] - F.col("__m")) / F.col("__sd"))
                                              .otherwise(F.lit(0.0)).alias("z")))
    x = x.withColumn("row_z", z)
    return x.select("*", F.transform(F.filter("row_z", lambda s: s["z"] > threshold), lambda s: F.concat(F.lit("anomaly:"), s["f"]))
                    .alias("anomaly_signatures"), F.array_max(F.transform("row_z", lambda s: s["z"])).alias("max_row_z")) \
        .drop("__a", "__m", "__sd")


def context_checks(ip: Column, request_count: Column, user_agent: Column, max_requests: int = 1000) -> Column:
    """struct(external_ip, rate_exceeded, suspicious_agent)."""
    ext = ~(ip.startswith("192.168.") | ip.startswith("10."))
    sus = F.exists(F.array(*[F.lit(a) for a in SUSPICIOUS_AGENTS]), lambda a: F.lower(user_agent).contains(a))
    return F.struct(F.coalesce(ext, F.lit(False)).alias("external_ip"),
                    F.coalesce(request_count > max_requests, F.lit(False)).alias("rate_exceeded"),
                    F.coalesce(sus, F.lit(False)).alias("suspicious_agent"))


def resolve_action(level: Column, n_warnings: Column, block_on_high: bool = False) -> Column:
    """CRITICAL → block; HIGH → block if configured else sanitize; MEDIUM or warnings → warn; else allow."""
    return (F.when(level == "CRITICAL", "block")
            .when(level == "HIGH", "block" if block_on_high else "sanitize")
            .when((level == "MEDIUM") | (n_warnings > 0), "warn").otherwise("allow"))


def protect_batch(df: DataFrame, numeric: list[str], text_cols: list[str] | None = None,
                  strict: bool = False) -> DataFrame:
    """C1 → C2 → C3/C4 → C5 → C7 per row; blocked rows get the mid-points of the
    expected (else clinical) ranges; sanitized text drops the dangerous characters."""
    text_cols = text_cols or []
    x = coerce_types(df, numeric)
    x = clamp_ranges(x, numeric, strict=strict)
    if text_cols:
        x = detect_injection(x, text_cols)
    else:
        x = x.withColumn("signatures", F.array().cast("array<string>")).withColumn("injection_level", F.lit("NONE")) \
             .withColumn("n_warnings", F.lit(0))
    x = row_zscore(x, [c for c in numeric])
    lvl = F.greatest(F.when(F.size("coerce_errors") > 0, _lvl("HIGH")).otherwise(_lvl("NONE")),
                     F.when(F.size("range_errors") > 0, _lvl("HIGH")).otherwise(_lvl("NONE")),
                     F.when(F.col("injection_level") == "CRITICAL", _lvl("CRITICAL")).otherwise(_lvl("NONE")))
    warn_n = (F.size("coerce_warnings") + F.size("range_warnings") + F.col("n_warnings") + F.size("anomaly_signatures"))
    x = x.withColumn("threat_level", level_name(lvl)).withColumn("warning_count", warn_n)
    x = x.withColumn("action", resolve_action(F.col("threat_level"), F.col("warning_count"), block_on_high=strict))
    x = x.withColumn("is_safe", F.col("action") != "block")
    cr = {f: (lo, hi) for f, lo, hi in CLINICAL_RANGES}
    er = {f: (lo, hi) for f, lo, hi in EXPECTED_RANGES}
    for f in numeric:
        lo, hi = er.get(f, cr.get(f, (None, None)))
        if lo is not None:
            x = x.withColumn(f, F.when(F.col("is_safe"), F.col(q(f))).otherwise(F.lit((lo + hi) / 2.0)))
    for c in text_cols:
        x = x.withColumn(c, F.when(F.size("injection_hits") > 0, sanitize_text(F.col(q(c)))).otherwise(F.col(q(c))))
    return x.withColumn("all_signatures", F.concat("signatures", "anomaly_signatures"))


def threat_summary(protected: DataFrame, top: int = 10) -> DataFrame:
    """Totals, blocked / sanitized / warned, block rate, top-10 signatures (count desc, name).

    One scan: signatures are pos-exploded (position 0 or NULL marks the
    row itself) and a single ``rollup(signature)`` yields both the per
    signature counts and the grand totals; the two consumers of that
    aggregate share its exchange.
    """
    x = protected.select("action", F.posexplode_outer("all_signatures").alias("__pos", "signature"))
    first = F.col("__pos").isNull() | (F.col("__pos") == 0)
    r = x.rollup("signature").agg(
        F.grouping_id().alias("__g"), F.count_if(F.col("signature").isNotNull()).alias("n"),
        F.count_if(first).alias("total"), F.count_if(first & (F.col("action") == "block")).alias("blocked"),
        F.count_if(first & (F.col("action") == "sanitize")).alias("sanitized"),
        F.count_if(first & (F.col("action") == "warn")).alias("warned"))
    s = r.where(F.col("__g") == 1).select("total", "blocked", "sanitized", "warned",
                                          (F.col("blocked") / F.col("total")).alias("block_rate"))
    sig = (r.where((F.col("__g") == 0) & F.col("signature").isNotNull()).select("signature", "n")
           .orderBy(F.col("n").desc(), "signature").limit(top))
    tops = sig.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("signature").alias("s"),
                                                                   F.col("n").alias("n")))),
                               lambda v: F.struct(v["s"].alias("signature"), v["n"].alias("n"))).alias("top_signatures"))
    return s.crossJoin(tops)


def security_audit_rows(protected: DataFrame, id_cols: list[str]) -> DataFrame:
    """C11: HIGH / CRITICAL rows with their signatures, errors and warnings."""
    return protected.where(F.col("threat_level").isin("HIGH", "CRITICAL")).select(
        *id_cols, "threat_level", "action", "all_signatures", "coerce_errors", "range_errors", "range_warnings")


def attach(df: DataFrame, consts: DataFrame) -> DataFrame:
    return with_constants(df, consts)
