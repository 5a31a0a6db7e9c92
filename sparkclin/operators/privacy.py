"""PII hashing / redaction, field masking, nested sanitising, column encryption.

All of it is built-in string, regex, hash and AES expressions, so masking a
table is a map-only stage; nested values are rebuilt with ``transform`` /
``transform_values`` / struct reconstruction from the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclin.functions.exprs import q

# Fixed values that must equal the reference: PII patterns in application order.
PII_PATTERNS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("address", r"\d{1,5}\s+[A-Za-z]+\s+[A-Za-z]+"),
    ("id", r"ID-\d{6,10}"),
    ("name", r"[A-Z][a-z]+\s+[A-Z][a-z]+"),
    ("medical_record", r"MRN-\d{6,10}"),
]
# A literal each pattern cannot match without (case-sensitive, like the patterns): the regex only
# runs on texts that contain it.
PII_GATES = {"email": "@", "ssn": "-", "id": "ID-", "medical_record": "MRN-"}
# Field names masked wherever they occur (any case); secret keys.
SENSITIVE_FIELDS = ["patient_id", "patient_name", "ssn", "address", "email", "phone", "medical_record_number",
                    "date_of_birth", "zip_code", "full_name"]
SECRET_KEYS = ["Authorization", "access_token", "password"]


def _let(c: Column, fn) -> Column:
    """Evaluate ``c`` once and pass it to ``fn`` (a one-element ``transform`` binds it to a variable)."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def hash_pii(text: Column, salt: str, patterns=PII_PATTERNS) -> Column:
    """For each pattern in order, every distinct match → [TYPE_<8 hex of sha256(match+salt)>].

    Column form (for nested values); each step's input is bound once, so the
    expression grows linearly with the number of patterns. Tables use
    ``hash_pii_df`` (one projection per pattern).
    """
    out = text
    for name, pat in patterns:
        out = _let(out, _hash_step(name, pat, salt, patterns is PII_PATTERNS))
    return out


def _replacer(tag: str, salt: str):
    def step(acc, m):
        token = F.concat(F.lit(f"[{tag}_"), F.substring(F.sha2(F.concat(m, F.lit(salt)), 256), 1, 8), F.lit("]"))
        return F.replace(acc, m, token)
    return step


def redact_pii(text: Column, patterns=PII_PATTERNS) -> Column:
    """Every match of every pattern (in order) → [REDACTED] (column form; tables use ``redact_pii_df``)."""
    out = text
    for name, pat in patterns:
        out = _let(out, _redact_step(name, pat, patterns is PII_PATTERNS))
    return out


def _hash_step(name: str, pat: str, salt: str, gated: bool):
    def step(c: Column) -> Column:
        matches = F.array_distinct(F.regexp_extract_all(c, F.lit(pat), 0))
        body = F.aggregate(matches, c, _replacer(name.upper(), salt))
        gate = PII_GATES.get(name) if gated else None
        return F.when(F.instr(c, gate) > 0, body).otherwise(c) if gate else body
    return step


def _redact_step(name: str, pat: str, gated: bool):
    def step(c: Column) -> Column:
        body = F.regexp_replace(c, pat, "[REDACTED]")
        gate = PII_GATES.get(name) if gated else None
        return F.when(F.instr(c, gate) > 0, body).otherwise(c) if gate else body
    return step


def _chain(df: DataFrame, col: str, steps, out_col: str | None) -> DataFrame:
    """Apply column steps as successive projections: each intermediate text is computed once."""
    tmp = "__pii_text"
    x = df.withColumn(tmp, F.col(q(col)))
    for st in steps:
        x = x.withColumn(tmp, st(F.col(tmp)))
    return x.withColumn(out_col or col, F.col(tmp)).drop(tmp)


def hash_pii_df(df: DataFrame, col: str, salt: str, out_col: str | None = None,
                patterns=PII_PATTERNS) -> DataFrame:
    """C12 on a table column, one projection per pattern (gated by a required literal)."""
    return _chain(df, col, [_hash_step(n, p, salt, patterns is PII_PATTERNS) for n, p in patterns], out_col)


def redact_pii_df(df: DataFrame, col: str, out_col: str | None = None, patterns=PII_PATTERNS) -> DataFrame:
    """C13 on a table column, one projection per pattern (gated by a required literal)."""
    return _chain(df, col, [_redact_step(n, p, patterns is PII_PATTERNS) for n, p in patterns], out_col)


def pii_counts(text: Column, patterns=PII_PATTERNS) -> list[Column]:
    """Matches per pattern on the original text (the countable part of C12)."""
    return [F.size(F.regexp_extract_all(text, F.lit(p), 0)).alias(f"n_{n}") for n, p in patterns]


def mask_value(col: Column, dtype: T.DataType) -> Column:
    """C14: strings longer than 8 → ****+last 4, numbers whose text is longer than 4 → ****+last 4, else ****."""
    s = col.cast("string")
    limit = 8 if isinstance(dtype, T.StringType) else 4
    return F.when(col.isNull(), F.lit(None).cast("string")).when(
        F.length(s) > limit, F.concat(F.lit("****"), F.substring(s, -4, 4))).otherwise(F.lit("****"))


def mask_sensitive_fields(df: DataFrame, fields=SENSITIVE_FIELDS) -> DataFrame:
    """C14 on top-level columns named in the list."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    names = {f.lower() for f in fields}
    return df.select(*[mask_value(F.col(q(c)), types[c]).alias(c) if c.lower() in names else F.col(q(c))
                       for c in df.columns])


def _sanitize_expr(col: Column, dtype: T.DataType, name: str | None, fields, salt) -> Column:
    if name is not None and name.lower() in fields:
        if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            return F.when(col.isNotNull(), F.lit("****"))
        return mask_value(col, dtype)
    if isinstance(dtype, T.StringType):
        return hash_pii(col, salt)
    if isinstance(dtype, T.StructType):
        return F.when(col.isNull(), F.lit(None)).otherwise(F.struct(*[
            _sanitize_expr(col[f.name], f.dataType, f.name, fields, salt).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _sanitize_expr(x, dtype.elementType, None, fields, salt))
    if isinstance(dtype, T.MapType):
        vt = dtype.valueType
        if isinstance(vt, T.StringType):
            return F.transform_values(
                col, lambda k, v: F.when(F.lower(k).isin(*fields), mask_value(v, vt)).otherwise(hash_pii(v, salt)))
        # A map holds one value type, so a sensitive key's nested value becomes null and a number stays a string.
        nested = isinstance(vt, (T.StructType, T.ArrayType, T.MapType))
        if nested:
            return F.transform_values(col, lambda k, v: F.when(
                ~F.lower(k).isin(*fields), _sanitize_expr(v, vt, None, fields, salt)))
        return F.transform_values(col, lambda k, v: F.when(F.lower(k).isin(*fields), mask_value(v, vt))
                                  .otherwise(v.cast("string")))
    return col


def sanitize_nested(df: DataFrame, salt: str, fields=SENSITIVE_FIELDS) -> DataFrame:
    """Walk the schema; mask sensitive field names (any case; a struct, array or map becomes ****), hash PII
    inside every string, recursing through structs, arrays and maps."""
    fields = {f.lower() for f in fields}
    return df.select(*[_sanitize_expr(F.col(q(f.name)), f.dataType, f.name, fields, salt).alias(f.name)
                       for f in df.schema.fields])


def redact_secrets(df: DataFrame, keys=SECRET_KEYS, map_cols: list[str] | None = None) -> DataFrame:
    """Secret columns, and secret keys inside map columns, → [REDACTED]."""
    out = df.select(*[F.when(F.col(q(c)).isNotNull(), F.lit("[REDACTED]")).alias(c) if c in keys else F.col(q(c))
                      for c in df.columns])
    for m in map_cols or []:
        out = out.withColumn(m, F.transform_values(m, lambda k, v: F.when(k.isin(*keys), F.lit("[REDACTED]")).otherwise(v)))
    return out


def mask_email(c: Column) -> Column:
    """C17: local ≤ 3 → local@*******, else first two + ****@domain; no @ → unchanged."""
    local = F.substring_index(c, "@", 1)
    domain = F.substring(c, F.instr(c, "@") + 1, 1 << 30)
    return (F.when(~c.contains("@"), c).when(F.length(local) <= 3, F.concat(local, F.lit("@*******")))
            .otherwise(F.concat(F.substring(local, 1, 2), F.lit("****@"), domain)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def mask_phone(c: Column) -> Column:
    d = _digits(c)
    return F.when(F.length(d) <= 4, c).otherwise(F.concat(F.substring(d, 1, 2), F.lit("****"), F.substring(d, -4, 4)))


def mask_card(c: Column) -> Column:
    d = _digits(c)
    return F.when(F.length(d) <= 4, c).otherwise(F.concat(F.lit("****"), F.substring(d, -4, 4)))


def mask_ssn(c: Column) -> Column:
    d = _digits(c)
    return F.when(F.length(d) != 9, c).otherwise(F.concat(F.lit("***-**-"), F.substring(d, -4, 4)))


def mask_custom(c: Column, pattern: str, replacement: str = "****") -> Column:
    return F.regexp_replace(c, pattern, replacement)


def anonymize_columns(df: DataFrame) -> DataFrame:
    """Pick the masker by column name (email, phone, ssn, any name containing 'card')."""
    def pick(name):
        low = name.lower()
        if low == "email":
            return mask_email
        if low == "phone":
            return mask_phone
        if low == "ssn":
            return mask_ssn
        if "card" in low:
            return mask_card
        return None
    return df.select(*[(pick(c)(F.col(q(c)).cast("string")).alias(c) if pick(c) else F.col(q(c))) for c in df.columns])


def encrypt_columns(df: DataFrame, cols: list[str], key: str, aad: str | None = None) -> DataFrame:
    """AES-256-GCM (random 12-byte IV inside the output), base64 text."""
    k = F.lit(key)
    def enc(c):
        x = F.col(q(c)).cast("string")
        e = F.aes_encrypt(x, k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit(aad or ""))
        return F.base64(e)
    return df.select(*[enc(c).alias(c) if c in cols else F.col(q(c)) for c in df.columns])


def decrypt_columns(df: DataFrame, cols: list[str], key: str, aad: str | None = None, safe: bool = False) -> DataFrame:
    k = F.lit(key)
    fn = F.try_aes_decrypt if safe else F.aes_decrypt
    def dec(c):
        return fn(F.unbase64(F.col(q(c))), k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad or "")).cast("string")
    return df.select(*[dec(c).alias(c) if c in cols else F.col(q(c)) for c in df.columns])


def rotate_encrypted_columns(df: DataFrame, cols: list[str], old_key: str, new_key: str) -> DataFrame:
    """C20: decrypt with the old key, encrypt with the new one; rows that fail keep their value."""
    out = []
    for c in df.columns:
        if c in cols:
            plain = F.try_aes_decrypt(F.unbase64(F.col(q(c))), F.lit(old_key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""))
            new = F.base64(F.aes_encrypt(plain, F.lit(new_key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit("")))
            out.append(F.when(plain.isNotNull(), new).otherwise(F.col(q(c))).alias(c))
        else:
            out.append(F.col(q(c)))
    return df.select(*out)
