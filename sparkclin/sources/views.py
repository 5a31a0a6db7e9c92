"""Stand-in views over the driver tables (FIXTURES.md section 4).

Each view is one projection list shared by both engines: Spark builds it
with ``selectExpr`` over a pruned parquet scan, and the DuckDB oracle gets
the same expressions as a ``WITH`` clause (``oracle_with``). Keeping one
source of truth is what makes the oracle comparison meaningful.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkclin.sources.io import table

# view name -> (source relation, projection list)
PATIENTS_COLS = [
    ("concat('P', lpad(CAST(o_orderkey AS STRING), 9, '0'))", "patient_id"),
    ("o_orderkey", "k"),
    ("o_orderdate", "visit_ts"),
    ("CAST(20 + (o_orderkey * 7 + o_custkey) % 61 AS INT)", "age"),
    ("CAST(o_custkey % 2 AS INT)", "sex"),
    ("CASE o_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END", "gender"),
    ("CAST((o_orderkey * 3 + o_custkey * 5) % 11 AS INT)", "pregnancies"),
    ("CASE WHEN o_orderkey % 29 <> 0 THEN CAST(60 + (o_custkey * 13 + o_orderkey * 17) % 141 AS DOUBLE) END", "glucose"),
    ("CASE WHEN o_orderkey % 37 <> 0 THEN CAST(60 + (o_orderkey * 11) % 81 AS DOUBLE) END", "blood_pressure"),
    ("CAST(10 + (o_custkey * 3) % 51 AS DOUBLE)", "skin_thickness"),
    ("CAST((o_orderkey * 19 + o_custkey) % 401 AS DOUBLE)", "insulin"),
    ("CAST(150 + (o_orderkey * 23 + o_custkey * 7) % 301 AS DOUBLE) / CAST(10 AS DOUBLE)", "bmi"),
    ("CAST(10 + (o_orderkey * 31) % 191 AS DOUBLE) / CAST(100 AS DOUBLE)", "diabetes_pedigree"),
    ("o_custkey", "entity_id"),
]

YPROB_EXPR = ("round(1 / (1 + exp(-(CAST(0.03 AS DOUBLE) * (coalesce(glucose, 126) - 126) "
              "+ CAST(0.08 AS DOUBLE) * (bmi - 30) + CAST(0.02 AS DOUBLE) * (age - 45)))), 4)")

SCORED_COLS = [
    ("CAST(CASE WHEN y_prob > 0.5 THEN 1 ELSE 0 END AS INT)", "y_pred"),
    ("CAST(CASE WHEN y_prob * 100 + ((k * 29) % 41 - 20) >= 50 THEN 1 ELSE 0 END AS INT)", "y_true"),
    ("CASE WHEN k % 2 = 0 THEN 'reference' ELSE 'current' END", "sample"),
    ("CASE WHEN k % 5 = 0 THEN 'canary' ELSE 'production' END", "track"),
    ("CASE WHEN k % 3 = 0 THEN 'm1' WHEN k % 3 = 1 THEN 'm2' ELSE 'm3' END", "model"),
]

REQLOG_COLS = [
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("user_id", "user_id"),
    ("concat('/', event_type)", "endpoint"),
    ("CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT)", "status"),
    ("value * 10", "latency_ms"),
    ("CASE WHEN user_id % 5 = 0 THEN 'canary' ELSE 'production' END", "track"),
    ("props", "props"),
]

REVIEWS_COLS = [
    ("o_orderkey", "review_id"),
    ("substr(o_orderpriority, 1, 1)", "priority_code"),
    ("CASE WHEN o_orderkey % 4 = 0 THEN 'pending' WHEN o_orderkey % 4 = 1 THEN 'rejected' ELSE 'approved' END", "status"),
    ("o_orderdate", "created_at"),
    ("CAST(1 + o_orderkey % 2880 AS BIGINT)", "review_minutes"),
]

RUNS_COLS = [
    ("c_custkey", "run_id"),
    ("DATE '2024-01-01' + CAST(c_custkey % 60 AS INT)", "run_date"),
    ("CAST((c_custkey * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE)", "drift_score"),
    ("c_mktsegment", "feature"),
    ("CAST(c_custkey % 7 AS INT)", "n_violations"),
]


def _proj(cols) -> list[str]:
    return [f"{e} AS {a}" for e, a in cols]


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_proj(PATIENTS_COLS))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).selectExpr("*", f"{YPROB_EXPR} AS y_prob")
    return p.selectExpr("*", *_proj(SCORED_COLS))


def reqlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_proj(REQLOG_COLS))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_proj(REVIEWS_COLS))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_proj(RUNS_COLS))


# ---------------------------------------------------------------- oracle side
_VIEW_SQL = {
    "patients_v": f"SELECT {', '.join(_proj(PATIENTS_COLS))} FROM orders",
    "scored_v": (f"SELECT s.*, {', '.join(_proj(SCORED_COLS))} FROM "
                 f"(SELECT p.*, {YPROB_EXPR} AS y_prob FROM patients_v p) s"),
    "reqlog_v": f"SELECT {', '.join(_proj(REQLOG_COLS))} FROM events",
    "reviews_v": f"SELECT {', '.join(_proj(REVIEWS_COLS))} FROM orders",
    "runs_v": f"SELECT {', '.join(_proj(RUNS_COLS))} FROM customer",
}
_DEPS = {"scored_v": ["patients_v"]}
_ORDER = ["patients_v", "scored_v", "reqlog_v", "reviews_v", "runs_v"]


def oracle_with(sql: str) -> str:
    """Prefix ``sql`` with the stand-in views it mentions, as CTEs."""
    needed = set()
    for v in _ORDER:
        if re.search(rf"\b{v}\b", sql):
            needed.add(v)
            needed.update(_DEPS.get(v, []))
    if not needed:
        return sql
    ctes = ", ".join(f"{v} AS ({_VIEW_SQL[v]})" for v in _ORDER if v in needed)
    body = sql.strip()
    if m := re.match(r"(?is)^with\s+recursive\s", body):
        return f"WITH RECURSIVE {ctes}, {body[m.end():].lstrip()}"
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes}, {body[4:].lstrip()}"
    return f"WITH {ctes} {body}"


def view_sql(name: str) -> str:
    return _VIEW_SQL[name]
