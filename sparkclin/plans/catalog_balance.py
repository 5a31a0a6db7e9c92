"""Registered queries for the exact k-NN join, oversampling (D20–D22) over ``scored_v`` and imputation."""

from __future__ import annotations

from sparkclin.operators import balance as B
from sparkclin.operators import neighbours as N
from sparkclin.operators import prep as P
from sparkclin.plans.registry import register
from sparkclin.session import stored
from sparkclin.sources.views import patients, scored

COLS = ["glucose", "bmi", "age"]


def _source(spark, sf):
    """Patients with medians for missing features."""
    s = scored(spark, sf).select("patient_id", "y_true", *COLS)
    return stored(P.impute_simple(s, COLS, "median"), "source")  # read many times: medians are found once


def _dist(a, b):
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in COLS) + ")"


def _h(key):
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


_BASE = f"""
WITH md AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in COLS)} FROM scored_v),
src AS (SELECT patient_id AS id, y_true, {', '.join(f'CAST(coalesce({c}, m_{c}) AS DOUBLE) AS {c}' for c in COLS)} FROM scored_v, md),
sz AS (SELECT y_true, count(*) AS n FROM src GROUP BY y_true),
c AS (SELECT arg_min(y_true, n) AS y, min(n) AS m, max(n) - min(n) AS need FROM sz),
own AS (SELECT src.* FROM src, c WHERE y_true = c.y),
near AS (SELECT a.id, b.id AS neighbour, {_dist('a', 'b')} AS distance,
                row_number() OVER (PARTITION BY a.id ORDER BY {_dist('a', 'b')}, b.id) AS rank
         FROM own a JOIN own b ON a.id <> b.id QUALIFY rank <= 5)"""


def _around(k):
    return f""",
around AS (SELECT a.id, b.y_true <> a.y_true AS other, row_number() OVER (PARTITION BY a.id ORDER BY {_dist('a', 'b')}, b.id) AS rank
           FROM own a JOIN src b ON a.id <> b.id QUALIFY rank <= {k}),
share AS (SELECT id, count(*) FILTER (other) AS others, count(*) AS n_near FROM around GROUP BY id)"""


def _even(rows):
    return f""",
ranked AS (SELECT id, row_number() OVER (ORDER BY {_h("id || '|42'")}, id) AS rk, count(*) OVER () AS nb FROM {rows}),
copies AS (SELECT id, need // nb + CAST(rk <= need % nb AS INTEGER) AS copies FROM ranked, c)"""


_MADE = f""",
made AS (SELECT id, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy FROM copies),
pick AS (SELECT id, copy, {_h("id || '|' || copy || '|42|n'")} % 5 + 1 AS rank, {_h("id || '|' || copy || '|42|g'")} / 4294967296.0 AS gap FROM made)
SELECT id, CAST(0 AS INTEGER) AS copy, {', '.join(COLS)}, y_true FROM src
UNION ALL
SELECT p.id, CAST(p.copy AS INTEGER), {', '.join(f'a.{x} + p.gap * (b.{x} - a.{x})' for x in COLS)}, a.y_true
FROM pick p JOIN near n ON n.id = p.id AND n.rank = p.rank JOIN own a ON a.id = p.id JOIN own b ON b.id = n.neighbour"""


@register("knn_neighbours", dbl=["distance"], sql=_BASE.split("sz AS")[0] + f"""
ids AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM src),
found AS (SELECT a.id, min(struct_pack(d := {_dist('a', 'b')}, i := b.i), 5) AS near FROM ids a JOIN ids b ON a.i <> b.i GROUP BY a.id),
flat AS (SELECT id, unnest(near) AS n, unnest(range(1, len(near) + 1)) AS rank FROM found)
SELECT flat.id, CAST(rank AS INTEGER) AS rank, ids.id AS neighbour, n.d AS distance FROM flat JOIN ids ON ids.i = n.i""")
def q_knn_neighbours(spark, sf):
    """Every patient's nearest patients, over all rows."""
    s = _source(spark, sf)
    return B.knn(s, s, "patient_id", COLS, 5)


def _run(spark, sf, method):
    return B.balance(_source(spark, sf), "y_true", COLS, "patient_id", method)


@register("balance_smote", dbl=COLS, sql=_BASE + _even("own") + _MADE)
def q_balance_smote(spark, sf):
    return _run(spark, sf, "smote")


@register("balance_adasyn", dbl=COLS, sql=_BASE + _around(5) + """,
copies AS (SELECT id, round_even(others * need / CAST((SELECT sum(others) FROM share) AS DOUBLE), 0) AS copies FROM share, c)""" + _MADE)
def q_balance_adasyn(spark, sf):
    return _run(spark, sf, "adasyn")


@register("balance_borderline", dbl=COLS, sql=_BASE + _around(10) + """,
danger AS (SELECT id FROM share WHERE 2 * others >= n_near AND others < n_near)""" + _even("danger") + _MADE)
def q_balance_borderline(spark, sf):
    return _run(spark, sf, "borderline")


_FIELDS = ["age", "glucose", "blood_pressure", "skin_thickness", "insulin", "bmi"]
_HOLES = ["glucose", "blood_pressure"]  # the only fields of the view that hold nulls


def _lend(c):
    """Means of field ``c`` over the five nearest rows that have it, for rows that don't."""
    both = [f"(CASE WHEN a.{x} IS NOT NULL AND b.{x} IS NOT NULL THEN 1 ELSE 0 END)" for x in _FIELDS]
    square = " + ".join(f"coalesce((a.{x} - b.{x}) * (a.{x} - b.{x}), 0)" for x in _FIELDS)
    return f"""(SELECT id, avg(v) AS v FROM (
    SELECT a.id, b.{c} AS v, row_number() OVER (PARTITION BY a.id ORDER BY sqrt({square}) * sqrt({len(_FIELDS)}.0 / ({' + '.join(both)})), b.id) AS r
    FROM p a JOIN p b ON a.{c} IS NULL AND b.{c} IS NOT NULL QUALIFY r <= 5) GROUP BY id)"""


@register("impute_knn", dbl=_FIELDS, sql=f"""
WITH p AS (SELECT patient_id AS id, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in _FIELDS)} FROM patients_v),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _HOLES)} FROM p)
SELECT p.id AS patient_id, {', '.join(f'coalesce(p.{x}, n_{x}.v, m_{x}) AS {x}' if x in _HOLES else f'p.{x}' for x in _FIELDS)}
FROM p CROSS JOIN m {' '.join(f'LEFT JOIN {_lend(c)} n_{c} ON n_{c}.id = p.id' for c in _HOLES)}""")
def q_impute_knn(spark, sf):
    return N.impute_knn(patients(spark, sf).select("patient_id", *_FIELDS), _FIELDS, "patient_id")
