"""K1–K7: the user-defined function surface.

Extension points take Spark-native forms: a feature is a ``DataFrame →
Column`` function, a validation is a SQL predicate (with a vectorised
pandas fallback), an alert condition is a SQL predicate string, a
predictor is ``DataFrame → DataFrame``, aggregates are named Spark SQL
aggregates (grouped pandas UDF for anything else), and multi-output
validators return ``array<struct>`` that callers ``explode``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# K1 -------------------------------------------------------------------------
class FeatureRegistry:
    """Features by name, each an expression over the table and over the features it names as dependencies.

    ``compute`` adds one projection per level of dependencies: all features of a level read only the table
    and earlier levels, so a hundred independent features are one projection, not a chain of a hundred.
    A dependency that is not registered is taken to be a column.
    """

    def __init__(self):
        self.expressions: dict[str, Callable[[DataFrame], Column]] = {}
        self.reads: dict[str, set[str]] = {}
        self.about: dict[str, dict[str, str]] = {}

    def register_feature(self, name: str, expression: Callable[[DataFrame], Column], *, dependencies=(), **about: str) -> None:
        self.expressions[name], self.reads[name], self.about[name] = expression, set(dependencies), about

    def levels(self, names: list[str]) -> list[list[str]]:
        """The features ``names`` rest on, by level; a cycle is an error."""
        waiting, found = set(), list(names)
        while found:
            n = found.pop()
            if n in self.expressions and n not in waiting:
                waiting.add(n)
                found.extend(self.reads[n])
        out = []
        while waiting:
            level = sorted(n for n in waiting if not self.reads[n] & waiting)
            if not level:
                raise ValueError(f"features depend on one another: {sorted(waiting)}")
            out.append(level)
            waiting.difference_update(level)
        return out

    def compute(self, df: DataFrame, names: list[str]) -> DataFrame:
        for level in self.levels(names):
            df = df.withColumns({n: self.expressions[n](df) for n in level})
        return df

    def compute_feature(self, name: str, df: DataFrame) -> DataFrame:
        return self.compute(df, [name])

    def catalog(self, spark) -> DataFrame:
        """One row a feature, with its level among all features."""
        depth = {n: i for i, level in enumerate(self.levels(list(self.expressions))) for n in level}
        rows = [(n, self.about[n].get("feature_type", "numerical"), self.about[n].get("description", ""),
                 sorted(self.reads[n]), depth[n]) for n in sorted(depth)]
        return spark.createDataFrame(rows, "feature string, feature_type string, description string, "
                                           "dependencies array<string>, level int")


# K2 -------------------------------------------------------------------------
@dataclass
class Validation:
    name: str
    predicate: str | None = None          # SQL: TRUE when the value is valid
    message: str = "invalid value"
    pandas_fn: Callable[[pd.Series], pd.Series] | None = None  # vectorised fallback → bool Series


def register_validation(registry: dict, name: str, predicate: str | None = None, message: str = "invalid value",
                        pandas_fn: Callable[[pd.Series], pd.Series] | None = None) -> None:
    registry[name] = Validation(name, predicate, message, pandas_fn)


def apply_validation(df: DataFrame, v: Validation, col: str) -> DataFrame:
    """Adds ``<name>_ok`` and ``<name>_message``; SQL predicates stay in the JVM."""
    if v.predicate is not None:
        ok = F.coalesce(F.expr(v.predicate.replace("{col}", f"`{col}`")), F.lit(False))
    else:
        fn = v.pandas_fn

        @F.pandas_udf(T.BooleanType())
        def check(s: pd.Series) -> pd.Series:
            return fn(s).fillna(False).astype(bool)
        ok = check(F.col(col))
    return df.withColumn(f"{v.name}_ok", ok).withColumn(f"{v.name}_message", F.when(~F.col(f"{v.name}_ok"), F.lit(v.message)))


# K3 -------------------------------------------------------------------------
ALERT_RULE = ("rule_name string, predicate string, severity string, channels array<string>, cooldown_s int, "
              "enabled boolean")


def alert_rule_table(spark, rules=None) -> DataFrame:
    """Alert rules as a table that can be stored and joined; the default rules unless others are given."""
    from sparkclin.operators.ops import DEFAULT_ALERT_RULES
    rows = [(*r, True) for r in (DEFAULT_ALERT_RULES if rules is None else rules)]
    return spark.createDataFrame(rows, ALERT_RULE)


def put_alert_rules(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules of ``changes`` added to ``table``, in place of rules of the same name."""
    return table.join(changes, "rule_name", "left_anti").unionByName(changes.select(*table.columns))


def switch_alert_rules(table: DataFrame, names: list[str], enabled: bool) -> DataFrame:
    named = F.col("rule_name").isin(*names)
    return table.withColumn("enabled", F.when(named, F.lit(enabled)).otherwise(F.col("enabled")))


def drop_alert_rules(table: DataFrame, names: list[str]) -> DataFrame:
    return table.where(~F.col("rule_name").isin(*names))


def enabled_alert_rules(table: DataFrame) -> list[tuple]:
    """The enabled rules in the form that ``evaluate_alert_rules`` compiles: a predicate must be known when the plan is made,
    and one that does not parse or names an unknown column is an error there."""
    rows = table.where("enabled").orderBy("rule_name").collect()
    return [(r.rule_name, r.predicate, r.severity, list(r.channels), r.cooldown_s) for r in rows]


# K4 -------------------------------------------------------------------------
def run_golden(predict_fn: Callable[[DataFrame], DataFrame], cases: DataFrame, expected: DataFrame,
               key: str = "case_id", tol: float = 0.01) -> DataFrame:
    """Golden cases through any ``DataFrame → DataFrame`` predictor, compared by B21."""
    from sparkclin.operators.quality import golden_compare
    return golden_compare(predict_fn(cases), expected, key, tol)


# K5 -------------------------------------------------------------------------
def aggregate_by_name(df: DataFrame, group_col: str, cols: list[str], funcs: list[str | Callable],
                      prefix: str = "agg") -> DataFrame:
    """Spark SQL aggregates by name; a Python callable becomes a grouped pandas UDF (Series → scalar)."""
    from sparkclin.operators.features import group_aggregates
    from sparkclin.operators.keyed import join_same
    named = [f for f in funcs if isinstance(f, str)]

    def grouped(f: Callable):
        def one(s: pd.Series) -> float:
            return float(f(s))
        return F.pandas_udf(one, T.DoubleType())

    made = [grouped(f)(F.col(c)).alias(f"{prefix}_{c}_{f.__name__}") for f in funcs if not isinstance(f, str) for c in cols]
    if not made:
        return group_aggregates(df, group_col, cols, named, prefix)
    own = df.groupBy(group_col).agg(*made)  # all callables and columns in one grouped pass
    return join_same(group_aggregates(df, group_col, cols, named, prefix), own, [group_col], "inner") if named else own


# K6 -------------------------------------------------------------------------
def metric_from_cells(expr: Callable[[Column, Column, Column, Column], Column], cells: DataFrame) -> DataFrame:
    """A metric function written over the confusion cells (tn, fp, fn, tp) — the bootstrap's K6 hook."""
    return cells.select("*", expr(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")).alias("metric"))


# K7 -------------------------------------------------------------------------
def explode_results(df: DataFrame, array_col: str, keep: list[str]) -> DataFrame:
    """Per-row multi-output validators return ``array<struct>``; this is their table form."""
    return df.select(*keep, F.explode(array_col).alias("__r")).select(*keep, "__r.*")
