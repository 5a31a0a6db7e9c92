"""Bracketed quantiles equal numpy's exact ones at every size, with ties, few rows and skewed groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclin.functions.exprs import SKETCH, column_quantiles, quantiles_long

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["distinct", "ties", "heavy"])
def test_quantiles_of_groups_larger_than_the_sketch(spark, kind):
    n = 4 * SKETCH + 17
    value = {"distinct": F.xxhash64("id") / 1e12, "ties": F.pmod(F.xxhash64("id"), F.lit(37)).cast("double"),
             "heavy": F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0)}[kind]
    df = spark.range(n).select(F.when(F.col("id") < 3 * SKETCH, "big").when(F.col("id") < n - 5, "middle").when(F.col("id") < n - 1, "few")
                               .otherwise(None).alias("g"), value.alias("value")).repartition(7)
    rows = df.collect()
    got = {r.g: r["__q"] for r in quantiles_long(df, PROBS, ["g"]).collect()}
    assert set(got) == {"big", "middle", "few", None}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([r.value for r in rows if r.g == g], PROBS), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 101])
def test_quantiles_of_few_rows(spark, n):
    values = [float(x * x % 53) for x in range(n)]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "a double, b double")
    row = column_quantiles(df, ["a", "b"], PROBS).first()
    assert row["__q_0"] == pytest.approx(list(np.quantile(values, PROBS)))
    assert row["__q_1"] is None


def test_values_inside_brackets_are_few(spark):
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("value"))
    plan = quantiles_long(df, [0.5], [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile_approx") == 1 and "percentile(" not in plan
    values = [r.value for r in df.collect()]
    assert quantiles_long(df, [0.5], []).first()["__q"][0] == pytest.approx(np.median(values))
