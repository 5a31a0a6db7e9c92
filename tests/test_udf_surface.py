"""K1 and K3: features by level, alert rules as a table."""

import pytest
from pyspark.sql import functions as F

from sparkclin.functions import udf as K
from sparkclin.operators import ops


def test_features_are_one_projection_a_level(spark):
    reg = K.FeatureRegistry()
    for i in range(20):
        reg.register_feature(f"f{i:02d}", lambda df, i=i: F.col("x") + i)
    reg.register_feature("total", lambda df: F.col("f00") + F.col("f19"), dependencies=["f00", "f19"], description="sum")
    reg.register_feature("twice", lambda df: F.col("total") * 2 + F.col("x"), dependencies=["total", "x"])
    assert [len(level) for level in reg.levels([*reg.expressions])] == [20, 1, 1]
    assert reg.levels(["twice"]) == [["f00", "f19"], ["total"], ["twice"]]
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    rows = reg.compute(df, ["twice"]).orderBy(F.col("x").asc_nulls_last()).collect()
    assert rows[0].twice == 43.0 and rows[1].twice is None
    assert reg.compute_feature("f03", df).columns == ["x", "f03"]
    cat = {r.feature: r for r in reg.catalog(spark).collect()}
    assert cat["twice"].level == 2 and cat["total"].description == "sum" and cat["f00"].level == 0
    reg.register_feature("f00", lambda df: F.col("twice"), dependencies=["twice"])
    with pytest.raises(ValueError):
        reg.levels(["total"])


def test_alert_rules_are_a_table(spark):
    table = K.alert_rule_table(spark)
    assert len(K.enabled_alert_rules(table)) == len(ops.DEFAULT_ALERT_RULES)
    table = K.drop_alert_rules(table, [r[0] for r in ops.DEFAULT_ALERT_RULES if r[0] != "high_cpu_usage"])
    more = K.alert_rule_table(spark, [("low_disk", "disk_percent < 5", "low", ["slack"], 60),
                                      ("high_cpu_usage", "cpu_percent > 10", "high", ["email"], 300)])
    table = K.put_alert_rules(table, more)
    assert [(r[0], r[1]) for r in K.enabled_alert_rules(table)] == [
        ("high_cpu_usage", "cpu_percent > 10"), ("low_disk", "disk_percent < 5")]
    metrics = spark.createDataFrame([(1, 50.0, 3.0), (2, 5.0, 50.0)], "sample_id long, cpu_percent double, disk_percent double") \
        .withColumn("ts", F.timestamp_seconds(F.col("sample_id") * 10))
    fired = lambda t: {(r.rule_name, r.sample_id) for r in ops.evaluate_alert_rules(
        metrics, K.enabled_alert_rules(t)).collect()}
    assert fired(table) == {("high_cpu_usage", 1), ("low_disk", 1)}
    assert fired(K.switch_alert_rules(table, ["low_disk"], False)) == {("high_cpu_usage", 1)}
    with pytest.raises(Exception):
        ops.alert_candidates(metrics, K.enabled_alert_rules(K.alert_rule_table(spark, [("bad", "cpu_percent >", "low", ["slack"], 1)])))
