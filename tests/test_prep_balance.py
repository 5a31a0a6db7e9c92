"""D29 with its balance step: synthetic rows in the transformed space of the training rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkclin.operators.drift import drift_checks, drift_report, recent_drift_checks, reference_categories
from sparkclin.operators.prep import PreprocessPipeline


@pytest.mark.parametrize("method", ["smote", "adasyn"])
def test_balanced_training_rows(spark, method):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1) if i % 5 else None, int(i % 6 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, target int")
    pipe = PreprocessPipeline(["a", "b"], "target", k_best=None, add_features=False).fit(df)
    plain = {r.id: (r.a, r.b) for r in pipe.transform(df, keep=["id"]).collect()}
    out = pipe.balanced(df, "id", method).collect()
    assert {r.id: (r.a, r.b) for r in out if r.copy == 0} == plain and len(plain) == 240
    made = [r for r in out if r.copy > 0]
    assert all(r.target == 1 and rows[r.id][3] == 1 for r in made)
    assert len(made) == 160 if method == "smote" else abs(len(made) - 160) <= 20
    small = [plain[i] for i in plain if rows[i][3] == 1]
    for r in made:  # between its base and another row of the class
        x, y = plain[r.id]
        cross = [abs((u - x) * (r.b - y) - (v - y) * (r.a - x)) for u, v in small if (u, v) != (x, y)]
        assert min(cross) < 1e-9
    assert len({c for c in pipe.balanced(df, "id", method).columns}) == 5


def test_categories_as_rows_and_drift_advice(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", None), (None, None)], "a string, `b c` int")
    got = {(r.feature, r.category): r for r in reference_categories(df, ["a", "b c"]).collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("b c", "1"), ("b c", "2")}
    assert got["a", "x"].n == 2 and got["a", "x"].share == pytest.approx(2 / 3)
    assert got["a", "y"].entropy == pytest.approx(0.6365141682948128) and got["b c", "1"].n_categories == 2
    assert reference_categories(df.limit(0), ["a"]).count() == 0
    scores = spark.createDataFrame([("f", 0.9, True), ("g", 0.1, False)], "feature string, drift_score double, drifted boolean")
    r = drift_report(scores, drift_type="model").first()
    assert r.recommendations[:2] == ["Drift detected in 1 features", "Top drifted features: f, g"] and len(r.recommendations) == 5
    assert drift_report(scores.where(~F.col("drifted"))).first().recommendations == ["No drift detected. Continue monitoring."]


def test_last_checks_of_a_drift_history(spark):
    rows = [(f"2024-01-{d:02d}", f, 0.9 if d % 2 and f == "a" else 0.1) for d in range(1, 16) for f in "abc"]
    rows += [("2024-01-02", "a", None), (None, "a", 0.9)]
    runs = spark.createDataFrame(rows, "run_date string, feature string, drift_score double")
    r = recent_drift_checks(drift_checks(runs)).first()
    assert (r.total_checks, r.recent_checks, r.recent_drift_count) == (15, 10, 5)  # odd days of the 6th to the 15th
    assert r.overall_risk == "HIGH" and r.drifting_features == ["a"]
    none = recent_drift_checks(drift_checks(runs.limit(0))).first()
    assert tuple(none) == (0, 0, 0, "UNKNOWN", [])
