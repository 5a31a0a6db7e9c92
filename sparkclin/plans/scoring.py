"""The flagship scoring slice and the shared scoring plan.

scored patients → range validation (B8) → median imputation fitted on the
valid rows (D17) → clinical features (D1–D5) → linear score (E12) → risk
level and confidence (G1/G2) → per age band: confusion cells, recall,
precision and mean risk (F1/F2). One scan of ``orders``, one one-row
broadcast of medians, one shuffle for the final group-by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.operators import features as D
from sparkclin.operators import metrics as M
from sparkclin.operators import model as E
from sparkclin.operators import prep as P
from sparkclin.operators import quality as B
from sparkclin.functions.exprs import safe_div
from sparkclin.sources.views import scored

# Coefficient table of the linear risk model used by the slice.
FLAGSHIP_COEF = {"glucose": 0.03, "bmi": 0.08, "age": 0.02, "bp_risk": 0.1}
FLAGSHIP_INTERCEPT = -7.08
AGE_BAND_EDGES = ([0, 30, 45, 60, 120], ["young", "middle", "senior", "elderly"])


def score_patients(df: DataFrame) -> DataFrame:
    """Validated, imputed, featurised and scored rows (the shared scoring plan)."""
    rules = B.range_rules(B.CLINICAL_RANGES, "error", df.columns)
    valid = df.where(~B.violates_any(rules))
    imp = P.impute_simple(valid, ["glucose", "blood_pressure"], "median")
    feats = D.clinical_features(imp)
    return E.score_linear(feats, FLAGSHIP_COEF, FLAGSHIP_INTERCEPT)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_patients(scored(spark, sf_dir).drop("y_pred"))
    s = s.withColumn("age_band", D.bin_column(F.col("age"), *AGE_BAND_EDGES)) \
         .withColumn("y_hat", (F.col("probability") > 0.5).cast("int"))
    # One aggregate per band: confusion cells (F1) plus the risk roll-up, then F2 ratios.
    g = s.groupBy("age_band").agg(*M.confusion_cells("y_true", "y_hat"), F.count(F.lit(1)).alias("n"),
                                  F.avg("risk_score").alias("mean_risk"),
                                  F.count_if(F.col("risk_level") == "High Risk").alias("n_high_risk"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return g.select("age_band", "tn", "fp", "fn", "tp", safe_div(tp, tp + fn).alias("recall"),
                    safe_div(tp, tp + fp).alias("precision"), "n", "mean_risk", "n_high_risk")
