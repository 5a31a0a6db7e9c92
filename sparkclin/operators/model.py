"""E: training, scoring, calibration and explanation.

SQL-expressible models (a linear model's coefficient table) are scored as
one projection; everything that is genuinely a fit uses Spark ML
estimators, whose training is distributed tree / gradient aggregation.
Explanations of linear models are arithmetic on the coefficient table; the
sampled Shapley estimate for other models is built from joins and
``model.transform``, never a driver loop over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import md5_bucket, q, safe_div, with_constants
from sparkclin.session import stored
from sparkclin.operators.rules import classify_risk, confidence_score


FOLD_PARTS = 4096  # ranges of the hash that rows of a class are numbered in


# ------------------------------------------------------------------ E12 / E11
def linear_logit(coef: dict[str, float], intercept: float = 0.0) -> Column:
    return sum((F.lit(float(w)) * F.col(q(c)).cast("double") for c, w in coef.items()), F.lit(float(intercept)))


def score_linear(df: DataFrame, coef: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """probability = σ(b + Σ wᵢxᵢ), risk score ×100, level and confidence."""
    p = 1.0 / (1.0 + F.exp(-linear_logit(coef, intercept)))
    out = df.withColumn("probability", p)
    return out.select("*", (F.col("probability") * 100).alias("risk_score"),
                      classify_risk(F.col("probability") * 100).alias("risk_level"),
                      confidence_score(F.col("probability")).alias("confidence"))


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def score_batch(model, df: DataFrame, feature_cols: list[str], fallback: DataFrame | None = None,
                key: str | None = None) -> DataFrame:
    """Spark ML model → probability, risk score, level, confidence for a whole table.

    Rows the model cannot score (NULL features) are taken from ``fallback``
    (rule scores, G5) when given, joined on ``key``.
    """
    from pyspark.ml.functions import vector_to_array
    complete = F.lit(True)
    for c in feature_cols:
        complete = complete & F.col(q(c)).isNotNull()
    ok = df.where(complete)
    scored = model.transform(assemble(ok, feature_cols)).withColumn(
        "probability", vector_to_array("probability")[1])
    scored = scored.select(*df.columns, "probability", (F.col("probability") * 100).alias("risk_score"),
                           classify_risk(F.col("probability") * 100).alias("risk_level"),
                           confidence_score(F.col("probability")).alias("confidence"),
                           F.lit(False).alias("fallback"))
    if fallback is None:
        return scored
    bad = df.join(ok.select(key), key, "left_anti").join(
        fallback.select(key, F.col("risk_score").alias("__rs"), F.col("risk_level").alias("__rl"),
                        F.col("confidence").alias("__c")), key, "left")
    fb = bad.select(*df.columns, F.lit(None).cast("double").alias("probability"), F.col("__rs").alias("risk_score"),
                    F.col("__rl").alias("risk_level"), F.col("__c").alias("confidence"), F.lit(True).alias("fallback"))
    return scored.unionByName(fb)


# ------------------------------------------------------------------ E4 / E7
def class_weights(df: DataFrame, target: str = "target", out: str = "weight") -> DataFrame:
    """Balanced weights n / (classes · n_c) attached per row; a row without a class has no weight."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("__nc"))
    t = c.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = with_constants(c, t).select(target, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(w, target, "left")


def stratified_folds(df: DataFrame, target: str, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Class-balanced folds: within each class rows are ordered by an md5 hash of
    the key and dealt round-robin. Ranks are row numbers in ``FOLD_PARTS`` equal ranges of
    the hash plus the counts of the ranges before, so rows are shuffled once and no window is class-wide."""
    from sparkclin.operators.keyed import join_same
    from pyspark.sql.window import Window
    h = md5_bucket(F.col(key), 1 << 32)
    part = F.coalesce(F.floor(h / ((1 << 32) // FOLD_PARTS)), F.lit(-1))  # no key: before all others
    base = df.withColumn("__h", h).withColumn("__part", part)
    size = df.select(F.col(q(target)), part.alias("__part")).groupBy(target, "__part").agg(F.count(F.lit(1)).alias("__c"))
    earlier = Window.partitionBy(target).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = size.select(target, "__part", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    rn = F.row_number().over(Window.partitionBy(target, "__part").orderBy("__h", key))
    j = join_same(base.withColumn("__rn", rn), F.broadcast(before), [target, "__part"], "inner")  # rows without a class are dealt among themselves
    return j.withColumn(out, F.pmod(F.col("__before") + F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__h", "__part", "__rn", "__before")


# ------------------------------------------------------------------ E1–E3, E5, E6, E8, E10
def _weighted(df, target, feature_cols, weight_col):
    d = assemble(df, feature_cols)
    if weight_col and weight_col not in d.columns:
        d = class_weights(d, target, weight_col)
    return d


def train_logistic(df: DataFrame, feature_cols: list[str], target: str = "target", C: float = 1.0,
                   penalty: str = "l2", balanced: bool = True):
    """Balanced logistic regression; regParam = 1/(C·n) mirrors the C parametrisation."""
    from pyspark.ml.classification import LogisticRegression
    d = _weighted(df, target, feature_cols, "weight" if balanced else None)
    n = d.count()
    lr = LogisticRegression(featuresCol="features", labelCol=target, weightCol="weight" if balanced else None,
                            regParam=1.0 / (C * n), elasticNetParam=1.0 if penalty == "l1" else 0.0, maxIter=100)
    return lr.fit(d)


def train_forest(df: DataFrame, feature_cols: list[str], target: str = "target", n_trees: int = 100,
                 max_depth: int = 10, balanced: bool = True):
    """Random forest (balanced by class weights), seed 42."""
    from pyspark.ml.classification import RandomForestClassifier
    d = _weighted(df, target, feature_cols, "weight" if balanced else None)
    return RandomForestClassifier(featuresCol="features", labelCol=target, numTrees=n_trees, maxDepth=max_depth,
                                  weightCol="weight" if balanced else None, seed=42).fit(d)


def train_boosted(df: DataFrame, feature_cols: list[str], target: str = "target", max_iter: int = 50,
                  max_depth: int = 5, step: float = 0.1, subsample: float = 1.0, balanced: bool = True):
    """Gradient-boosted trees (stands in for the third-party boosters)."""
    from pyspark.ml.classification import GBTClassifier
    d = _weighted(df, target, feature_cols, "weight" if balanced else None)
    return GBTClassifier(featuresCol="features", labelCol=target, maxIter=max_iter, maxDepth=max_depth,
                         stepSize=step, subsamplingRate=subsample, weightCol="weight" if balanced else None,
                         seed=42).fit(d)


class RecallEvaluator:
    """Recall of class 1 at threshold 0.5, as a Spark ML evaluator."""

    @staticmethod
    def make(target: str):
        from pyspark.ml.evaluation import MulticlassClassificationEvaluator
        return MulticlassClassificationEvaluator(labelCol=target, predictionCol="prediction",
                                                 metricName="recallByLabel", metricLabel=1.0)


def grid_search_cv(df: DataFrame, feature_cols: list[str], target: str = "target", k: int = 5,
                   grid: dict | None = None, estimator: str = "logistic", parallelism: int = 4,
                   random_draws: int | None = None, seed: int = 42, together: bool = False):
    """K-fold CV over a parameter grid scored by recall.

    Folds come from ``stratified_folds`` (``foldCol``) so they are balanced
    and reproducible. ``random_draws`` keeps a seeded subset of the grid
    (random search); an empty grid is the baseline CV. ``together`` fits the logistic
    models of all points and folds in shared passes (``search``), for large grids.
    """
    import random

    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
    if together and estimator != "logistic":
        raise ValueError("only logistic models are fitted together")
    d = stratified_folds(_weighted(df, target, feature_cols, "weight"), target,
                         feature_cols[0] if "id" not in df.columns else "id", k)
    est = {"logistic": LogisticRegression(featuresCol="features", labelCol=target, weightCol="weight"),
           "forest": RandomForestClassifier(featuresCol="features", labelCol=target, weightCol="weight", seed=seed),
           "boosted": GBTClassifier(featuresCol="features", labelCol=target, weightCol="weight", seed=seed)}[estimator]
    b = ParamGridBuilder()
    for name, values in (grid or {}).items():
        b = b.addGrid(est.getParam(name), values)
    maps = b.build()
    if random_draws is not None and len(maps) > random_draws:
        maps = random.Random(seed).sample(maps, random_draws)
    if together:
        from sparkclin.operators.search import FILE_ROWS, recalls_together
        points = [{p.name: v for p, v in m.items()} for m in maps]
        used = dict.fromkeys([*feature_cols, target, *[p.get("weightCol", "weight") for p in points], "fold"])
        d = stored(d.select(*[F.col(q(c)) for c in used]), "folds", FILE_ROWS)
        recalls = recalls_together(d, feature_cols, target, points, k)
        mean = [float(v) for v in recalls.mean(axis=1)]
        best = est.fit(assemble(d, feature_cols), maps[mean.index(max(mean))])
        return CrossValidatorModel(best, mean, None, [float(v) for v in recalls.std(axis=1)])
    d = stored(d, "folds")  # folds, weights and features are made once, not per fold and grid point
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RecallEvaluator.make(target),
                        numFolds=k, foldCol="fold", parallelism=parallelism, collectSubModels=False)
    return cv.fit(d)


def feature_importance(model, feature_cols: list[str]) -> DataFrame:
    """Tree importances or |coefficients|, sorted descending."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if hasattr(model, "featureImportances"):
        vals = list(model.featureImportances.toArray())
    else:
        vals = [abs(v) for v in model.coefficients.toArray()]
    return spark.createDataFrame(list(zip(feature_cols, map(float, vals))), "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature")


def select_best_model(metrics: DataFrame, metric: str = "recall", name_col: str = "model") -> DataFrame:
    """The row with the greatest metric (name breaks ties)."""
    return metrics.orderBy(F.col(metric).desc(), F.col(name_col)).limit(1)


# ------------------------------------------------------------------ E15 calibration (E13, E14: calibration.py)
def temperature_grid(scores: DataFrame, prob: str, target: str, temps: list[float]) -> DataFrame:
    """Log loss of σ(logit(p)/T) for each T of a grid in one aggregate; arg-min row flagged.

    logit(p) = ln(p / (1 − p + 1e−6)) as in the reference. Every T is an aggregate expression of the one scan, so a row is
    read once and meets no grid.
    """
    p = F.col(prob).cast("double")
    z = scores.select(F.log(p / (1 - p + 1e-6)).alias("__z"), F.col(target).alias("__y"))

    def loss(t: float) -> Column:
        pt = 1 / (1 + F.exp(-F.col("__z") / F.lit(float(t))))
        pc = F.greatest(F.least(pt, F.lit(1 - 1e-15)), F.lit(1e-15))
        return F.avg(-F.when(F.col("__y") == 1, F.log(pc)).otherwise(F.log(1 - pc)))

    one = z.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(temps)])
    rows = F.array(*[F.struct(F.col(f"l{i}").alias("log_loss"), F.lit(float(t)).alias("temperature")) for i, t in enumerate(temps)])
    best = F.array_min(rows)["temperature"]  # the least loss, then the least temperature
    return one.select(F.explode(rows).alias("r"), best.alias("best")).select(
        "r.temperature", "r.log_loss", (F.col("r.temperature") == F.col("best")).alias("is_best"))


def calibrate_temperature(scores: DataFrame, prob: str, target: str, rounds: int = 3) -> float:
    """E15 fit: coarse grid then two refinements around the best T (small driver-side constants)."""
    lo, hi, n = 0.1, 5.0, 50
    best = 1.0
    for _ in range(rounds):
        step = (hi - lo) / (n - 1)
        temps = [lo + i * step for i in range(n)]
        best = temperature_grid(scores, prob, target, temps).where("is_best").first()["temperature"]
        lo, hi = max(1e-3, best - step), best + step
    return best


# ------------------------------------------------------------------ E16–E21 explanations
def explain_linear(df: DataFrame, coef: dict[str, float], means: DataFrame | None = None,
                   id_cols: list[str] | None = None) -> DataFrame:
    """E16 + E19: contribution wᵢ(xᵢ − mean xᵢ) per feature, sorted by |c| descending,
    with direction / impact / magnitude and the top-5 names."""
    cols = list(coef)
    if means is None:
        means = df.agg(*[F.avg(q(c)).alias(c) for c in cols])
    m = means.select(*[F.col(q(c)).alias(f"__m_{i}") for i, c in enumerate(cols)])
    j = with_constants(df, m)
    items = [F.struct(F.lit(c).alias("feature"),
                      (F.lit(float(coef[c])) * (F.col(q(c)).cast("double") - F.col(f"__m_{i}"))).alias("contribution"))
             for i, c in enumerate(cols)]
    arr = F.array_sort(F.array(*items), lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
                       .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
                       .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    decorated = F.transform(F.slice(arr, 1, 10), lambda x: F.struct(
        x["feature"].alias("feature"), x["contribution"].alias("contribution"),
        F.when(x["contribution"] > 0, "positive").otherwise("negative").alias("direction"),
        F.when(x["contribution"] > 0, "increases").otherwise("decreases").alias("impact"),
        F.abs(x["contribution"]).alias("magnitude")))
    keep = id_cols or []
    return j.select(*keep, *[F.col(q(c)) for c in cols if c not in keep], decorated.alias("contributing_factors"),
                    F.transform(F.slice(arr, 1, 5), lambda x: x["feature"]).alias("top_factors"))


def global_importance(df: DataFrame, coef: dict[str, float], means: DataFrame | None = None,
                      k: int = 10) -> DataFrame:
    """Mean |wᵢ(xᵢ − mean xᵢ)| over all rows for every feature, then the top ``k`` (a report).

    One aggregate over the table; features are ranked only after their means are complete.
    """
    cols = list(coef)
    if means is None:
        means = df.agg(*[F.avg(q(c)).alias(c) for c in cols])
    m = means.select(*[F.col(q(c)).alias(f"__m_{i}") for i, c in enumerate(cols)])
    one = with_constants(df, m).agg(*[
        F.avg(F.abs(F.lit(float(coef[c])) * (F.col(q(c)).cast("double") - F.col(f"__m_{i}")))).alias(f"__g_{i}")
        for i, c in enumerate(cols)])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__g_{i}").alias(
        "mean_abs_contribution")) for i, c in enumerate(cols)])).alias("g")).select("g.*")
    return rows.orderBy(F.col("mean_abs_contribution").desc(), "feature").limit(k)


# Clinical findings (column, limit, sentence with the value at a number of decimals).
FINDINGS = [
    ("glucose", 126, "Glucose (%s mg/dL) is elevated (>126 mg/dL)", 1),
    ("bmi", 30, "BMI (%s) indicates obesity", 1),
    ("age", 60, "Age (%s years) is a significant risk factor", 0),
    ("blood_pressure", 90, "Blood pressure (%s) is elevated", 1),
    ("cholesterol", 240, "Cholesterol (%s mg/dL) is high", 1),
]

# Clinical notes per feature, and the note of any other feature.
CLINICAL_NOTES = {
    "glucose": "Glucose level - Normal: 70-100 mg/dL, Diabetic: >126 mg/dL",
    "bmi": "BMI - Normal: 18.5-24.9, Overweight: 25-29.9, Obese: ≥30",
    "age": "Age - Risk increases significantly after age 45",
    "blood_pressure": "Blood Pressure - Normal: <120/80 mmHg, Hypertensive: ≥140/90",
    "cholesterol": "Cholesterol - Desirable: <200 mg/dL, High: ≥240",
    "pregnancies": "Pregnancies - Higher parity associated with increased risk",
    "insulin": "Insulin - 2-Hour serum insulin, Normal: <25 mu U/ml",
    "skin_thickness": "Skin Thickness - Triceps skin fold thickness",
    "diabetes_pedigree": "Diabetes Pedigree - Family history score",
    "thalach": "Max Heart Rate - Lower max heart rate indicates higher risk",
    "exang": "Exercise Angina - Presence indicates higher risk",
    "oldpeak": "ST Depression - Higher values indicate higher risk",
}
DEFAULT_NOTE = "Clinical significance of %s should be evaluated"


def explanation_text(explained: DataFrame) -> DataFrame:
    """The top-5 factors above 0.05 (risk) and below −0.05 (protective), then the findings with their values."""
    top5 = F.slice("contributing_factors", 1, 5)
    risk = F.transform(F.filter(top5, lambda x: x["contribution"] > 0.05), lambda x: x["feature"])
    prot = F.transform(F.filter(top5, lambda x: x["contribution"] < -0.05), lambda x: x["feature"])
    have = set(explained.columns)
    found = [F.when(F.col(c) > limit, F.format_string(text, F.format_string(f"%.{n}f", F.col(c).cast("double"))))
             for c, limit, text, n in FINDINGS if c in have]
    findings = F.filter(F.array(*found).cast("array<string>"), lambda x: x.isNotNull())
    text = F.concat(
        F.when(F.size(risk) > 0, F.concat(F.lit("Risk is primarily driven by: "), F.array_join(risk, ", "), F.lit(". ")))
        .otherwise(F.lit("No significant risk factors identified. ")),
        F.when(F.size(prot) > 0, F.concat(F.lit("Protective factors include: "), F.array_join(prot, ", "), F.lit(". ")))
        .otherwise(F.lit("")),
        F.when(F.size(findings) > 0, F.concat(F.lit("Clinically relevant findings: "), F.array_join(findings, ". ")))
        .otherwise(F.lit("")))
    return explained.withColumn("clinical_explanation", text)


def clinical_notes(features: DataFrame, feature_col: str = "feature", notes: dict[str, str] | None = None) -> DataFrame:
    """Feature → note, or the default sentence with the feature's name (a literal lookup, no join)."""
    notes = CLINICAL_NOTES if notes is None else notes
    table = F.create_map(*[F.lit(x) for kv in notes.items() for x in kv]) if notes else F.create_map()
    return features.withColumn("note", F.coalesce(F.try_element_at(table, F.col(feature_col)),
                                                  F.format_string(DEFAULT_NOTE, F.col(feature_col))))
