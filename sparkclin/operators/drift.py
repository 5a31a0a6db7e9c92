"""Reference statistics and data / model / concept drift.

Two-sample tests work on a long frame ``(feature, sample, value)`` where
``sample`` is ``reference`` or ``current``: every statistic is a group-by
on feature (and bin), so many features are scored in one pass. Running
CDFs (KS, Wasserstein) reduce to distinct values first and use the
bucketed prefix sum; histogram methods (PSI, KL, JS) bin by fitted edges
held in a per-feature table (one row per feature, broadcast).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from sparkclin.functions.exprs import (column_quantiles, cumulative_sums, q, quantiles_long, rows_from_struct_array,
                                      safe_div, stack_columns)
from sparkclin.session import stored

REF, CUR = "reference", "current"


def to_long(df: DataFrame, cols: list[str], sample_col: str = "sample") -> DataFrame:
    """(sample, feature, value) with NULL values dropped."""
    return (stack_columns(df.select(sample_col, *cols), [sample_col], cols)
            .withColumnRenamed(sample_col, "sample").where(F.col("value").isNotNull()))


# ------------------------------------------------------------------ H1 / H2
def reference_stats_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """H1: mean, std, min, max, quartiles, bias-corrected skew (G1) and excess kurtosis."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        aggs += [F.count(x).alias(f"__n_{i}"), F.avg(x).alias(f"__m_{i}"), F.stddev_samp(x).alias(f"__s_{i}"),
                 F.min(x).alias(f"__lo_{i}"), F.max(x).alias(f"__hi_{i}"),
                 F.skewness(x).alias(f"__g1_{i}"), F.kurtosis(x).alias(f"__g2_{i}")]
    one = df.agg(*aggs).crossJoin(column_quantiles(df, cols, [0.25, 0.5, 0.75], prefix="__p_"))
    def sk(i):
        n = F.col(f"__n_{i}").cast("double")
        return F.when(n > 2, F.col(f"__g1_{i}") * F.sqrt(n * (n - 1)) / (n - 2))
    def ku(i):
        n = F.col(f"__n_{i}").cast("double")
        return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col(f"__g2_{i}") + 6))
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"__n_{i}").alias("n"), F.col(f"__m_{i}").alias("mean"),
                        F.col(f"__s_{i}").alias("std"), F.col(f"__lo_{i}").alias("min"), F.col(f"__hi_{i}").alias("max"),
                        F.col(f"__p_{i}")[0].alias("q1"), F.col(f"__p_{i}")[1].alias("median"),
                        F.col(f"__p_{i}")[2].alias("q3"), sk(i).alias("skew"), ku(i).alias("kurtosis"))
               for i, c in enumerate(cols)]
    return rows_from_struct_array(one, structs)


def reference_stats_categorical(df: DataFrame, col: str) -> DataFrame:
    """H2: category counts (map), number of categories, entropy in nats."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("__t"))
    j = c.crossJoin(F.broadcast(tot))
    p = F.col("n") / F.col("__t")
    return j.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(col).cast("string"), F.col("n")))))
                 .alias("categories"), F.count(F.lit(1)).alias("n_categories"),
                 F.sum(-p * F.log(p)).alias("entropy"))


def reference_categories(df: DataFrame, cols: list[str]) -> DataFrame:
    """H2 as rows, for columns of any cardinality: (feature, category, n, share, n_categories, entropy in nats).

    One partial aggregate counts all columns; with T rows the entropy is ln T - sum(n ln n) / T, so it needs no second
    pass over the categories. Nulls are not a category; a column without values has no row.
    """
    n = F.col("n").cast("double")
    c = (df.select(F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(q(x)).cast("string").alias("category"))
                                      for x in cols])))
         .where("category IS NOT NULL").groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n")))
    total = c.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_categories"),
                                     F.sum(n * F.log(n)).alias("nln"))
    t = F.col("total").cast("double")
    entropy = F.greatest(F.log(t) - F.col("nln") / t, F.lit(0.0))
    return (c.join(F.broadcast(total), "feature")  # one row a column
            .select("feature", "category", "n", (n / t).alias("share"), "n_categories", entropy.alias("entropy")))


# ------------------------------------------------------------------ H4 / H5 running CDFs
def value_counts(long: DataFrame) -> DataFrame:
    """(feature, value, r, c): reference and current counts per distinct value.

    Every two-sample statistic below is computed from this table, so the
    input is read by one partial aggregate; the statistics of one job share
    its exchange, and later work scales with distinct values, not rows.
    """
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("sample") == REF).alias("r"), F.count_if(F.col("sample") == CUR).alias("c"))


def _cdf_pairs(long: DataFrame, with_next: bool = True) -> DataFrame:
    """Per (feature, distinct value): F_ref(v), F_cur(v) (inclusive) and the next value.

    KS and Wasserstein both use this exact plan, so when they run in one job
    (H12) the optimizer reuses its exchanges instead of re-reading the input.
    """
    cnt = value_counts(long)
    cum = cumulative_sums(cnt, "value", ["r", "c"], ["feature"], with_next=with_next)
    tot = cnt.groupBy("feature").agg(F.sum("r").alias("__nr"), F.sum("c").alias("__nc"),
                                     F.min(F.when(F.col("r") > 0, F.col("value"))).alias("__rmin"),
                                     F.max(F.when(F.col("r") > 0, F.col("value"))).alias("__rmax"))
    return cum.join(F.broadcast(tot), "feature").select(
        "*", (F.col("cum_r") / F.col("__nr")).alias("F_ref"), (F.col("cum_c") / F.col("__nc")).alias("F_cur"))


def wasserstein(long: DataFrame) -> DataFrame:
    """H4: W₁ between the samples, and W₁ / (ref max − ref min + 1e−6)."""
    c = _cdf_pairs(long, with_next=True)
    return c.groupBy("feature").agg(
        F.sum(F.abs(F.col("F_ref") - F.col("F_cur")) * (F.col("next_value") - F.col("value"))).alias("wasserstein"),
        F.first("__rmin").alias("__lo"), F.first("__rmax").alias("__hi")).select(
        "feature", F.coalesce("wasserstein", F.lit(0.0)).alias("wasserstein"),
        (F.coalesce("wasserstein", F.lit(0.0)) / (F.col("__hi") - F.col("__lo") + 1e-6)).alias("wasserstein_score"))


@F.pandas_udf(DoubleType())
def kolmogorov_pvalue(lam: pd.Series) -> pd.Series:
    """Asymptotic two-sided Kolmogorov tail: 2 Σ_{k=1..100} (−1)^{k−1} exp(−2k²λ²), clipped to [0, 1]."""
    def one(x):
        if x is None or x != x:
            return float("nan")
        if x <= 0:
            return 1.0
        s = sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
        return min(1.0, max(0.0, 2 * s))
    return lam.map(one)


def ks_two_sample(long: DataFrame, with_pvalue: bool = True) -> DataFrame:
    """H5: D = max |F_ref − F_cur|; p-value from the asymptotic series; drift score 1 − p."""
    c = _cdf_pairs(long)
    d = c.groupBy("feature").agg(F.max(F.abs(F.col("F_ref") - F.col("F_cur"))).alias("ks_statistic"),
                                 F.first("__nr").alias("n_ref"), F.first("__nc").alias("n_cur"))
    if not with_pvalue:
        return d
    lam = F.col("ks_statistic") * F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    return d.withColumn("p_value", kolmogorov_pvalue(lam)).withColumn(
        "ks_score", F.when(F.col("p_value") < 1, 1 - F.col("p_value")).otherwise(0.0))


# ------------------------------------------------------------------ histogram methods
def _ref_edges(vc: DataFrame, probs: list[float]) -> DataFrame:
    """Exact reference percentiles from the count table (``percentile`` with frequencies)."""
    return quantiles_long(vc.where(F.col("r") > 0), probs, ["feature"], weight="r").withColumnRenamed("__q", "__e")


def _hist_pair(binned: DataFrame, n_bins: int) -> DataFrame:
    """Counts per (feature, bin) for both samples (binned rows carry r, c), every bin present."""
    spark = binned.sparkSession
    h = binned.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    bins = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    keys = binned.select("feature").distinct().crossJoin(F.broadcast(bins))
    return keys.join(h, ["feature", "bin"], "left").fillna(0, ["r", "c"])


def _totals(vc: DataFrame) -> DataFrame:
    return vc.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))


def psi_decile(long: DataFrame) -> DataFrame:
    """H6: 10 reference deciles, outer edges ±∞, empty cells skipped, result ÷ 5."""
    vc = value_counts(long)
    e = _ref_edges(vc, [i / 10 for i in range(1, 10)])
    b = vc.join(F.broadcast(e), "feature").select(
        "feature", "r", "c", F.size(F.filter("__e", lambda x: F.col("value") >= x)).alias("bin"))
    j = _hist_pair(b, 10).join(F.broadcast(_totals(vc)), "feature")
    rp, cp = F.col("r") / F.col("nr"), F.col("c") / F.col("nc")
    term = F.when((F.col("r") > 0) & (F.col("c") > 0), (cp - rp) * F.log(cp / rp)).otherwise(0.0)
    return j.groupBy("feature").agg((F.sum(term) / 5).alias("psi"))


def psi_smoothed(long: DataFrame) -> DataFrame:
    """H7: reference deciles closed to [min, max]; out-of-range current values fall out;
    counts + 1e−6 over the full sample sizes; no scaling."""
    vc = value_counts(long)
    e = _ref_edges(vc, [i / 10 for i in range(0, 11)])
    inner = lambda a: F.slice(a, 2, 9)
    b = (vc.join(F.broadcast(e), "feature")
         .where((F.col("value") >= F.col("__e")[0]) & (F.col("value") <= F.col("__e")[10]))
         .select("feature", "r", "c", F.size(F.filter(inner(F.col("__e")), lambda x: F.col("value") >= x)).alias("bin")))
    j = _hist_pair(b, 10).join(F.broadcast(_totals(vc)), "feature")
    ep, ap = (F.col("r") + 1e-6) / F.col("nr"), (F.col("c") + 1e-6) / F.col("nc")
    return j.groupBy("feature").agg(F.sum((ap - ep) * F.log(ap / ep)).alias("psi"))


def _uniform_hist(long: DataFrame, n_bins: int = 50) -> DataFrame:
    """Counts of both samples in ``n_bins`` equal bins spanning the reference range
    (edges i·step + min as numpy's linspace; values outside fall out)."""
    vc = value_counts(long)
    rng = vc.where(F.col("r") > 0).groupBy("feature").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / n_bins
    edges = F.array(*[F.lit(float(i)) * step + F.col("__lo") for i in range(1, n_bins)])
    e = rng.select("feature", "__lo", "__hi", edges.alias("__e"))
    b = (vc.join(F.broadcast(e), "feature")
         .where((F.col("value") >= F.col("__lo")) & (F.col("value") <= F.col("__hi")))
         .select("feature", "r", "c", F.size(F.filter("__e", lambda x: F.col("value") >= x)).alias("bin")))
    h = _hist_pair(b, n_bins)
    tot = h.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    return h.join(F.broadcast(tot), "feature")


def kl_histogram(long: DataFrame, n_bins: int = 50) -> DataFrame:
    """H10 (mass form): Σ p ln(p/q) over 50 bins of the reference range, each + 1e−10."""
    h = _uniform_hist(long, n_bins)
    p = F.col("r") / F.col("nr") + 1e-10
    qq = F.col("c") / F.col("nc") + 1e-10
    return h.groupBy("feature").agg(F.sum(p * F.log(p / qq)).alias("kl"))


def js_histogram(long: DataFrame, n_bins: int = 50) -> DataFrame:
    """√(½KL(p,m) + ½KL(q,m)) with m the mean of the two (smoothed) histograms."""
    h = _uniform_hist(long, n_bins)
    p = F.col("r") / F.col("nr") + 1e-10
    qq = F.col("c") / F.col("nc") + 1e-10
    m = (p + qq) / 2
    return h.groupBy("feature").agg(F.sqrt(0.5 * F.sum(p * F.log(p / m)) + 0.5 * F.sum(qq * F.log(qq / m))).alias("js"))


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(500):
            ap += 1
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, math.exp(-x + a * math.log(x) - gln) * h)


@F.pandas_udf(DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_gammaincc(d / 2.0, s / 2.0) if s == s and d > 0 else float("nan") for s, d in zip(stat, dof)])


def chi_square_categories(df: DataFrame, col: str, sample_col: str = "sample", with_pvalue: bool = True) -> DataFrame:
    """H8: 2×K contingency (current vs reference counts over the union of categories);
    Yates' correction when K = 2 (one degree of freedom); score 1 − p."""
    c = (df.where(F.col(col).isNotNull()).groupBy(col)
         .agg(F.count_if(F.col(sample_col) == CUR).alias("o"), F.count_if(F.col(sample_col) == REF).alias("e")))
    t = c.agg(F.sum("o").alias("__to"), F.sum("e").alias("__te"), F.count(F.lit(1)).alias("__k"))
    j = c.crossJoin(F.broadcast(t))
    tot = F.col("__to") + F.col("__te")
    col_t = F.col("o") + F.col("e")
    eo, ee = F.col("__to") * col_t / tot, F.col("__te") * col_t / tot
    corr = F.when(F.col("__k") == 2, 0.5).otherwise(0.0)
    def cell(obs, exp):
        return F.pow(F.greatest(F.abs(obs - exp) - corr, F.lit(0.0)), 2) / exp
    s = j.groupBy().agg(F.sum(cell(F.col("o"), eo) + cell(F.col("e"), ee)).alias("chi2"),
                        (F.first("__k") - 1).alias("dof"))
    if with_pvalue:
        s = s.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof").cast("double"))) \
             .withColumn("chi2_score", F.when(F.col("p_value") < 1, 1 - F.col("p_value")).otherwise(0.0))
    return s


def js_categories(df: DataFrame, col: str, sample_col: str = "sample") -> DataFrame:
    """H9: Jensen–Shannon distance of the aligned category distributions, ÷ ln 2."""
    c = (df.where(F.col(col).isNotNull()).groupBy(col)
         .agg(F.count_if(F.col(sample_col) == CUR).alias("a"), F.count_if(F.col(sample_col) == REF).alias("b")))
    t = c.agg(F.sum("a").alias("__ta"), F.sum("b").alias("__tb"))
    j = c.crossJoin(F.broadcast(t))
    p, qq = F.col("a") / F.col("__ta"), F.col("b") / F.col("__tb")
    m = (p + qq) / 2
    rel = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return j.agg((F.sqrt((F.sum(rel(p)) + F.sum(rel(qq))) / 2) / math.log(2)).alias("js_distance"))


# ------------------------------------------------------------------ H12–H14
# Default threshold and per-feature overrides.
DEFAULT_DRIFT_THRESHOLD = 0.2
FEATURE_THRESHOLDS = {"glucose": 0.15, "bmi": 0.2, "age": 0.1, "blood_pressure": 0.15}


def feature_drift_scores(long: DataFrame, methods=("wasserstein", "ks", "psi"), threshold: float = DEFAULT_DRIFT_THRESHOLD,
                         overrides: dict | None = None, ks_score: str = "pvalue") -> DataFrame:
    """Per feature the max of the chosen method scores; drifted if above its threshold.

    ``ks_score='pvalue'`` uses 1 − p (the reference's score, which saturates
    on large tables); ``'statistic'`` uses D itself.
    """
    overrides = FEATURE_THRESHOLDS if overrides is None else overrides
    parts = []
    if "wasserstein" in methods:
        parts.append(wasserstein(long).select("feature", F.col("wasserstein_score").alias("s")))
    if "ks" in methods:
        k = ks_two_sample(long, with_pvalue=(ks_score == "pvalue"))
        parts.append(k.select("feature", F.col("ks_score" if ks_score == "pvalue" else "ks_statistic").alias("s")))
    if "psi" in methods:
        parts.append(psi_decile(long).select("feature", F.col("psi").alias("s")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    spark = long.sparkSession
    th = spark.createDataFrame([(k, float(v)) for k, v in overrides.items()] or [("", 0.0)],
                               "feature string, threshold double")
    g = u.groupBy("feature").agg(F.max("s").alias("drift_score"))
    return (g.join(F.broadcast(th), "feature", "left")
            .select("feature", "drift_score", F.coalesce("threshold", F.lit(threshold)).alias("threshold"))
            .withColumn("drifted", F.col("drift_score") > F.col("threshold")))


# Recommendations of a drift report, by the kind of drift.
NO_DRIFT = "No drift detected. Continue monitoring."
DRIFT_ADVICE = {
    "data": ["Consider retraining model with new data", "Review data pipeline for changes",
             "Validate data quality and consistency"],
    "model": ["Model performance may be degrading", "Consider model retraining or recalibration",
              "Evaluate model on recent data"],
    "concept": ["Feature-target relationship has changed", "Consider feature engineering review",
                "Explore alternative model architectures"],
}


def drift_report(scores: DataFrame, threshold: float = DEFAULT_DRIFT_THRESHOLD, top: int = 5,
                 drift_type: str = "data") -> DataFrame:
    """Mean score, detected, severity (high > 2t, medium > t, low), top features, recommendations.

    Features of one score are listed by name. A kind of drift without advice of its own has the general sentences only.
    """
    top_arr = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("drift_score")).alias("k"),
                                                                        F.col("feature").alias("f")))),
                                  lambda x: x["f"]), 1, top)
    r = scores.agg(F.avg("drift_score").alias("mean_score"), F.max(F.col("drifted").cast("int")).alias("__d"),
                   F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
                   top_arr.alias("top_features"))
    sev = (F.when(F.col("mean_score") > 2 * threshold, "high").when(F.col("mean_score") > threshold, "medium")
           .otherwise("low"))
    found = F.array(F.concat(F.lit("Drift detected in "), F.size("drifted_features").cast("string"), F.lit(" features")),
                    F.concat(F.lit("Top drifted features: "), F.array_join("top_features", ", ")),
                    *[F.lit(x) for x in DRIFT_ADVICE.get(drift_type, [])])
    recs = F.when(F.size("drifted_features") == 0, F.array(F.lit(NO_DRIFT))).otherwise(found)
    return r.select("mean_score", (F.col("__d") == 1).alias("drift_detected"), sev.alias("severity"),
                    "drifted_features", "top_features", recs.alias("recommendations"))


def comprehensive_drift(long: DataFrame) -> DataFrame:
    """Per feature PSI (H7), KL, JS, KS statistic; drifted when psi>.2 or kl>.1 or js>.1 or ks>.1."""
    p = psi_smoothed(long)
    k = kl_histogram(long)
    j = js_histogram(long)
    s = ks_two_sample(long, with_pvalue=False).select("feature", "ks_statistic")
    a = p.join(k, "feature").join(j, "feature").join(s, "feature")
    return a.withColumn("drifted", (F.col("psi") > 0.2) | (F.col("kl") > 0.1) | (F.col("js") > 0.1)
                        | (F.col("ks_statistic") > 0.1))


def comprehensive_verdict(per_feature: DataFrame) -> DataFrame:
    share = F.avg(F.col("drifted").cast("double"))
    return per_feature.agg(share.alias("drift_share"), F.count(F.lit(1)).alias("n_features")).select(
        "*", F.when(F.col("drift_share") > 0.3, "HIGH").when(F.col("drift_share") > 0.15, "MEDIUM").otherwise("LOW")
        .alias("overall_drift"))


def model_drift(current: DataFrame, baseline: DataFrame, threshold: float = DEFAULT_DRIFT_THRESHOLD) -> DataFrame:
    """Relative change per metric vs baseline (absolute when the baseline is 0)."""
    j = current.select("metric", F.col("value").alias("cur")).join(
        baseline.select("metric", F.col("value").alias("base")), "metric")
    ch = F.when(F.col("base") == 0, F.abs(F.col("cur") - F.col("base"))).otherwise(
        F.abs(F.col("cur") - F.col("base")) / F.abs(F.col("base")))
    return j.withColumn("change", ch).withColumn("drifted", F.col("change") > threshold)


def concept_drift(df: DataFrame, order: list[str], y_true: str, y_pred: str, window: int = 100, step: int = 50,
                  drop: float = 0.15) -> DataFrame:
    """Accuracy in windows of ``window`` rows every ``step`` rows (start < n − window);
    drift when the last three windows' mean is ``drop`` below the earlier mean.

    Row numbers come from a prefix sum over the order key, so each row knows
    the (at most window/step) windows it belongs to: ``explode(sequence)``.
    """
    base = df.select(*order, (F.col(y_true) == F.col(y_pred)).cast("double").alias("__ok"))
    key = order[0]
    cnt = base.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    cum = cumulative_sums(cnt, key, ["__c"])
    w = Window.partitionBy(key).orderBy(*order[1:] or [key])
    j = base.join(cum.select(key, (F.col("cum___c") - F.col("__c")).alias("__before")), key)
    j = j.withColumn("__rn", F.col("__before") + F.row_number().over(w) - 1)  # 0-based position
    n = cnt.agg(F.sum("__c").alias("__n"))
    j = j.crossJoin(F.broadcast(n))
    per = max(1, window // step)
    first = F.greatest(F.lit(0), F.ceil((F.col("__rn") - window + 1) / step))
    wins = F.sequence(first.cast("int"), F.least(F.floor(F.col("__rn") / step), first + per).cast("int"))
    e = j.select("__ok", "__rn", "__n", F.explode(wins).alias("win"))
    e = e.where((F.col("win") * step < F.col("__n") - window) & (F.col("__rn") >= F.col("win") * step)
                & (F.col("__rn") < F.col("win") * step + window))
    acc = e.groupBy("win").agg(F.avg("__ok").alias("accuracy"))
    last = acc.agg(F.max("win").alias("__last"))
    r = acc.crossJoin(F.broadcast(last))
    recent = F.col("win") > F.col("__last") - 3
    s = r.agg(F.avg(F.when(recent, F.col("accuracy"))).alias("recent_accuracy"),
              F.avg(F.when(~recent, F.col("accuracy"))).alias("earlier_accuracy"),
              F.count(F.lit(1)).alias("n_windows"))
    return s.select("*", F.coalesce((F.col("n_windows") > 3) &
                                    (F.col("earlier_accuracy") - F.col("recent_accuracy") > drop),
                                    F.lit(False)).alias("concept_drift"))


def drift_history_summary(runs: DataFrame, as_of: Column, days: int = 30, threshold: float = DEFAULT_DRIFT_THRESHOLD,
                          top: int = 10) -> DataFrame:
    """Over the last ``days``: reports, detected ratio, latest score / severity, top drifted features."""
    recent = runs.where(F.col("run_date") > F.date_sub(as_of, days))
    s = recent.agg(F.count(F.lit(1)).alias("n_reports"),
                   F.avg((F.col("drift_score") > threshold).cast("double")).alias("detected_ratio"),
                   F.max_by("drift_score", F.struct("run_date", "run_id")).alias("latest_score"))
    s = s.withColumn("latest_severity", F.when(F.col("latest_score") > 2 * threshold, "high")
                     .when(F.col("latest_score") > threshold, "medium").otherwise("low"))
    feats = (recent.where(F.col("drift_score") > threshold).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
             .agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("feature").alias("f")))),
                                      lambda x: x["f"]), 1, top).alias("top_features")))
    return s.crossJoin(feats)


def drift_checks(runs: DataFrame, threshold: float = DEFAULT_DRIFT_THRESHOLD, day: str = "run_date") -> DataFrame:
    """One check a day from per-feature scores: a feature drifts if its highest score of the day passes ``threshold``;
    the overall risk follows H14 (HIGH above 30 % of features, MEDIUM above 15 %). Rows without a day are left out."""
    each = (runs.where(F.col(day).isNotNull()).groupBy(day, "feature")
            .agg((F.max("drift_score") > threshold).alias("drifted")))
    share = F.avg(F.coalesce(F.col("drifted"), F.lit(False)).cast("double"))
    checks = each.groupBy(day).agg(share.alias("drift_share"), F.array_sort(F.collect_list(
        F.when(F.col("drifted"), F.col("feature")))).alias("drifting_features"))
    return checks.withColumn("overall_risk", F.when(F.col("drift_share") > 0.3, "HIGH")
                             .when(F.col("drift_share") > 0.15, "MEDIUM").otherwise("LOW"))


def recent_drift_checks(checks: DataFrame, n: int = 10, day: str = "run_date") -> DataFrame:
    """All checks, the last ``n`` and how many of them are HIGH, and the newest one's risk and drifting features.

    The last ``n`` are a top-k, so no task sorts the history. Without checks the newest risk is UNKNOWN.
    """
    total = checks.agg(F.count(F.lit(1)).alias("total_checks"))
    last = checks.orderBy(F.col(day).desc()).limit(n).agg(
        F.count(F.lit(1)).alias("recent_checks"), F.count_if(F.col("overall_risk") == "HIGH").alias("recent_drift_count"),
        F.max_by("overall_risk", day).alias("overall_risk"), F.max_by("drifting_features", day).alias("drifting_features"))
    return total.crossJoin(last).select(  # one row each
        "total_checks", "recent_checks", "recent_drift_count", F.coalesce("overall_risk", F.lit("UNKNOWN")).alias("overall_risk"),
        F.coalesce("drifting_features", F.array().cast("array<string>")).alias("drifting_features"))


def safe_rate(a, b):
    return safe_div(a, b)


# ------------------------------------------------------------------ H3
# Abramowitz–Stegun 7.1.26 coefficients for erf (|error| < 1.5e−7).
_ERF_P = 0.3275911
_ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def erf(x: Column) -> Column:
    ax = F.abs(x)
    t = 1.0 / (1.0 + _ERF_P * ax)
    poly = t * (_ERF_A[0] + t * (_ERF_A[1] + t * (_ERF_A[2] + t * (_ERF_A[3] + t * _ERF_A[4]))))
    y = 1.0 - poly * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


FAMILIES = ("normal", "exponential", "uniform", "gamma", "beta")


def _fitted(prm: DataFrame, long: DataFrame) -> DataFrame:
    """``prm`` (one row a column) plus the gamma and beta parameters fitted by maximum likelihood, null where none exists.

    Gamma starts at 0 and needs positive values. Beta spans the values' range widened by 1 / n of it on both sides, so that
    the logarithms of the extremes are finite.
    """
    from sparkclin.operators.distributions import fit_beta, fit_gamma
    pad = (F.col("__hi") - F.col("__lo")) / F.col("__n")
    prm = prm.withColumn("__b0", F.col("__lo") - pad).withColumn("__bw", F.col("__hi") - F.col("__lo") + 2 * pad)
    z = F.try_divide(F.col("value") - F.col("__b0"), F.col("__bw"))
    logs = (long.join(F.broadcast(prm.select("feature", "__b0", "__bw")), "feature").groupBy("feature").agg(
        F.when(F.min("value") > 0, F.avg(F.log(F.when(F.col("value") > 0, F.col("value"))))).alias("__ml"),
        F.avg(z).alias("__bm"), F.var_pop(z).alias("__bv"), F.avg(F.log(z)).alias("__bl"), F.avg(F.log(1 - z)).alias("__bl1")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        for name in ("__k", "__theta", "__a", "__b"):
            pdf[name] = math.nan
        for i, r in pdf.iterrows():
            g = fit_gamma(r["__m"], None if pd.isna(r["__ml"]) else r["__ml"])
            e = None if pd.isna(r["__bm"]) else fit_beta(r["__bm"], r["__bv"], r["__bl"], r["__bl1"])
            if g:
                pdf.loc[i, ["__k", "__theta"]] = g
            if e:
                pdf.loc[i, ["__a", "__b"]] = e
        return pdf[["feature", "__k", "__theta", "__a", "__b"]].astype({"feature": str})

    solved = prm.join(logs, "feature").groupBy("feature").applyInPandas(fit, "feature string, __k double, __theta double, __a double, __b double")
    return prm.join(solved, "feature")


@F.pandas_udf(DoubleType())
def _gamma_cdf(x: pd.Series, k: pd.Series, theta: pd.Series) -> pd.Series:
    from sparkclin.operators.distributions import gamma_cdf
    out = pd.Series(math.nan, index=x.index)
    for (shape, scale), part in x.groupby([k, theta]):  # one parameter pair a column
        out[part.index] = gamma_cdf(part.to_numpy() / scale, shape)
    return out


@F.pandas_udf(DoubleType())
def _beta_cdf(z: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    from sparkclin.operators.distributions import beta_cdf
    out = pd.Series(math.nan, index=z.index)
    for (p, r), part in z.groupby([a, b]):
        out[part.index] = beta_cdf(part.to_numpy(), p, r)
    return out


def fit_distribution(df: DataFrame, cols: list[str], families: tuple[str, ...] = FAMILIES, with_pvalue: bool = True) -> DataFrame:
    """H3: one-sample KS statistic (``d_<family>``) and p-value (``p_<family>``) of each column against fitted families.

    Normal (mean, population std), exponential (loc = min, scale = mean − min), uniform (min, max), gamma and beta by maximum
    likelihood; ``best_fit`` has the largest p-value, which at equal n is the smallest D. A family that can't be
    fitted (gamma of values that aren't all positive, any of a constant column) is null and never best.

    Ranks come from prefix sums over distinct values, so D is exact with ties
    and no step sorts a whole column in one task.
    """
    long = stack_columns(df.select(*cols), [], cols).where(F.col("value").isNotNull())
    prm = long.groupBy("feature").agg(F.count(F.lit(1)).alias("__n"), F.avg("value").alias("__m"),
                                      F.stddev_pop("value").alias("__s"), F.min("value").alias("__lo"),
                                      F.max("value").alias("__hi"))
    if {"gamma", "beta"} & set(families):
        prm = stored(_fitted(prm, long), "fits")  # one row a column
    cnt = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    cum = cumulative_sums(cnt, "value", ["c"], ["feature"]).join(F.broadcast(prm), "feature")
    v, n = F.col("value"), F.col("__n")
    cdfs = {
        "normal": lambda: 0.5 * (1 + erf((v - F.col("__m")) / (F.col("__s") * math.sqrt(2.0)))),
        "exponential": lambda: F.when(v < F.col("__lo"), 0.0).otherwise(1 - F.exp(-(v - F.col("__lo")) / (F.col("__m") - F.col("__lo")))),
        "uniform": lambda: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))),
        "gamma": lambda: _gamma_cdf(v, F.col("__k"), F.col("__theta")),
        "beta": lambda: _beta_cdf(F.try_divide(v - F.col("__b0"), F.col("__bw")), F.col("__a"), F.col("__b")),
    }
    varies = F.col("__hi") > F.col("__lo")
    cum = cum.select("feature", "c", "cum_c", "__n", *[F.nanvl(F.when(varies, cdfs[k]()), F.lit(None).cast("double")).alias(f"f_{k}")
                                                       for k in families])

    def d_of(k: str) -> Column:
        fx = F.col(f"f_{k}")
        return F.when(fx.isNotNull(), F.greatest(fx - (F.col("cum_c") - F.col("c")) / F.col("__n"), F.col("cum_c") / F.col("__n") - fx))
    d = cum.groupBy("feature").agg(F.first("__n").alias("__n"), *[F.max(d_of(k)).alias(f"d_{k}") for k in families])
    tried = F.array(*[F.when(F.col(f"d_{k}").isNotNull(), F.struct(F.col(f"d_{k}").alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")))
                      for i, k in enumerate(families)])
    best = F.get(F.array_sort(F.array_compact(tried)), F.lit(0))["k"]
    p = [F.when(F.col(f"d_{k}").isNotNull(), kolmogorov_pvalue(F.sqrt("__n") * F.col(f"d_{k}"))).alias(f"p_{k}")
         for k in families] if with_pvalue else []
    return d.select("feature", *[f"d_{k}" for k in families], *p, best.alias("best_fit"))
