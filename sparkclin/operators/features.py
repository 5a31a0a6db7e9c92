"""Feature engineering as column expressions, windows and fitted constants.

Row-wise features are pure projections (codegen). Fitted transforms
(scalers, quantile bins, frequency encoding) compute their constants in one
aggregate and attach them as a one-row broadcast. Time-series features use
windows partitioned by entity, never a global window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.functions.exprs import column_quantiles, cumulative_sums, q, with_constants
from sparkclin.operators.keyed import CHUNK, HOT, HOT_ROWS, REAL, carried, cut, is_cut, join_same, with_halo
from sparkclin.session import stored

# Bin edges and labels (right-closed intervals).
BMI_BINS = ([0, 18.5, 24.9, 29.9, 100], ["underweight", "normal", "overweight", "obese"])
GLUCOSE_BINS = ([0, 70, 100, 126, 300], ["low", "normal", "pre_diabetic", "diabetic"])
BP_BINS = ([0, 60, 80, 90, 200], ["low", "normal", "pre_hypertensive", "hypertensive"])
AGE_LABELS = ["young", "middle", "senior", "elderly"]


def age_bins(top: int = 120):
    return ([0, 30, 45, 60, top], AGE_LABELS)


def interaction_features(df: DataFrame) -> DataFrame:
    """glucose/(bmi+1e-6), age·glucose, glucose·bmi, bmi·blood_pressure (where present)."""
    c = set(df.columns)
    out = []
    if {"glucose", "bmi"} <= c:
        out += [(F.col("glucose") / (F.col("bmi") + 1e-6)).alias("glucose_bmi_ratio"),
                (F.col("glucose") * F.col("bmi")).alias("glucose_bmi_interaction")]
    if {"age", "glucose"} <= c:
        out.append((F.col("age") * F.col("glucose")).alias("age_glucose_interaction"))
    if {"bmi", "blood_pressure"} <= c:
        out.append((F.col("bmi") * F.col("blood_pressure")).alias("bmi_bp_interaction"))
    return df.select("*", *out)


def bin_column(col: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (lo, hi]; values outside every bin (or NULL) give NULL."""
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col > lo) & (col <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def threshold_flag(col: Column, threshold: float) -> Column:
    """D3: 1 when col > threshold, else 0 (NULL → 0)."""
    return F.coalesce((col > threshold).cast("int"), F.lit(0))


def threshold_flags(df: DataFrame) -> DataFrame:
    c = set(df.columns)
    out = []
    for src, t, name in [("bmi", 25, "bmi_risk"), ("glucose", 126, "glucose_risk"),
                         ("blood_pressure", 80, "bp_risk"), ("cholesterol", 240, "chol_high")]:
        if src in c:
            out.append(threshold_flag(F.col(src), t).alias(name))
    return df.select("*", *out)


def power_log_features(df: DataFrame) -> DataFrame:
    """bmi², age², log1p(age)."""
    c = set(df.columns)
    out = []
    if "bmi" in c:
        out.append(F.pow(F.col("bmi"), 2).alias("bmi_squared"))
    if "age" in c:
        out += [F.pow(F.col("age"), 2).alias("age_squared"), F.log1p(F.col("age")).alias("age_log")]
    return df.select("*", *out)


def one_hot(col: Column, labels: list[str], prefix: str, drop_first: bool = False) -> list[Column]:
    """One 0/1 column per label in fixed order (NULL → all 0)."""
    labs = labels[1:] if drop_first else labels
    return [F.coalesce((col == lab).cast("int"), F.lit(0)).alias(f"{prefix}_{lab}") for lab in labs]


def clinical_features(df: DataFrame, age_top: int = 120) -> DataFrame:
    """D1–D5 composed the way the feature engineer does: flags, powers, interactions,
    binned categories one-hot encoded with the first level dropped.

    Each category label is computed once in its own projection and the
    indicators compare against it, which keeps the generated code small
    enough to stay inside whole-stage codegen.
    """
    c = set(df.columns)
    out = threshold_flags(power_log_features(interaction_features(df)))
    e, lab = age_bins(age_top)
    specs = [(src, name, edges, labels) for src, name, edges, labels in [
        ("bmi", "bmi_category", *BMI_BINS), ("glucose", "glucose_category", *GLUCOSE_BINS),
        ("blood_pressure", "bp_category", *BP_BINS), ("age", "age_category", e, lab)] if src in c]
    labelled = out.select("*", *[bin_column(F.col(src), edges, labels).alias(f"__lab_{name}")
                                 for src, name, edges, labels in specs])
    cats = [col for src, name, edges, labels in specs
            for col in one_hot(F.col(f"__lab_{name}"), labels, name, True)]
    return labelled.select(*out.columns, *cats)


def group_aggregates(df: DataFrame, group_col: str, agg_cols: list[str], agg_funcs: list[str],
                     prefix: str = "agg") -> DataFrame:
    """Every (column × function) per group, named ``prefix_col_func``.

    Functions are Spark SQL aggregate names (``mean`` maps to ``avg``,
    ``std`` to ``stddev_samp``), so they run as partial aggregates.
    """
    alias = {"mean": "avg", "std": "stddev_samp", "var": "var_samp", "median": "median", "size": "count"}
    return df.groupBy(group_col).agg(*[
        F.expr(f"{alias.get(fn, fn)}({q(c)})").alias(f"{prefix}_{c}_{fn}") for c in agg_cols for fn in agg_funcs])


def rolling_aggregates(df: DataFrame, entity: str, order: list[str], value_cols: list[str],
                       windows: list[int], funcs: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """mean/std/min/max over the last w rows per entity; NULL until w values are present.

    An entity of more than ``hot_rows`` rows is cut in time; the widest frame's rows come along as a halo.
    """
    x = with_halo(cut(df, [entity], order[0], hot_rows), order, max(windows) - 1)
    base = Window.partitionBy(entity, CHUNK).orderBy(*order)
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = []
    for c in value_cols:
        for w in windows:
            ww = base.rowsBetween(-(w - 1), 0)
            full = F.count(q(c)).over(ww) >= w
            for f in funcs:
                out.append(F.when(full, fn[f](q(c)).over(ww)).alias(f"{c}_rolling_{w}_{f}"))
    made = [f"{c}_rolling_{w}_{f}" for c in value_cols for w in windows for f in funcs]
    return x.select("*", *out).where(REAL).select(*[F.col(q(c)) for c in [*df.columns, *made]])


def lag_diff_features(df: DataFrame, entity: str, order: list[str], value_cols: list[str],
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Lag 1/3/7, diff 1/3, pct_change against the forward-filled previous value.

    An entity of more than ``hot_rows`` rows is cut in time: lags read a halo of seven rows, and the value to fill forward
    is carried from chunk to chunk.
    """
    x = cut(df, [entity], order[0], hot_rows)
    carries = {}
    if is_cut(x):
        part = x.where(F.col(HOT).isNotNull())
        latest = part.groupBy(HOT, CHUNK).agg(*[F.max_by(F.when(F.col(q(c)).isNotNull(), F.struct(F.col(q(c)).alias("v"))), F.when(
            F.col(q(c)).isNotNull(), F.struct(*order))).getField("v").alias(f"__l{i}") for i, c in enumerate(value_cols)])
        latest = stored(latest, "latest")
        for i, c in enumerate(value_cols):
            x = join_same(x, carried(latest, f"__l{i}").withColumnRenamed("__carry", f"__carry{i}"), [HOT, CHUNK])
            carries[c] = F.col(f"__carry{i}")
    x = with_halo(x, order, 7)
    w = Window.partitionBy(entity, CHUNK).orderBy(*order)
    out = []
    for i, c in enumerate(value_cols):
        v = F.col(q(c))
        # Halo rows bear their own chunk's carry, but their results are dropped; a real row reads its chunk's.
        start = carries.get(c, F.lit(None).cast("double"))
        ff = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), start)
        prev = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), start)
        out += [F.lag(v, 1).over(w).alias(f"{c}_lag_1"), F.lag(v, 3).over(w).alias(f"{c}_lag_3"),
                F.lag(v, 7).over(w).alias(f"{c}_lag_7"), (v - F.lag(v, 1).over(w)).alias(f"{c}_diff_1"),
                (v - F.lag(v, 3).over(w)).alias(f"{c}_diff_3"),
                (F.try_divide(ff, prev) - F.lit(1.0)).alias(f"{c}_pct_change")]
    made = [f"{c}_{k}" for c in value_cols for k in ("lag_1", "lag_3", "lag_7", "diff_1", "diff_3", "pct_change")]
    return x.select("*", *out).where(REAL).select(*[F.col(q(c)) for c in [*df.columns, *made]])


def frequency_rank_encode(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Category → percentile rank (average ties) of its frequency among categories.

    Counts per category, then rank of each count via prefix sums over the
    distinct count values (no global window), joined back on the category.
    """
    out_col = out_col or f"{col}_embedding"
    cnt = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    per_count = cnt.groupBy("__n").agg(F.count(F.lit(1)).alias("__k"))
    cum = cumulative_sums(per_count, "__n", ["__k"])
    total = per_count.agg(F.sum("__k").alias("__tot"))
    rank = with_constants(cum, total).select(
        "__n", ((F.col("cum___k") - F.col("__k") + (F.col("__k") + 1) / 2.0) / F.col("__tot")).alias(out_col))
    enc = cnt.join(rank, "__n").select(col, out_col)
    return df.join(enc, col, "left")


def _fit_one_row(df: DataFrame, cols: list[str], stats: dict) -> DataFrame:
    return df.agg(*[fn(c).alias(f"__{k}_{i}") for i, c in enumerate(cols) for k, fn in stats.items()])


def scale_standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − mean) / population std (0 std → divide by 1, as the scaler does)."""
    st = _fit_one_row(df, cols, {"m": lambda c: F.avg(q(c)), "s": lambda c: F.stddev_pop(q(c))})
    j = with_constants(df, st)
    rep = {c: ((F.col(q(c)) - F.col(f"__m_{i}")) /
               F.when(F.col(f"__s_{i}") == 0, 1.0).otherwise(F.col(f"__s_{i}"))) for i, c in enumerate(cols)}
    return j.select(*[rep.get(c, F.col(q(c))).alias(c) for c in df.columns])


def scale_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − min) / (max − min) (0 range → divide by 1)."""
    st = _fit_one_row(df, cols, {"lo": lambda c: F.min(q(c)).cast("double"),
                                 "hi": lambda c: F.max(q(c)).cast("double")})
    j = with_constants(df, st)
    rng = lambda i: F.col(f"__hi_{i}") - F.col(f"__lo_{i}")
    rep = {c: (F.col(q(c)) - F.col(f"__lo_{i}")) / F.when(rng(i) == 0, 1.0).otherwise(rng(i))
           for i, c in enumerate(cols)}
    return j.select(*[rep.get(c, F.col(q(c))).alias(c) for c in df.columns])


def scale_robust(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """(x − median) / (Q3 − Q1), exact percentiles by default."""
    st = column_quantiles(df, cols, [0.25, 0.5, 0.75], approx, prefix="__p_")
    j = with_constants(df, st)
    iqr = lambda i: F.col(f"__p_{i}")[2] - F.col(f"__p_{i}")[0]
    rep = {c: (F.col(q(c)) - F.col(f"__p_{i}")[1]) / F.when(iqr(i) == 0, 1.0).otherwise(iqr(i))
           for i, c in enumerate(cols)}
    return j.select(*[rep.get(c, F.col(q(c))).alias(c) for c in df.columns])


def yeo_johnson(x: Column, lam) -> Column:
    lam = F.lit(lam) if not isinstance(lam, Column) else lam
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def scale_power(df: DataFrame, cols: list[str], grid: list[float] | None = None) -> DataFrame:
    """Yeo–Johnson with the maximum-likelihood λ from a grid, then standardised.

    The log-likelihood of every (column, λ) comes from one pass: each Arrow batch gives (n, mean, squared deviations) of ψ
    at every λ, computed over arrays, and those few rows are summed. No row is joined with the grid. A
    null passes through; a column without values, or constant, keeps λ = 1.
    """
    lams = [float(v) for v in (grid or [round(-2 + 0.1 * i, 1) for i in range(41)])]
    names = [f"c{i}" for i in range(len(cols))]

    def run(batches):
        for b in batches:
            for i in range(len(cols)):
                x = b.column(i).drop_null().to_numpy()
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                logs = np.sign(x) * np.log1p(np.abs(x))
                psi = [_yeo_johnson_array(x, lam) for lam in lams]
                mean = [float(v.mean()) for v in psi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(lams), pa.int32()), pa.array(lams), pa.array([len(x)] * len(lams), pa.int64()), pa.array(mean),
                     pa.array([float(((v - m) ** 2).sum()) for v, m in zip(psi, mean)]), pa.array([float(logs.sum())] * len(lams))],
                    names=["f", "lam", "n", "m", "d", "s"])

    numbers = df.select(*[F.col(q(c)).cast("double").alias(n) for c, n in zip(cols, names)])
    parts = numbers.mapInArrow(run, "f int, lam double, n long, m double, d double, s double")
    whole = parts.groupBy("f", "lam").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("m")).alias("nm"),
                                          F.sum(F.col("d") + F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    var = F.col("sq") / F.col("n") - (F.col("nm") / F.col("n")) * (F.col("nm") / F.col("n"))
    ll = (whole.withColumn("v", var).where(F.col("v") > 1e-12 * F.col("sq") / F.col("n"))
          .select("f", "lam", (-F.col("n") / 2 * F.log(F.col("v")) + (F.col("lam") - 1) * F.col("s")).alias("ll")))
    best = ll.groupBy("f").agg(F.max_by("lam", F.struct("ll", "lam")).alias("lam"))
    lam_row = best.groupBy().agg(*[F.coalesce(F.max(F.when(F.col("f") == i, F.col("lam"))), F.lit(1.0)).alias(f"__lam_{i}")
                                   for i in range(len(cols))])
    t = with_constants(df, lam_row)
    rep = {c: yeo_johnson(F.col(q(c)).cast("double"), F.col(f"__lam_{i}")) for i, c in enumerate(cols)}
    tr = t.select(*[rep.get(c, F.col(q(c))).alias(c) for c in df.columns])
    return scale_standard(tr, cols)


def _yeo_johnson_array(x: np.ndarray, lam: float) -> np.ndarray:
    up = np.log1p(np.maximum(x, 0)) if lam == 0 else (np.power(np.maximum(x, 0) + 1, lam) - 1) / lam
    down = -np.log1p(np.maximum(-x, 0)) if lam == 2 else -(np.power(np.maximum(-x, 0) + 1, 2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, up, down)


def scale_quantile(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """D14 (exact form): empirical percent rank (rank − 1)/(n − 1), ties at the lowest rank.

    Distinct values with counts → bucketed prefix sums → join back: no
    global sort into one task.
    """
    out_col = out_col or f"{col}_quantile"
    cnt = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    cum = cumulative_sums(cnt, "__v", ["__c"])
    n = cnt.agg(F.sum("__c").alias("__n"))
    pr = with_constants(cum, n).select(
        "__v", F.when(F.col("__n") <= 1, 0.0).otherwise(
            (F.col("cum___c") - F.col("__c")) / (F.col("__n") - 1)).alias(out_col))
    return df.join(pr, F.col(col) == F.col("__v"), "left").drop("__v")


def polynomial_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Degree-2 expansion without bias: xᵢ and xᵢ·xⱼ (i ≤ j)."""
    out = [F.col(q(c)).alias(f"poly_{c}") for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            out.append((F.col(q(a)) * F.col(q(b))).alias(f"poly_{a}_x_{b}"))
    return df.select("*", *out)


def quantile_bins(df: DataFrame, cols: list[str], n_bins: int = 5) -> DataFrame:
    """Equal-frequency ordinal bins from exact percentile edges (x ≥ edge counts)."""
    st = column_quantiles(df, cols, [i / n_bins for i in range(1, n_bins)], prefix="__e_")
    j = with_constants(df, st)
    def n_edges_below(c, i):
        x = F.col(q(c))
        return F.size(F.filter(f"__e_{i}", lambda e: x >= e))
    rep = {c: F.when(F.col(q(c)).isNotNull(), n_edges_below(c, i).cast("double")) for i, c in enumerate(cols)}
    return j.select(*df.columns, *[rep[c].alias(f"{c}_qbin") for c in cols])


def value_trend(df: DataFrame, entity: str, order: list[str], value_col: str, window: int = 7,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Least-squares slope of value against the row index over the last ``window`` rows.

    An entity of more than ``hot_rows`` rows is cut in time, with a halo of a frame; a slope doesn't depend on where the
    index starts, so each chunk counts its own.
    """
    x = with_halo(cut(df, [entity], order[0], hot_rows), order, window - 1)
    w = Window.partitionBy(entity, CHUNK).orderBy(*order)
    base = x.withColumn("__i", F.row_number().over(w).cast("double"))
    ww = w.rowsBetween(-(window - 1), 0)
    x, y = F.col("__i"), F.col(q(value_col)).cast("double")
    n = F.count(y).over(ww)
    sx, sy = F.sum(F.when(y.isNotNull(), x)).over(ww), F.sum(y).over(ww)
    sxx, sxy = F.sum(F.when(y.isNotNull(), x * x)).over(ww), F.sum(x * y).over(ww)
    den = n * sxx - sx * sx
    slope = F.when(den != 0, (n * sxy - sx * sy) / den)
    return (base.select("*", slope.alias(f"{value_col}_trend")).where(REAL)
            .select(*[F.col(q(c)) for c in [*df.columns, f"{value_col}_trend"]]))


def named_groups(df: DataFrame) -> DataFrame:
    """The declared feature groups (demographics, vitals, derived)."""
    e, lab = age_bins(120)
    return df.select(
        "*",
        bin_column(F.col("age"), e, lab).alias("age_group"),
        bin_column(F.col("bmi"), *BMI_BINS).alias("bmi_category"),
        (F.col("glucose") / (F.col("bmi") + 1e-6)).alias("glucose_bmi_ratio"))
