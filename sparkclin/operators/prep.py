"""Imputation, feature selection scores, PCA, splits, preprocessing report.

Fits are aggregates (one row of constants, broadcast back); selection
scores come from one unpivot + group-by over (feature, class), so the work
is a single shuffle of tiny partial aggregates regardless of row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.functions.exprs import (column_quantiles, cumulative_sums, md5_bucket, q, quantiles_long,
                                      stack_columns, with_constants)


def impute_fit(df: DataFrame, cols: list[str], strategy: str = "median", approx: bool = False) -> DataFrame:
    """One-row frame of fill values fitted on ``df`` (training rows)."""
    if strategy == "mean":
        return df.agg(*[F.avg(q(c)).alias(c) for c in cols])
    if strategy == "median":
        qs = column_quantiles(df, cols, [0.5], approx)
        return qs.select(*[F.col(f"__q_{i}")[0].alias(c) for i, c in enumerate(cols)])
    if strategy == "most_frequent":
        # Most frequent value, smallest value on ties; one small group-by per column.
        parts = []
        for c in cols:
            cnt = df.where(F.col(q(c)).isNotNull()).groupBy(q(c)).agg(F.count(F.lit(1)).alias("n"))
            parts.append(cnt.agg(F.max_by(F.col(q(c)), F.struct(F.col("n"), -F.col(q(c)))).cast("double").alias(c)))
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)
        return out
    raise ValueError(strategy)


def impute_apply(df: DataFrame, fitted: DataFrame) -> DataFrame:
    cols = fitted.columns
    j = with_constants(df, fitted.select(*[F.col(q(c)).alias(f"__f_{i}") for i, c in enumerate(cols)]))
    rep = {c: F.coalesce(F.col(q(c)).cast("double"), F.col(f"__f_{i}")) for i, c in enumerate(cols)}
    return j.select(*[rep.get(c, F.col(q(c))).alias(c) for c in df.columns])


def impute_simple(df: DataFrame, cols: list[str], strategy: str = "median",
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with the mean / median / mode fitted on ``fit_on`` (default ``df``)."""
    return impute_apply(df, impute_fit(fit_on if fit_on is not None else df, cols, strategy))


def impute_iterative(df: DataFrame, cols: list[str], max_iter: int = 10) -> DataFrame:
    """Round-robin linear regression of each incomplete column on the others.

    Starts from mean imputation; each round fits ``LinearRegression`` per
    incomplete column on observed rows and replaces only the originally
    missing cells. Lineage is cut every round with ``checkpoint()`` (the
    shared ``spark.checkpoint.dir``), so executor loss replays one round.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from sparkclin.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    miss = {c: f"__miss_{i}" for i, c in enumerate(cols)}
    cur = df.select("*", *[F.col(q(c)).isNull().alias(m) for c, m in miss.items()])
    cur = impute_apply(cur, impute_fit(df, cols, "mean"))
    incomplete = [c for c in cols]
    for _ in range(max_iter):
        for c in incomplete:
            others = [o for o in cols if o != c]
            va = VectorAssembler(inputCols=others, outputCol="__x", handleInvalid="keep")
            train = va.transform(cur.where(~F.col(miss[c])))
            model = LinearRegression(featuresCol="__x", labelCol=c, predictionCol="__p", regParam=0.0).fit(train)
            cur = model.transform(va.transform(cur)).withColumn(
                c, F.when(F.col(miss[c]), F.col("__p")).otherwise(F.col(q(c)))).drop("__x", "__p")
        cur = cur.checkpoint(eager=True)
    return cur.drop(*miss.values())


def _long(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    return stack_columns(df.select(target, *cols), [target], cols).where(F.col("value").isNotNull())


def select_k_best_f(df: DataFrame, cols: list[str], target: str, k: int = 15) -> DataFrame:
    """One-way ANOVA F per feature against the class; top-k by F (name breaks ties)."""
    g = _long(df, cols, target).groupBy("feature", target).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    t = g.groupBy("feature").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"), F.sum("s").alias("S"), F.sum("ss").alias("SS"),
        F.sum(F.col("s") ** 2 / F.col("n")).alias("between_raw"))
    ssb = F.col("between_raw") - F.col("S") ** 2 / F.col("N")
    ssw = F.col("SS") - F.col("between_raw")
    f = (ssb / (F.col("K") - 1)) / (ssw / (F.col("N") - F.col("K")))
    scored = t.select("feature", f.alias("f_score"))
    return _top_k(scored, "f_score", k)


def _top_k(scored: DataFrame, score: str, k: int) -> DataFrame:
    # Feature-level table: one row per input column, so this window is over a handful of rows.
    w = Window.orderBy(F.col(score).desc_nulls_last(), F.col("feature"))
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)


def select_k_best_chi2(df: DataFrame, cols: list[str], target: str, k: int = 15) -> DataFrame:
    """chi² of class-wise feature sums against their expectation (non-negative features)."""
    lg = _long(df, cols, target)
    obs = lg.groupBy("feature", target).agg(F.sum("value").alias("o"))
    cls = df.groupBy(target).agg(F.count(F.lit(1)).alias("nc"))
    tot = cls.agg(F.sum("nc").alias("n"))
    fsum = obs.groupBy("feature").agg(F.sum("o").alias("fs"))
    j = obs.join(cls, target).crossJoin(F.broadcast(tot)).join(fsum, "feature")
    e = F.col("fs") * F.col("nc") / F.col("n")
    scored = j.groupBy("feature").agg(F.sum(F.pow(F.col("o") - e, 2) / e).alias("chi2_score"))
    return _top_k(scored, "chi2_score", k)


def select_k_best_mi(df: DataFrame, cols: list[str], target: str, k: int = 15, n_bins: int = 10) -> DataFrame:
    """Mutual information (nats) between the class and each feature's quantile bin."""
    probs = ", ".join(str(i / n_bins) for i in range(1, n_bins))
    lg = _long(df, cols, target)
    edges = quantiles_long(lg, [i / n_bins for i in range(1, n_bins)], ["feature"]).withColumnRenamed("__q", "__e")
    b = lg.join(F.broadcast(edges), "feature").select(
        "feature", target, F.size(F.filter("__e", lambda e: F.col("value") >= e)).alias("bin"))
    joint = b.groupBy("feature", "bin", target).agg(F.count(F.lit(1)).alias("nxy"))
    w_f = Window.partitionBy("feature")
    j = (joint.withColumn("n", F.sum("nxy").over(w_f))
         .withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "bin")))
         .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", target))))
    mi = j.groupBy("feature").agg(F.sum(F.col("nxy") / F.col("n") * F.log(
        F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi_score"))
    return _top_k(mi, "mi_score", k)


def pca_transform(df: DataFrame, cols: list[str], k: int | None = None, variance: float = 0.95,
                  prefix: str = "PC") -> tuple[DataFrame, DataFrame]:
    """Centred PCA (Spark ML); k given, else fewest components reaching ``variance``.

    Returns (projected rows, explained-variance table). Component signs are
    normalised so each loading vector's largest-magnitude entry is positive.
    The fit reads complete rows; a row with a null among ``cols`` stays, with null components.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    va = VectorAssembler(inputCols=cols, outputCol="__x", handleInvalid="skip")
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(q(c)).isNotNull() & ~F.isnan(F.col(q(c)).cast("double"))
    x = va.transform(df.where(whole))
    sc = StandardScaler(inputCol="__x", outputCol="__c", withMean=True, withStd=False).fit(x)
    xc = sc.transform(x)
    kmax = len(cols)
    full = PCA(k=kmax, inputCol="__c", outputCol="__p").fit(xc)
    ev = list(full.explainedVariance.toArray())
    if k is None:
        acc, k = 0.0, kmax
        for i, v in enumerate(ev):
            acc += v
            if acc >= variance:
                k = i + 1
                break
    k = min(k, kmax)
    pc = full.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(kmax)]
    proj = full.transform(xc).withColumn("__a", vector_to_array("__p"))
    out = proj.select(*df.columns, *[(F.col("__a")[j] * signs[j]).alias(f"{prefix}{j + 1}") for j in range(k)])
    out = out.unionByName(df.where(~whole), allowMissingColumns=True)
    spark = df.sparkSession
    var_tbl = spark.createDataFrame([(j + 1, float(v)) for j, v in enumerate(ev)], "component int, explained_variance double")
    return out, var_tbl


def split_train_test(df: DataFrame, key: str, test: float = 0.2, validation: float = 0.1,
                     target: str | None = None) -> DataFrame:
    """Deterministic split column from an md5 bucket of the key.

    With ``target`` the split is stratified: each class is ordered by the
    hash and cut at the configured fractions of its own size (prefix sums
    over (class, hash) counts, no global window).
    """
    h = md5_bucket(F.col(key), 1 << 30).cast("double")
    if target is None:
        u = h / float(1 << 30)
        return df.withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation")
                             .otherwise("train"))
    base = df.withColumn("__h", h)
    cnt = base.groupBy(target, "__h").agg(F.count(F.lit(1)).alias("__c"))
    cum = cumulative_sums(cnt, "__h", ["__c"], [target])
    n = cnt.groupBy(target).agg(F.sum("__c").alias("__n"))
    pos = cum.join(F.broadcast(n), target).select(target, "__h", ((F.col("cum___c") - F.col("__c") / 2.0) /
                                                                  F.col("__n")).alias("__u"))
    j = base.join(pos, [target, "__h"])
    return j.withColumn("split", F.when(F.col("__u") < test, "test")
                        .when(F.col("__u") < test + validation, "validation").otherwise("train")).drop("__h", "__u")


def preprocessing_report(before: DataFrame, after: DataFrame, target: str = "target") -> DataFrame:
    """Long-form before/after report: shape, missing per column, class distribution, new features."""
    spark = before.sparkSession
    def side(df, name):
        shape = df.agg(F.count(F.lit(1)).cast("double").alias("v")).select(
            F.lit(name).alias("stage"), F.lit("rows").alias("metric"), F.lit(None).cast("string").alias("item"),
            F.col("v").alias("value"))
        ncols = spark.range(1).select(F.lit(name).alias("stage"), F.lit("columns").alias("metric"),
                                      F.lit(None).cast("string").alias("item"),
                                      F.lit(float(len(df.columns))).alias("value"))
        miss = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(c) for c in df.columns]).select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(q(c)).cast("double").alias("value"))
                                for c in df.columns])).alias("s")).select(
            F.lit(name).alias("stage"), F.lit("missing").alias("metric"), "s.item", "s.value")
        dist = (df.groupBy(target).agg(F.count(F.lit(1)).cast("double").alias("value"))
                .select(F.lit(name).alias("stage"), F.lit("class_count").alias("metric"),
                        F.col(target).cast("string").alias("item"), "value"))
        return shape.unionByName(ncols).unionByName(miss).unionByName(dist)
    new = [c for c in after.columns if c not in before.columns]
    newf = spark.createDataFrame([("after", "new_feature", c, 1.0) for c in new],
                                 "stage string, metric string, item string, value double")
    return side(before, "before").unionByName(side(after, "after")).unionByName(newf)


class PreprocessPipeline:
    """Features → impute → scale → select → (PCA), fitted on training rows and replayed.

    Fitted state is small and per feature (fill values, means / std, the
    selected names, an optional PCA model), taken from one-row aggregates;
    ``transform`` is a pure projection, so scoring new data never refits.
    ``balanced`` adds synthetic rows of the smaller classes (D20–D22) to the
    transformed training rows; new data is never balanced.
    """

    def __init__(self, cols: list[str], target: str, impute: str = "median", k_best: int | None = 10,
                 pca_k: int | None = None, add_features: bool = True):
        self.cols, self.target, self.impute, self.k_best = list(cols), target, impute, k_best
        self.pca_k, self.add_features = pca_k, add_features

    def _features(self, df: DataFrame) -> DataFrame:
        from sparkclin.operators.features import clinical_features
        return clinical_features(df) if self.add_features else df

    def fit(self, df: DataFrame) -> "PreprocessPipeline":
        x = self._features(df)
        from sparkclin.functions.exprs import numeric_columns
        self.feature_cols = [c for c in numeric_columns(x) if c != self.target and (c in self.cols or c not in df.columns)]
        self.fill = impute_fit(x, self.feature_cols, self.impute).first().asDict()
        filled = x.fillna({k: v for k, v in self.fill.items() if v is not None})
        st = filled.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(self.feature_cols)],
                        *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(self.feature_cols)]).first()
        self.means = {c: st[f"m{i}"] for i, c in enumerate(self.feature_cols)}
        self.stds = {c: (st[f"s{i}"] or 1.0) or 1.0 for i, c in enumerate(self.feature_cols)}
        scaled = self._scale(filled)
        if self.k_best:
            sel = select_k_best_f(scaled, self.feature_cols, self.target, self.k_best)
            self.selected = [r.feature for r in sel.where("selected").orderBy("rank").collect()]
        else:
            self.selected = list(self.feature_cols)
        self.pca = None
        if self.pca_k:
            from pyspark.ml.feature import PCA, VectorAssembler
            va = VectorAssembler(inputCols=self.selected, outputCol="__x")
            self.pca = PCA(k=min(self.pca_k, len(self.selected)), inputCol="__x", outputCol="__p").fit(va.transform(scaled))
        return self

    def _scale(self, df: DataFrame) -> DataFrame:
        rep = {c: (F.col(q(c)) - F.lit(self.means[c])) / F.lit(self.stds[c]) for c in self.feature_cols}
        return df.select(*[rep.get(c, F.col(q(c))).alias(c) for c in df.columns])

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        x = self._scale(self._features(df).fillna({k: v for k, v in self.fill.items() if v is not None}))
        keep = list(keep or [])
        if self.pca is None:
            return x.select(*keep, *self.selected)
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        p = self.pca.transform(VectorAssembler(inputCols=self.selected, outputCol="__x").transform(x))
        p = p.withColumn("__a", vector_to_array("__p"))
        return p.select(*keep, *[F.col("__a")[i].alias(f"pca_{i + 1}") for i in range(self.pca.getK())])

    def balanced(self, df: DataFrame, id_col: str, method: str = "smote", k: int = 5, seed: int = 42) -> DataFrame:
        """The transformed rows of ``df`` and synthetic ones: id, copy (0: an original), the features, target.

        Neighbours are sought among transformed rows, so every feature weighs alike. Rows without id or target, and rows
        whose feature has no fill value, are left out.
        """
        from sparkclin.operators.balance import balance
        rows = self.transform(df, keep=[id_col, self.target])
        return balance(rows, self.target, [c for c in rows.columns if c not in (id_col, self.target)], id_col, method, k, seed=seed)
