"""Registered queries for group D (features, preprocessing, feature store)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclin.operators import features as D
from sparkclin.operators import prep as P
from sparkclin.operators import store as S
from sparkclin.plans.registry import register
from sparkclin.sources.io import table
from sparkclin.sources.views import patients, scored

PC = ["age", "pregnancies", "glucose", "blood_pressure", "skin_thickness", "insulin", "bmi", "diabetes_pedigree"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _bin_sql(col, edges, labels):
    arms = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                    for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {arms} END"


_INTER = ("glucose / (bmi + 1e-6) AS glucose_bmi_ratio, glucose * bmi AS glucose_bmi_interaction, "
          "age * glucose AS age_glucose_interaction, bmi * blood_pressure AS bmi_bp_interaction")


@register("interaction_features", dbl=["glucose_bmi_ratio", "glucose_bmi_interaction", "age_glucose_interaction",
                                       "bmi_bp_interaction"], sql=f"SELECT patient_id, {_INTER} FROM patients_v")
def q_interaction_features(spark, sf):
    p = patients(spark, sf).select("patient_id", "glucose", "bmi", "age", "blood_pressure")
    return D.interaction_features(p).drop("glucose", "bmi", "age", "blood_pressure")


_AGE = D.age_bins(120)


@register("bin_column", sql=f"""
SELECT patient_id, {_bin_sql('bmi', *D.BMI_BINS)} AS bmi_category, {_bin_sql('glucose', *D.GLUCOSE_BINS)} AS glucose_category,
       {_bin_sql('blood_pressure', *D.BP_BINS)} AS bp_category, {_bin_sql('age', *_AGE)} AS age_category FROM patients_v""")
def q_bin_column(spark, sf):
    p = patients(spark, sf)
    return p.select("patient_id", D.bin_column(F.col("bmi"), *D.BMI_BINS).alias("bmi_category"),
                    D.bin_column(F.col("glucose"), *D.GLUCOSE_BINS).alias("glucose_category"),
                    D.bin_column(F.col("blood_pressure"), *D.BP_BINS).alias("bp_category"),
                    D.bin_column(F.col("age"), *_AGE).alias("age_category"))


_FLAGS = ("CAST(coalesce(bmi > 25, false) AS INTEGER) AS bmi_risk, CAST(coalesce(glucose > 126, false) AS INTEGER) AS glucose_risk, "
          "CAST(coalesce(blood_pressure > 80, false) AS INTEGER) AS bp_risk")


@register("threshold_flags", sql=f"SELECT patient_id, {_FLAGS} FROM patients_v")
def q_threshold_flags(spark, sf):
    p = patients(spark, sf).select("patient_id", "bmi", "glucose", "blood_pressure")
    return D.threshold_flags(p).drop("bmi", "glucose", "blood_pressure")


_POW = "pow(bmi, 2) AS bmi_squared, CAST(pow(age, 2) AS DOUBLE) AS age_squared, ln(1 + age) AS age_log"


@register("power_log_features", dbl=["bmi_squared", "age_squared", "age_log"],
          sql=f"SELECT patient_id, {_POW} FROM patients_v")
def q_power_log_features(spark, sf):
    p = patients(spark, sf).select("patient_id", "bmi", "age")
    return D.power_log_features(p).drop("bmi", "age")


def _onehot_sql(expr, labels, prefix, drop_first):
    labs = labels[1:] if drop_first else labels
    return ", ".join(f"CAST(coalesce({expr} = '{lab}', false) AS INTEGER) AS {prefix}_{lab}" for lab in labs)


@register("one_hot", sql=f"SELECT patient_id, {_onehot_sql(_bin_sql('bmi', *D.BMI_BINS), D.BMI_BINS[1], 'bmi', False)}, "
          f"{_onehot_sql('gender', ['male', 'female', 'other'], 'gender', False)} FROM patients_v")
def q_one_hot(spark, sf):
    p = patients(spark, sf)
    return p.select("patient_id", *D.one_hot(D.bin_column(F.col("bmi"), *D.BMI_BINS), D.BMI_BINS[1], "bmi"),
                    *D.one_hot(F.col("gender"), ["male", "female", "other"], "gender"))


_CLIN_DBL = ["glucose_bmi_ratio", "glucose_bmi_interaction", "age_glucose_interaction", "bmi_bp_interaction",
             "bmi_squared", "age_squared", "age_log"]


@register("clinical_features", dbl=_CLIN_DBL, sql=f"""
SELECT patient_id, {_INTER}, {_POW}, {_FLAGS},
  {_onehot_sql(_bin_sql('bmi', *D.BMI_BINS), D.BMI_BINS[1], 'bmi_category', True)},
  {_onehot_sql(_bin_sql('glucose', *D.GLUCOSE_BINS), D.GLUCOSE_BINS[1], 'glucose_category', True)},
  {_onehot_sql(_bin_sql('blood_pressure', *D.BP_BINS), D.BP_BINS[1], 'bp_category', True)},
  {_onehot_sql(_bin_sql('age', *_AGE), _AGE[1], 'age_category', True)}
FROM patients_v""")
def q_clinical_features(spark, sf):
    p = patients(spark, sf).select("patient_id", "glucose", "bmi", "age", "blood_pressure")
    return D.clinical_features(p).drop("glucose", "bmi", "age", "blood_pressure")


@register("group_aggregates", dbl=["agg_value_mean", "agg_value_std", "agg_value_min", "agg_value_max"], sql="""
SELECT user_id, avg(value) AS agg_value_mean, stddev_samp(value) AS agg_value_std, min(value) AS agg_value_min,
       max(value) AS agg_value_max, count(value) AS agg_value_count FROM events GROUP BY user_id""")
def q_group_aggregates(spark, sf):
    return D.group_aggregates(table(spark, sf, "events"), "user_id", ["value"], ["mean", "std", "min", "max", "count"])


def _roll_sql():
    cols = []
    for w in (3, 7):
        fr = f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for f, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cols.append(f"CASE WHEN count(value) {fr} >= {w} THEN {fn}(value) {fr} END AS value_rolling_{w}_{f}")
    return f"SELECT event_id, {', '.join(cols)} FROM events"


_ROLL_COLS = [f"value_rolling_{w}_{f}" for w in (3, 7) for f in ("mean", "std", "min", "max")]


@register("rolling_aggregates", dbl=_ROLL_COLS, sql=_roll_sql())
def q_rolling_aggregates(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return D.rolling_aggregates(e, "user_id", ["ts", "event_id"], ["value"], [3, 7],
                                ["mean", "std", "min", "max"]).drop("user_id", "ts", "value")


_LAG_COLS = ["value_lag_1", "value_lag_3", "value_lag_7", "value_diff_1", "value_diff_3", "value_pct_change"]


@register("lag_diff_features", dbl=_LAG_COLS, sql="""
WITH b AS (SELECT event_id, user_id, ts, value,
             last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff
           FROM events)
SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3, lag(value, 7) OVER w AS value_lag_7,
       value - lag(value, 1) OVER w AS value_diff_1, value - lag(value, 3) OVER w AS value_diff_3,
       ff / nullif(lag(ff, 1) OVER w, 0) - 1.0 AS value_pct_change
FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_lag_diff_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return D.lag_diff_features(e, "user_id", ["ts", "event_id"], ["value"]).drop("user_id", "ts", "value")


@register("frequency_rank_encode", dbl=["c_nationkey_embedding"], sql="""
WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey),
r AS (SELECT c_nationkey, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER () AS e FROM c)
SELECT cu.c_custkey, cu.c_nationkey, CAST(r.e AS DOUBLE) AS c_nationkey_embedding FROM customer cu LEFT JOIN r USING (c_nationkey)""")
def q_frequency_rank_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return D.frequency_rank_encode(c, "c_nationkey")


_SC3 = ["glucose", "bmi", "insulin"]


@register("scale_standard", dbl=_SC3, sql="SELECT patient_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END AS {c}"
    for c in _SC3) + " FROM patients_v")
def q_scale_standard(spark, sf):
    return D.scale_standard(patients(spark, sf).select("patient_id", *_SC3), _SC3)


@register("scale_minmax", dbl=_SC3, sql="SELECT patient_id, " + ", ".join(
    f"({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () - min({c}) OVER () = 0 THEN 1.0 "
    f"ELSE max({c}) OVER () - min({c}) OVER () END AS {c}" for c in _SC3) + " FROM patients_v")
def q_scale_minmax(spark, sf):
    return D.scale_minmax(patients(spark, sf).select("patient_id", *_SC3), _SC3)


@register("scale_robust", dbl=_SC3, sql="WITH st AS (SELECT " + ", ".join(
    f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS p_{c}" for c in _SC3) + " FROM patients_v) SELECT patient_id, " + ", ".join(
    f"({c} - p_{c}[2]) / CASE WHEN p_{c}[3] - p_{c}[1] = 0 THEN 1.0 ELSE p_{c}[3] - p_{c}[1] END AS {c}" for c in _SC3)
    + " FROM patients_v, st")
def q_scale_robust(spark, sf):
    return D.scale_robust(patients(spark, sf).select("patient_id", *_SC3), _SC3)


@register("scale_power")
def q_scale_power(spark, sf):
    return D.scale_power(patients(spark, sf).select("patient_id", *_SC3), _SC3)


@register("scale_quantile", dbl=["glucose_quantile"], sql="""
WITH v AS (SELECT glucose, count(*) AS c FROM patients_v WHERE glucose IS NOT NULL GROUP BY glucose),
r AS (SELECT glucose, CASE WHEN sum(c) OVER () <= 1 THEN 0.0 ELSE
        CAST(sum(c) OVER (ORDER BY glucose ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / (sum(c) OVER () - 1) END AS q FROM v)
SELECT p.patient_id, p.glucose, coalesce(r.q, CASE WHEN p.glucose IS NOT NULL THEN 0.0 END) AS glucose_quantile
FROM patients_v p LEFT JOIN r USING (glucose)""")
def q_scale_quantile(spark, sf):
    return D.scale_quantile(patients(spark, sf).select("patient_id", "glucose"), "glucose")


@register("polynomial_features", dbl=["poly_glucose", "poly_bmi", "poly_glucose_x_glucose", "poly_glucose_x_bmi",
                                      "poly_bmi_x_bmi"], sql="""
SELECT patient_id, age AS poly_age, glucose AS poly_glucose, bmi AS poly_bmi, age * age AS poly_age_x_age,
       age * glucose AS poly_age_x_glucose, age * bmi AS poly_age_x_bmi, glucose * glucose AS poly_glucose_x_glucose,
       glucose * bmi AS poly_glucose_x_bmi, bmi * bmi AS poly_bmi_x_bmi FROM patients_v""")
def q_polynomial_features(spark, sf):
    p = patients(spark, sf).select("patient_id", "age", "glucose", "bmi")
    return D.polynomial_features(p, ["age", "glucose", "bmi"]).drop("age", "glucose", "bmi")


_QB = ["glucose", "insulin", "bmi"]


@register("quantile_bins", dbl=[f"{c}_qbin" for c in _QB] + _QB, sql="WITH e AS (SELECT " + ", ".join(
    f"quantile_cont({c}, [0.2, 0.4, 0.6, 0.8]) AS e_{c}" for c in _QB) + " FROM patients_v) SELECT patient_id, " + ", ".join(_QB) + ", " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN CAST(len(list_filter(e_{c}, lambda x: {c} >= x)) AS DOUBLE) END AS {c}_qbin" for c in _QB)
    + " FROM patients_v, e")
def q_quantile_bins(spark, sf):
    return D.quantile_bins(patients(spark, sf).select("patient_id", *_QB), _QB)


@register("value_trend", dbl=["value_trend"], sql="""
WITH b AS (SELECT event_id, user_id, ts, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS i FROM events),
s AS (SELECT event_id, count(value) OVER w AS n, sum(CASE WHEN value IS NOT NULL THEN i END) OVER w AS sx, sum(value) OVER w AS sy,
             sum(CASE WHEN value IS NOT NULL THEN i * i END) OVER w AS sxx, sum(i * value) OVER w AS sxy
      FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS value_trend FROM s""")
def q_value_trend(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return D.value_trend(e, "user_id", ["ts", "event_id"], "value", 7).select("event_id", "value_trend")


@register("named_groups", dbl=["glucose_bmi_ratio"], sql=f"""
SELECT patient_id, {_bin_sql('age', *_AGE)} AS age_group, {_bin_sql('bmi', *D.BMI_BINS)} AS bmi_category,
       glucose / (bmi + 1e-6) AS glucose_bmi_ratio FROM patients_v""")
def q_named_groups(spark, sf):
    return D.named_groups(patients(spark, sf).select("patient_id", "age", "bmi", "glucose")).drop("age", "bmi", "glucose")


# D17
@register("impute_simple", dbl=["glucose", "blood_pressure"], sql="""
WITH f AS (SELECT quantile_cont(glucose, 0.5) AS g, quantile_cont(blood_pressure, 0.5) AS b FROM patients_v)
SELECT patient_id, coalesce(glucose, g) AS glucose, coalesce(blood_pressure, b) AS blood_pressure FROM patients_v, f""")
def q_impute_simple(spark, sf):
    return P.impute_simple(patients(spark, sf).select("patient_id", "glucose", "blood_pressure"),
                           ["glucose", "blood_pressure"], "median")


@register("impute_most_frequent", dbl=["glucose", "blood_pressure"], sql="""
WITH g AS (SELECT glucose AS v, count(*) AS n FROM patients_v WHERE glucose IS NOT NULL GROUP BY glucose),
b AS (SELECT blood_pressure AS v, count(*) AS n FROM patients_v WHERE blood_pressure IS NOT NULL GROUP BY blood_pressure),
f AS (SELECT (SELECT v FROM g ORDER BY n DESC, v ASC LIMIT 1) AS fg, (SELECT v FROM b ORDER BY n DESC, v ASC LIMIT 1) AS fb)
SELECT patient_id, coalesce(glucose, fg) AS glucose, coalesce(blood_pressure, fb) AS blood_pressure FROM patients_v, f""")
def q_impute_most_frequent(spark, sf):
    return P.impute_simple(patients(spark, sf).select("patient_id", "glucose", "blood_pressure"),
                           ["glucose", "blood_pressure"], "most_frequent")


def _long_sql(cols, src, target):
    return _union([f"SELECT '{c}' AS feature, {target} AS y, CAST({c} AS DOUBLE) AS value FROM {src} WHERE {c} IS NOT NULL"
                   for c in cols])


@register("select_k_best_f", dbl=["f_score"], sql=f"""
WITH l AS ({_long_sql(PC, 'scored_v', 'y_true')}),
g AS (SELECT feature, y, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM l GROUP BY feature, y),
t AS (SELECT feature, sum(n) AS N, count(*) AS K, sum(s) AS S, sum(ss) AS SS, sum(s * s / n) AS br FROM g GROUP BY feature),
f AS (SELECT feature, ((br - S * S / N) / (K - 1)) / ((SS - br) / (N - K)) AS f_score FROM t)
SELECT feature, f_score, CAST(row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) <= 5 AS selected FROM f""")
def q_select_k_best_f(spark, sf):
    return P.select_k_best_f(scored(spark, sf), PC, "y_true", k=5)


@register("select_k_best_chi2", dbl=["chi2_score"], sql=f"""
WITH l AS ({_long_sql(PC, 'scored_v', 'y_true')}),
o AS (SELECT feature, y, sum(value) AS o FROM l GROUP BY feature, y),
c AS (SELECT y_true AS y, count(*) AS nc FROM scored_v GROUP BY y_true),
n AS (SELECT count(*) AS n FROM scored_v),
fs AS (SELECT feature, sum(o) AS fs FROM o GROUP BY feature),
s AS (SELECT o.feature, sum(pow(o.o - fs.fs * c.nc / n.n, 2) / (fs.fs * c.nc / n.n)) AS chi2_score
      FROM o JOIN c USING (y) JOIN fs USING (feature), n GROUP BY o.feature)
SELECT feature, chi2_score, CAST(row_number() OVER (ORDER BY chi2_score DESC NULLS LAST, feature) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY chi2_score DESC NULLS LAST, feature) <= 5 AS selected FROM s""")
def q_select_k_best_chi2(spark, sf):
    return P.select_k_best_chi2(scored(spark, sf), PC, "y_true", k=5)


@register("select_k_best_mi", dbl=["mi_score"], sql=f"""
WITH l AS ({_long_sql(PC, 'scored_v', 'y_true')}),
e AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM l GROUP BY feature),
b AS (SELECT l.feature, l.y, len(list_filter(e.e, lambda x: l.value >= x)) AS bin FROM l JOIN e USING (feature)),
j AS (SELECT feature, bin, y, count(*) AS nxy FROM b GROUP BY feature, bin, y),
k AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bin) AS nx,
             sum(nxy) OVER (PARTITION BY feature, y) AS ny FROM j),
m AS (SELECT feature, sum(CAST(nxy AS DOUBLE) / n * ln(CAST(nxy AS DOUBLE) * n / (nx * ny))) AS mi_score FROM k GROUP BY feature)
SELECT feature, mi_score, CAST(row_number() OVER (ORDER BY mi_score DESC NULLS LAST, feature) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY mi_score DESC NULLS LAST, feature) <= 5 AS selected FROM m""")
def q_select_k_best_mi(spark, sf):
    return P.select_k_best_mi(scored(spark, sf), PC, "y_true", k=5)


@register("pca_transform")
def q_pca_transform(spark, sf):
    out, _ = P.pca_transform(patients(spark, sf).select("patient_id", *PC), PC, k=3)
    return out.select("patient_id", "PC1", "PC2", "PC3")


@register("split_train_test", sql="""
SELECT patient_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT patient_id, CAST(CAST('0x' || substr(md5(patient_id), 1, 8) AS BIGINT) % 1073741824 AS DOUBLE) / 1073741824.0 AS u
      FROM patients_v) t""")
def q_split_train_test(spark, sf):
    return P.split_train_test(patients(spark, sf).select("patient_id"), "patient_id")


@register("split_stratified")
def q_split_stratified(spark, sf):
    s = scored(spark, sf).select("patient_id", "y_true")
    return P.split_train_test(s, "patient_id", target="y_true").groupBy("y_true", "split").count()


@register("preprocessing_report")
def q_preprocessing_report(spark, sf):
    before = scored(spark, sf).select(*PC, F.col("y_true").alias("target"))
    after = D.clinical_features(P.impute_simple(before, ["glucose", "blood_pressure"], "median"))
    return P.preprocessing_report(before, after, "target")


@register("impute_iterative")
def q_impute_iterative(spark, sf):
    p = patients(spark, sf).select("patient_id", "glucose", "blood_pressure", "bmi", "age")
    return P.impute_iterative(p, ["glucose", "blood_pressure", "bmi", "age"], max_iter=2)


# ---------------------------------------------------------------- store
def _feature_long(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("feature"), "value", "ts",
                    F.lit("events").alias("feature_group"), "event_id")


_FL = ("SELECT user_id AS entity_id, event_type AS feature, value, ts, 'events' AS feature_group, event_id FROM events")


@register("features_of_day", dbl=["value"], sql=f"""
SELECT entity_id, feature, value, ts, feature_group, event_id, feature_date FROM (
  SELECT *, CAST(ts AS DATE) AS feature_date,
         row_number() OVER (PARTITION BY entity_id, feature_group, CAST(ts AS DATE), feature ORDER BY ts DESC, event_id DESC) AS rn
  FROM ({_FL}) f) t WHERE rn = 1""")
def q_features_of_day(spark, sf):
    return S.features_of_day(_feature_long(spark, sf), tiebreak="event_id")


@register("latest_features", dbl=["value"], sql=f"""
SELECT entity_id, feature, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM ({_FL}) f GROUP BY entity_id, feature""")
def q_latest_features(spark, sf):
    return S.latest_features(_feature_long(spark, sf), tiebreak="event_id")


_NAMES = ["view", "click", "purchase", "refund"]


@register("feature_batch", dbl=_NAMES, sql=f"""
WITH l AS (SELECT entity_id, feature, arg_max(value, (ts, event_id)) AS value FROM ({_FL}) f GROUP BY entity_id, feature),
ids AS (SELECT DISTINCT c_custkey % 200 AS entity_id FROM customer)
SELECT ids.entity_id, {', '.join(f"coalesce(max(CASE WHEN l.feature = '{n}' THEN l.value END), 0.0) AS {n}" for n in _NAMES)}
FROM ids JOIN l ON ids.entity_id = l.entity_id GROUP BY ids.entity_id""")
def q_feature_batch(spark, sf):
    latest = S.latest_features(_feature_long(spark, sf), tiebreak="event_id")
    ids = table(spark, sf, "customer").select((F.col("c_custkey") % 200).alias("entity_id"))
    return S.feature_batch(latest, ids, _NAMES)


@register("feature_freshness", dbl=["value"], sql=f"""
SELECT entity_id, feature, value, ts, feature_group, event_id FROM ({_FL}) f
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND""")
def q_feature_freshness(spark, sf):
    return S.feature_freshness(_feature_long(spark, sf), 86400).select(
        "entity_id", "feature", "value", F.col("ts"), "feature_group", "event_id")


@register("entity_group_registry", sql="""
SELECT event_type AS feature_group, count(DISTINCT user_id) AS n_entities, max(ts) AS last_updated FROM events GROUP BY event_type""")
def q_entity_group_registry(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("feature_group"), "ts")
    return S.entity_group_registry(e)[1]


@register("entity_groups", sql="""
SELECT user_id AS entity_id, list_sort(list(DISTINCT event_type)) AS groups, max(ts) AS last_updated FROM events GROUP BY user_id""")
def q_entity_groups(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("feature_group"), "ts")
    return S.entity_group_registry(e)[0]


_CATALOG = [("view", "numerical"), ("click", "numerical"), ("purchase", "numerical"), ("signup", "binary")]


@register("validate_feature_values", sql="""
WITH c AS (SELECT * FROM (VALUES ('view', 'numerical'), ('click', 'numerical'), ('purchase', 'numerical'), ('signup', 'binary')) t(feature, feature_type)),
v AS (SELECT event_id, event_type AS feature, CASE WHEN event_type = 'signup' THEN CAST(CAST(value > 50 AS INTEGER) AS VARCHAR)
             ELSE CAST(value AS VARCHAR) END AS value FROM events)
SELECT v.event_id, v.feature, v.feature_type, coalesce(CASE WHEN v.feature_type IS NULL THEN false
         WHEN v.feature_type = 'numerical' THEN try_cast(v.value AS DOUBLE) IS NOT NULL
         WHEN v.feature_type = 'binary' THEN try_cast(v.value AS DOUBLE) IN (0.0, 1.0)
         WHEN v.feature_type = 'categorical' THEN v.value IS NOT NULL ELSE true END, false) AS is_valid
FROM (SELECT v.*, c.feature_type FROM v LEFT JOIN c USING (feature)) v""")
def q_validate_feature_values(spark, sf):
    e = table(spark, sf, "events")
    v = e.select("event_id", F.col("event_type").alias("feature"),
                 F.when(F.col("event_type") == "signup", (F.col("value") > 50).cast("int").cast("string"))
                 .otherwise(F.col("value").cast("string")).alias("value"))
    cat = spark.createDataFrame(_CATALOG, "feature string, feature_type string")
    return S.validate_feature_values(v, cat).select("event_id", "feature", "feature_type", "is_valid")


@register("feature_usage_topk", dbl=["hit_rate"], sql="""
SELECT event_type AS feature, count(*) AS requests, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS hit_rate
FROM events GROUP BY event_type ORDER BY requests DESC, feature LIMIT 10""")
def q_feature_usage_topk(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("feature"), (F.col("value") > 50).alias("hit"))
    return S.feature_usage_topk(e)


@register("fit_transform_pipeline")
def q_fit_transform_pipeline(spark, sf):
    s = scored(spark, sf).select("patient_id", *PC, F.col("y_true").alias("target"))
    s = P.split_train_test(s, "patient_id")
    pipe = P.PreprocessPipeline(PC, "target", k_best=8, pca_k=3).fit(s.where("split = 'train'"))
    return pipe.transform(s.where("split = 'test'"), keep=["patient_id"])
