"""Offline / online feature-store tables as keyed DataFrames.

Feature values live in long form ``(entity_id, feature, value, ts,
feature_group)``; "latest" is ``max_by`` per key (a partial aggregate, not
a sort), and lookups for an id list are semi / left joins where the id list
side is left to the optimizer's own size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def features_of_day(df: DataFrame, entity: str = "entity_id", group: str = "feature_group",
                    feature: str = "feature", ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """One value per (entity, group, day, feature): the last write of that day wins."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(entity, group, "feature_date", feature).orderBy(*order)
    return (df.withColumn("feature_date", F.to_date(ts))
            .withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn"))


def write_features(df: DataFrame, path: str) -> None:
    """D30 sink: partitioned by (feature_group, feature_date); rewriting a day replaces it."""
    (features_of_day(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("feature_group", "feature_date").parquet(path))


def latest_features(df: DataFrame, entity: str = "entity_id", feature: str = "feature", ts: str = "ts",
                    date: str | None = None, tiebreak: str | None = None) -> DataFrame:
    """Newest value per (entity, feature), or exactly the given date's values."""
    if date is not None:
        df = df.where(F.to_date(ts) == F.lit(date).cast("date"))
    key = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return df.groupBy(entity, feature).agg(F.max_by("value", key).alias("value"), F.max(ts).alias("ts"))


def feature_batch(latest: DataFrame, ids: DataFrame, names: list[str], entity: str = "entity_id",
                  feature: str = "feature", default: float = 0.0, online: bool = False) -> DataFrame:
    """Wide features for an id list; requested names only, missing names → default.

    Offline drops entities without data (semi join); ``online=True`` keeps
    every requested id (left join) with defaults. The id list is joined
    only when its estimated size is small; a data-sized list shuffles.
    """
    idl = ids.select(entity).distinct()
    vals = latest.where(F.col(feature).isin(*names))
    wide = vals.groupBy(entity).pivot(feature, names).agg(F.first("value"))
    base = idl.join(wide, entity, "left" if online else "inner")
    return base.select(entity, *[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(default)).alias(n) for n in names])


def feature_freshness(df: DataFrame, ttl_seconds: int = 3600, as_of: Column | None = None,
                      ts: str = "ts") -> DataFrame:
    """Entries younger than the TTL at ``as_of`` (default: newest ts); older count as absent."""
    t = F.col(ts).cast("timestamp")
    if as_of is None:
        mx = df.agg(F.max(t).alias("__asof"))
        return (df.crossJoin(F.broadcast(mx))
                .where(t >= F.col("__asof") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")).drop("__asof"))
    return df.where(t >= as_of.cast("timestamp") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def entity_group_registry(df: DataFrame, entity: str = "entity_id", group: str = "feature_group",
                          ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Entity → groups + last update; group → entity count + last update.

    The group side reports a count, not the member list: a group may hold
    most entities, and collecting them would put an unbounded list in one row.
    """
    by_entity = df.groupBy(entity).agg(F.array_sort(F.collect_set(group)).alias("groups"),
                                       F.max(ts).alias("last_updated"))
    by_group = df.groupBy(group).agg(F.countDistinct(entity).alias("n_entities"), F.max(ts).alias("last_updated"))
    return by_entity, by_group


def validate_feature_values(values: DataFrame, catalog: DataFrame, feature: str = "feature",
                            value: str = "value") -> DataFrame:
    """Each value against its catalog type: numerical (castable), categorical (any),
    binary (0 or 1); unknown features fail. The catalog (metadata) is a plain join side."""
    j = values.join(catalog.select(feature, F.col("feature_type")), feature, "left")
    v = F.col(value).cast("string")
    num = v.try_cast("double")
    ok = (F.when(F.col("feature_type").isNull(), F.lit(False))
          .when(F.col("feature_type") == "numerical", num.isNotNull())
          .when(F.col("feature_type") == "binary", num.isin(0.0, 1.0))
          .when(F.col("feature_type") == "categorical", v.isNotNull())
          .otherwise(F.lit(True)))
    reason = (F.when(F.col("feature_type").isNull(), F.lit("unknown feature"))
              .when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("not a valid "), F.col("feature_type"), F.lit(" value"))))
    return j.select("*", F.coalesce(ok, F.lit(False)).alias("is_valid"), reason.alias("reason"))


def feature_lineage(edges: DataFrame) -> DataFrame:
    """Per feature its dependencies and dependents from (feature, dependency) edges."""
    deps = edges.groupBy("feature").agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"))
    rev = edges.groupBy(F.col("dependency").alias("feature")).agg(F.array_sort(F.collect_set("feature")).alias("dependents"))
    return deps.join(rev, "feature", "full_outer").select(
        "feature", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"),
        F.coalesce("dependents", F.array().cast("array<string>")).alias("dependents"))


def catalog_counts(catalog: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Features by (type, status), optionally only those carrying any of ``tags``."""
    c = catalog
    if tags:
        c = c.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return c.groupBy("feature_type", "status").agg(F.count(F.lit(1)).alias("n"))


def feature_usage_topk(requests: DataFrame, feature: str = "feature", hit: str = "hit", k: int = 10) -> DataFrame:
    """The k most requested features with their hit rate (a top-k report)."""
    g = requests.groupBy(feature).agg(F.count(F.lit(1)).alias("requests"),
                                      F.avg(F.col(hit).cast("double")).alias("hit_rate"))
    return g.orderBy(F.col("requests").desc(), F.col(feature)).limit(k)
