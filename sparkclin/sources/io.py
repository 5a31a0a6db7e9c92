"""A: scans, sources, sinks, snapshots, manifests, quarantine tables.

Readers take explicit schemas where the format has none; writers are plain
DataFrameWriter calls (append / partition overwrite), so every sink is
restartable after an executor loss. Nothing here collects data.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SUFFIX_FORMAT = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and pushdown happen at this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A1
def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """Pick the reader by suffix (.csv, .parquet/.pq, .json) unless ``fmt`` is given.

    JSON is read as records spanning lines (``multiLine``) the way pandas
    ``read_json(orient='records')`` accepts them.
    """
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        fmt = _SUFFIX_FORMAT.get(ext, "parquet")
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("mode", "PERMISSIVE")
        if schema is None:
            r = r.option("inferSchema", True)
    if fmt == "json":
        r = r.option("multiLine", True)
    return r.load(path)


# A2
def coerce_numeric(df: DataFrame, names: list[str] | None = None, missing: str = "?") -> DataFrame:
    """Every listed string column to DOUBLE; the missing marker and failures become NULL."""
    names = names or df.columns
    out = []
    for c in df.columns:
        if c in names:
            s = F.trim(F.col(c).cast("string"))
            out.append(F.when(s == F.lit(missing), None)
                       .otherwise(F.expr(f"try_cast(trim(CAST(`{c}` AS STRING)) AS DOUBLE)")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def read_headerless_numeric(spark: SparkSession, path: str, names: list[str],
                            missing: str = "?", sep: str = ",") -> DataFrame:
    """Header-less delimited file with a fixed name list, all columns numeric."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (spark.read.schema(schema).option("header", False).option("sep", sep)
           .option("mode", "PERMISSIVE").csv(path))
    return coerce_numeric(raw, names, missing)


# A3
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# A9
def dataset_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-insensitive content hash: one row (n_rows, fingerprint, xor64).

    ``fingerprint`` is the cross-engine form (sum of the first 32 bits of
    md5 over the comma-joined row); ``xor64`` is the cheap Spark-native form.
    Both are single-pass partial aggregates: no shuffle of rows.
    """
    cols = cols or df.columns
    joined = F.concat_ws(",", *[F.col(c).cast("string") for c in cols])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")).alias("fingerprint"),
        F.expr(f"bit_xor(xxhash64({', '.join('`'+c+'`' for c in cols)}))").alias("xor64"),
    )


# Snapshots and manifests
def write_snapshot(df: DataFrame, root: str, name: str, source: str = "unknown",
                   snapshot_ts: _dt.datetime | None = None) -> DataFrame:
    """Append a timestamped copy under ``root/data/name`` and one manifest row.

    Returns the manifest row (a one-row frame computed from the data). The
    copy is partitioned by ``snapshot_ts`` so readers prune to one snapshot.
    """
    ts = snapshot_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    stamped = df.withColumn("snapshot_ts", F.lit(ts).cast("timestamp_ntz"))
    stamped.write.mode("append").partitionBy("snapshot_ts").parquet(f"{root}/data/{name}")
    fp = dataset_fingerprint(df)
    man = fp.select(
        F.lit(name).alias("name"), F.lit(ts).cast("timestamp_ntz").alias("snapshot_ts"),
        F.lit(source).alias("source"), F.col("n_rows"),
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        F.col("fingerprint"))
    man.write.mode("append").parquet(f"{root}/manifest")
    return man


def read_snapshot(spark: SparkSession, root: str, name: str,
                  snapshot_ts: str | None = None) -> DataFrame:
    """The named snapshot, else the newest one (partition-pruned)."""
    data = spark.read.parquet(f"{root}/data/{name}")
    if snapshot_ts is not None:
        return data.where(F.col("snapshot_ts") == F.lit(snapshot_ts).cast("timestamp_ntz"))
    return latest_partition(data, "snapshot_ts")


def latest_partition(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows of the greatest ``ts_col`` (a scalar subquery, so dynamic partition pruning applies)."""
    mx = df.agg(F.max(ts_col).alias("__mx"))
    return df.join(F.broadcast(mx), F.col(ts_col) == F.col("__mx"), "left_semi")


def list_datasets(manifest: DataFrame) -> DataFrame:
    return manifest.select("name").distinct()


def version_history(manifest: DataFrame, ts_col: str = "snapshot_ts") -> DataFrame:
    """Version records newest first."""
    return manifest.orderBy(F.col(ts_col).desc())


def expire_snapshots(manifest: DataFrame, ts_col: str, days: int,
                     as_of: Column | None = None) -> DataFrame:
    """Entries older than ``days`` before ``as_of`` (default: newest entry)."""
    if as_of is None:
        mx = manifest.agg(F.max(ts_col).alias("__asof"))
        return (manifest.crossJoin(F.broadcast(mx))
                .where(F.col(ts_col) < F.expr(f"__asof - INTERVAL {int(days)} DAYS"))
                .drop("__asof"))
    return manifest.where(F.col(ts_col) < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


# A7
def write_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def split_distribution(df: DataFrame, split_col: str = "split", target: str = "target") -> DataFrame:
    return df.groupBy(split_col, target).agg(F.count(F.lit(1)).alias("n"))


# A12
def dataset_metadata(df: DataFrame, target: str = "target") -> DataFrame:
    """n_samples, n_features, feature names, class distribution map, fingerprint."""
    feats = [c for c in df.columns if c != target]
    by_class = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    dist = by_class.agg(
        F.sum("n").alias("n_samples"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col(target).cast("string").alias("k"), F.col("n").alias("v"))))).alias("class_distribution"))
    return dist.select(
        "n_samples",
        F.lit(len(feats)).cast("int").alias("n_features"),
        F.array(*[F.lit(c) for c in feats]).alias("feature_names"),
        "class_distribution")


# A13
def sample_rows(df: DataFrame, key: str, fraction: float | None = None,
                limit: int | None = None) -> DataFrame:
    """Reproducible sample: rows whose md5 bucket of ``key`` falls under the fraction.

    Partitioning-independent (unlike ``rand``), and cross-engine checkable.
    ``limit`` then keeps the first N by key: the sampling operator itself.
    """
    out = df
    if fraction is not None:
        bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 1000
        out = out.where(bucket < F.lit(int(round(fraction * 1000))))
    if limit is not None:
        out = out.orderBy(key).limit(int(limit))
    return out


# A14
def append_outcomes(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


# A15
LOG_LINE_PATTERN = r"^(\S+ \S+) (DEBUG|INFO|WARNING|ERROR|CRITICAL) (\S+) (.*)$"


def parse_text_logs(lines: DataFrame, col: str = "line", pattern: str = LOG_LINE_PATTERN) -> DataFrame:
    """Timestamp, level, module, message by regex; unmatched lines keep NULLs."""
    m = F.col(col).rlike(pattern)
    def g(i):
        return F.when(m, F.regexp_extract(col, pattern, i))
    return lines.select(
        "*",
        F.to_timestamp(g(1), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("log_ts"),
        g(2).alias("level"), g(3).alias("module"), g(4).alias("message"))


# A16
def parse_json_logs(df: DataFrame, col: str, fields: dict[str, str]) -> DataFrame:
    """Fields out of a JSON text column by JSON path (``{"name": "$.path"}``)."""
    return df.select("*", *[F.get_json_object(col, p).alias(n) for n, p in fields.items()])


# A17
def load_rule_tables(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Nested rule document(s) as a DataFrame; ``root`` unwraps a top-level key."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(f"{root}.*") if root else doc


# Quarantine (dead letter) tables
def quarantine_split(df: DataFrame, errors_col: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows without errors, and rows with errors stamped for retry."""
    good = df.where(F.coalesce(F.size(errors_col), F.lit(0)) <= 0)
    bad = (df.where(F.size(errors_col) > 0)
           .withColumn("retry_count", F.lit(0))
           .withColumn("max_retries", F.lit(3))
           .withColumn("status", F.lit("pending")))
    return good, bad


def quarantine_retry(dlq: DataFrame, outcomes: DataFrame, max_items: int = 100,
                     id_col: str = "dlq_id", ts_col: str = "ts") -> DataFrame:
    """Process the oldest ``max_items`` pending items against retry outcomes.

    ``outcomes(id_col, ok boolean)``: ok → resolved; failure → retry_count+1,
    and failed_retry once retry_count reaches max_retries. Other rows pass
    through unchanged. The top-N is a global ``row_number`` over pending rows
    only, which Spark plans as a bounded top-k (no full sort of the table).
    """
    pending = dlq.where(F.col("status") == "pending")
    picked = (pending.orderBy(F.col(ts_col), F.col(id_col)).limit(int(max_items))
              .select(id_col).withColumn("__picked", F.lit(True)))
    j = (dlq.join(picked, id_col, "left")
         .join(outcomes.select(id_col, F.col("ok").alias("__ok")), id_col, "left"))
    picked_c = F.coalesce(F.col("__picked"), F.lit(False))
    new_retry = F.when(picked_c & ~F.coalesce(F.col("__ok"), F.lit(False)),
                       F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = (F.when(~picked_c, F.col("status"))
              .when(F.coalesce(F.col("__ok"), F.lit(False)), F.lit("resolved"))
              .when(new_retry >= F.col("max_retries"), F.lit("failed_retry"))
              .otherwise(F.lit("pending")))
    return (j.withColumn("__nr", new_retry).withColumn("__st", status)
            .withColumn("retry_count", F.col("__nr")).withColumn("status", F.col("__st"))
            .drop("__picked", "__ok", "__nr", "__st"))


def quarantine_stats(dlq: DataFrame, task_col: str = "task_name", ts_col: str = "ts",
                     as_of: Column | None = None) -> DataFrame:
    """Per task: totals by status and the oldest pending age in seconds."""
    if as_of is None:
        base = dlq.crossJoin(F.broadcast(dlq.agg(F.max(ts_col).alias("__asof"))))
    else:
        base = dlq.withColumn("__asof", as_of)
    return base.groupBy(task_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("status") == "failed_retry").alias("failed_retry"),
        (F.max(F.unix_timestamp(F.col("__asof").cast("timestamp")))
         - F.min(F.unix_timestamp(F.col(ts_col).cast("timestamp")))).alias("oldest_age_s"))


# A21
def version_parts(col: str) -> Column:
    """Dotted version → array<int>; parts that are not numbers rank lowest (−1)."""
    return F.transform(F.split(F.col(col), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def latest_version(df: DataFrame, name_col: str, version_col: str) -> DataFrame:
    """Per name the greatest version by numeric dotted parts, text order on ties."""
    return (df.withColumn("__parts", version_parts(version_col))
            .groupBy(name_col)
            .agg(F.max_by(F.col(version_col), F.struct(F.col("__parts"), F.col(version_col))).alias("latest_version")))
