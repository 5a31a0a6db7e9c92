"""References and versions as committed sets of files.

Whatever is written goes to a folder of its own first (``.../version=<id>``); a one-row commit record is appended last. Readers
start from the records, so a job that dies on the way leaves files nobody refers to, never half a version, and two
writers can't mix. File lists come from the scan's own ``_metadata``, one row a file, by a job over the files.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.sources.io import dataset_fingerprint, read_table

VERSION_COLUMNS = ["version", "name", "version_ts", "path", "n_files", "size_bytes", "n_rows", "n_columns", "column_names",
                   "fingerprint", "message"]


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def file_list(data: DataFrame) -> DataFrame:
    """Rows path, size_bytes, modified, n_rows: the files of a scan. ``data`` must be a plain read; a file in which no row
    is stored is not listed."""
    return (data.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"),
                         F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("modified"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def version_data(spark: SparkSession, path: str, root: str, name: str, message: str = "",
                 fmt: str | None = None, version_ts: _dt.datetime | None = None) -> DataFrame:
    """A10: record the present state of the data at ``path``: its files, sizes, rows and content hash, with a message.

    Returns the one-row record. The file list is kept beside it (``version_files``).
    """
    version, ts = uuid.uuid4().hex, version_ts or _now()
    data = read_table(spark, path, fmt=fmt)
    file_list(data).write.parquet(f"{root}/files/version={version}")
    files = spark.read.parquet(f"{root}/files/version={version}")
    totals = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    record = dataset_fingerprint(data).crossJoin(totals).select(  # one row each
        F.lit(version).alias("version"), F.lit(name).alias("name"), F.lit(ts).cast("timestamp_ntz").alias("version_ts"),
        F.lit(path).alias("path"), "n_files", "size_bytes", "n_rows", F.lit(len(data.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in data.columns]).alias("column_names"), "fingerprint", F.lit(message).alias("message"))
    record.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version_records(spark, root, name).where(F.col("version") == version)


def version_records(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """A10: committed versions, newest first."""
    records = spark.read.parquet(f"{root}/versions").select(*VERSION_COLUMNS)
    if name is not None:
        records = records.where(F.col("name") == name)
    return records.orderBy(F.desc("version_ts"), "version")


def version_files(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/files/version={version}")


def changed_files(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """Rows path, change ('added', 'removed', 'changed') between two versions; files that stayed are left out."""
    a, b = (version_files(spark, root, v).select("path", F.struct("size_bytes", "modified").alias(s)) for v, s in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where(F.col("change").isNotNull())


# ------------------------------------------------------------------ A8
def write_reference(df: DataFrame, path: str, description: str = "", name: str = "reference_data") -> str:
    """Store a reference frame with its ``describe`` statistics and a record (name, description, rows, columns, hash);
    returns its version. Readers see the reference only once all of it is there."""
    from sparkclin.operators.quality import describe_numeric
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/version={version}")
    data = spark.read.schema(df.schema).parquet(f"{path}/data/version={version}")
    describe_numeric(data).write.parquet(f"{path}/statistics/version={version}")
    record = dataset_fingerprint(data).select(
        F.lit(version).alias("version"), F.lit(name).alias("name"), F.lit(description).alias("description"),
        F.lit(_now()).cast("timestamp_ntz").alias("created_at"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"), "fingerprint")
    record.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def _latest(spark: SparkSession, path: str, name: str, version: str | None) -> str:
    if version is not None:
        return version
    newest = spark.read.parquet(f"{path}/commits").where(F.col("name") == name).orderBy(F.desc("created_at")).first()
    if newest is None:
        raise FileNotFoundError(f"no reference {name} in {path}")
    return newest.version


def read_reference(spark: SparkSession, path: str, name: str = "reference_data", version: str | None = None) -> DataFrame:
    """The rows of the newest committed reference of this name (or of ``version``)."""
    return spark.read.parquet(f"{path}/data/version={_latest(spark, path, name, version)}")


def read_reference_statistics(spark: SparkSession, path: str, name: str = "reference_data", version: str | None = None) -> DataFrame:
    """Its ``describe`` statistics, a row per numeric column."""
    return spark.read.parquet(f"{path}/statistics/version={_latest(spark, path, name, version)}")
