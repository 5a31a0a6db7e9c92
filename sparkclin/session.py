"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC timestamps (the oracle is UTC-naive),
# adaptive execution for runtime coalescing / skew splitting, Arrow for the
# few pandas-backed operators.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sparkclin", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster, ``master`` stays None so spark-submit decides; tests pass
    ``local[N]`` and a small shuffle-partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; that setting always
    wins. Only when it is unset on a local master (tests) do we create one;
    on a cluster a machine-local folder would be lost, so that is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="sparkclin-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return local


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """``df`` written once, as Parquet, to the shared folder and read back.

    ``checkpoint()`` runs a plan twice, once for its job and once to write. A written table runs it once, keeps its
    columns apart for pruning and pushdown, and survives lost executors. The folder is the cluster's scratch space.
    ``file_rows`` cuts the files, so that work which is heavy for its bytes is read back by more tasks.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
