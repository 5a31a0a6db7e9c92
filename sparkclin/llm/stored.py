"""Tables written once to the folder that all executors share, and read back.

``checkpoint()`` runs a plan twice (once for its job, once to write). A written table runs it once, keeps its columns
apart, and survives lost executors. The folder is the cluster's scratch space (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sparkclin.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
