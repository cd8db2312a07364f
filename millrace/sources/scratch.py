"""Intermediate tables in the shared folder the cluster names.

A table written here cuts lineage: it is still there after executors are lost,
and every later branch reads the same rows. Parquet rather than a checkpoint
file, so that later reads take only the columns they need.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder that no earlier run has used.

    Paths are kept by application, so that a cluster can delete what an
    application wrote once it has ended.
    """
    application = spark.sparkContext.applicationId
    return f"{scratch_folder(spark)}/millrace/{application}/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the scratch folder and return it read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
