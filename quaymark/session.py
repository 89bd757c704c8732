"""Where intermediates go, and cutting lineage where several consumers read a costly result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the context's own checkpoint folder where that is unset.

    With neither, a session in one process (tests) gets a temporary folder; on a cluster executors couldn't read it: an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quaymark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, by columns and compressed."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
