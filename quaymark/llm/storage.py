"""Reading tables, and written intermediates that survive the loss of an executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: Bytes of Parquet that are sent whole at most. Hashes and ids, which is what is sent, take hardly more room in memory.
SENT = 12 << 20
#: Paths written since each open `scratch` began.
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends here, the files outlive executors, and the planner knows
    their size, by which it sends a side of a join whole or not."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quaymark-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_if_small(df: DataFrame) -> DataFrame:
    """A written frame, marked to be sent whole to every executor if its files hold at most SENT bytes; else the join shuffles."""
    files = df.inputFiles()
    if not files:
        return df
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    size = at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if size <= SENT else df


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates written inside are deleted at the end; nothing lazy that reads them may be used after it."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)
