"""Where intermediate tables of a job go: the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(1)
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return f"{folder.rstrip('/')}/chronofold-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that what reads it twice doesn't compute it twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
