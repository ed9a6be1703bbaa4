"""Structured Streaming of observations: idempotent log sinks and running window counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def stream_logs(rows: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, enabled: set[str] | None = None, mode: str = "append") -> StreamingQuery:
    """Write the enabled logs of a stream below path, a folder each, and stop when the source is read to its end.

    A batch overwrites its own folder, so a batch that is run again after a
    failure writes the same rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, of in tables.items():
            if enabled is None or name in enabled:
                of(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "3 hours") -> DataFrame:
    """Running counts of a stream by keys (one of them a window's start, a timestamp); state of windows that the watermark has passed is dropped."""
    return rows.withWatermark(time, late).groupBy(*keys).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of a log of updates the last batch's row of each key."""
    log = spark.read.parquet(path)
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("_r = 1").drop("_r", "batch")
