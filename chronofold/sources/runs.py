"""Run folders: scans of windows and observations, and sinks of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_SCHEMA = (
    "run_id STRING, global_index INT, run_index INT, start_seconds DOUBLE, commit_start_seconds DOUBLE, end_seconds DOUBLE, window_type STRING, processing_role STRING, "
    "sampled_frames ARRAY<STRUCT<sample_index:INT,frame_index:INT,timestamp_seconds:DOUBLE>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; a broken line fails the read, or becomes nulls if not strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "PERMISSIVE")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, WINDOW_SCHEMA)


def frames(windows: DataFrame) -> DataFrame:
    """One row a sampled frame."""
    return windows.select("run_id", "global_index", F.explode("sampled_frames").alias("f")).select("run_id", "global_index", "f.*")


def attach_frames(windows: DataFrame, sampled: DataFrame) -> DataFrame:
    """windows with the frames that were sampled for them, ordered by sample index."""
    by = sampled.groupBy("run_id", "global_index").agg(F.array_sort(F.collect_list(F.struct("sample_index", "frame_index", "timestamp_seconds"))).alias("sampled_frames"))
    return windows.drop("sampled_frames").join(by, ["run_id", "global_index"], "left")


def run_ids(sources: DataFrame, name: str, started: str) -> DataFrame:
    """sources with run_id: start time, cleaned name and six digits of a hash over all of a row, so that a replay gives the same ids."""
    clean = F.regexp_replace(F.trim(F.col(name)), r"[^A-Za-z0-9_-]+", "_")
    token = F.substring(F.sha2(F.to_json(F.struct(*sources.columns)), 256), 1, 6)
    return sources.withColumn("run_id", F.concat_ws("_", F.date_format(F.col(started), "yyyyMMdd_HHmmss"), clean, token))


def content_hashes(files: DataFrame, columns: list[str]) -> DataFrame:
    """files with a SHA-256 in lower-case hexadecimal of each text or binary column, under its name and _sha256."""
    return files.select("*", *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in columns])


def write_logs(tables: dict[str, DataFrame], path: str, enabled: set[str] | None = None) -> list[str]:
    """Append every enabled log under path as JSON lines, partitioned by run where it has one; returns their names."""
    names = [n for n in sorted(tables) if enabled is None or n in enabled]
    for n in names:
        writer = tables[n].write.mode("append")
        (writer.partitionBy("run") if "run" in tables[n].columns else writer).json(f"{path.rstrip('/')}/{n}")
    return names
