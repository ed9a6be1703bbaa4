"""A query over run folders that Spark wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.plans.derived import OBSERVED_SQL, observed
from chronofold.plans.registry import query
from chronofold.sources.run_folders import read_log, write_runs
from chronofold.sources.scratch import scratch_path


@query(f"""WITH {OBSERVED_SQL} SELECT 'windows' AS log, run, w, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS confidence, count(*) AS n FROM ob GROUP BY run, w
 UNION ALL SELECT 'observations', run, w, event_id, kind, confidence, NULL FROM ob
 UNION ALL SELECT 'errors', run, w, event_id, kind, NULL, NULL FROM ob WHERE kind = 'error'
 UNION ALL SELECT 'meta', run, count(DISTINCT w), count(*), NULL, NULL, count(*) FILTER (kind = 'error') FROM ob GROUP BY run""")
def run_folder_round_trip(spark, sf_dir):
    """Windows, observations, errors and statistics of every run, written as run folders and read back."""
    path, o = scratch_path(spark, "runs"), observed(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run_"), F.col("run").cast("string")))
    events = o.select("run_id", "w", "event_id", "kind", "confidence")
    logs = {"windows": o.groupBy("run_id", "w").agg(F.count("*").alias("n")), "observations": events, "errors": events.where("kind = 'error'").drop("confidence")}
    meta = write_runs(logs, path)
    fields = "w long, event_id long, kind string, confidence double, n long"
    rows = meta.select(F.lit("meta").alias("log"), "run_id", F.col("windows_count").alias("w"), F.col("observations_count").alias("event_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.col("errors_count").alias("n"))
    for log in sorted(logs):
        rows = rows.unionByName(read_log(spark, path, log, fields).select(F.lit(log).alias("log"), "*"))
    return rows.withColumn("run", F.substring("run_id", 5, 20).cast("long")).drop("run_id")
