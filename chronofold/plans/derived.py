"""Observation tables derived from the star-schema tables, the same in Spark and in SQL.

A run is a user's id modulo 8; its windows are six hours long and start every
three.  An event is a sampled frame, an entity sighting, an action and an
attribute value at once.  Times are microseconds since 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
WINDOW, STRIDE = 6 * HOUR, 3 * HOUR
RUNS = 8

#: Raw event types and the actions that they stand for.
ACTION_OF = {"click": "press", "view": "inspect", "purchase": "operate", "signup": "record"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run, entity, t (microseconds), kind, confidence, k."""
    return events_from(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_from(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").cast("long"),
        (F.col("user_id") % RUNS).cast("long").alias("run"),
        F.col("user_id").cast("long").alias("entity"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long").alias("t"),
        F.col("event_type").alias("kind"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: The same as events(), as a common table expression.
EVENTS_SQL = """ev AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id % 8 AS BIGINT) AS run, CAST(user_id AS BIGINT) AS entity,
         CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS t, event_type AS kind,
         least(value / 100, 1.0::DOUBLE) AS confidence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with w, the index of the three-hour step that they fall in: a tumbling commit window."""
    return observed_from(spark.read.parquet(f"{sf_dir}/events.parquet"))


def observed_from(e: DataFrame) -> DataFrame:
    """The same for a table or stream like events."""
    return events_from(e).withColumn("w", F.floor(F.col("t") / STRIDE).cast("long"))


OBSERVED_SQL = EVENTS_SQL + f""", ob AS (SELECT *, CAST(t // {STRIDE} AS BIGINT) AS w FROM ev)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, w, camera_change, reframed and view of every step with events: two errors or more make a camera change, one reframes."""
    o = observed(spark, sf_dir).groupBy("run", "w").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count("*").alias("n"))
    view = F.when(F.col("errors") >= 3, "closeup").when(F.col("n") % 3 == 0, "detail").otherwise("overview")
    return o.select("run", "w", (F.col("errors") >= 2).alias("camera_change"), (F.col("errors") == 1).alias("reframed"), view.alias("view"))


STEPS_SQL = OBSERVED_SQL + """, st AS (SELECT run, w, e >= 2 AS camera_change, e = 1 AS reframed, CASE WHEN e >= 3 THEN 'closeup' WHEN n % 3 = 0 THEN 'detail' ELSE 'overview' END AS view
  FROM (SELECT run, w, count(*) FILTER (kind = 'error') AS e, count(*) AS n FROM ob GROUP BY run, w))"""
