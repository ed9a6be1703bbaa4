"""Queries that read the events as a stream, each with the SQL of the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.plans.derived import HOUR, OBSERVED_SQL, observed, observed_from
from chronofold.plans.registry import query
from chronofold.sources.scratch import scratch_path
from chronofold.streaming.expiry import STATE_STORE, stream_support
from chronofold.streaming.logs import latest, stream_logs, window_counts


def _stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream of files can't be given a single one
    return observed_from(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.[p]arquet"))


def _run(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query(f"WITH {OBSERVED_SQL} SELECT run, w, array_to_string(list_sort(list(DISTINCT entity)), ',') AS entities, CAST(count(*) AS BIGINT) AS events FROM ob GROUP BY run, w")
def stream_state_delta(spark, sf_dir):
    """What every window touched, from logs that a stream wrote: partial sets of each batch, merged when they are read."""
    path = scratch_path(spark, "stream")
    touched = lambda b: b.groupBy("run", "w").agg(F.collect_set("entity").alias("entities"), F.count("*").alias("events"))
    _run(stream_logs(_stream(spark, sf_dir), {"deltas": touched, "errors": lambda b: b.where("kind = 'error'")}, f"{path}/logs", f"{path}/checkpoint", enabled={"deltas"}))
    d = spark.read.parquet(f"{path}/logs/deltas").groupBy("run", "w").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("e"), F.sum("events").alias("events"))
    return d.select("run", "w", F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("entities"), "events")


@query(f"WITH {OBSERVED_SQL} SELECT run, w, CAST(count(*) AS BIGINT) AS n, max(confidence) AS confidence FROM ob GROUP BY run, w")
def stream_window_counts(spark, sf_dir):
    """Running counts of every window with a watermark; the last update of each counts."""
    path = scratch_path(spark, "stream")
    at = F.timestamp_seconds(F.floor(F.col("t") / 1_000_000))
    rows = _stream(spark, sf_dir).withColumn("ts", at)
    counts = window_counts(rows, ["run", "w", F.window("ts", "3 hours")])
    _run(stream_logs(counts, {"counts": lambda b: b.select("run", "w", "n", "confidence")}, f"{path}/logs", f"{path}/checkpoint", mode="update"))
    return latest(spark, f"{path}/logs/counts", ["run", "w"])


_GAP = 6 * HOUR // 1000


@query(f"""WITH {OBSERVED_SQL}, x AS (SELECT run, entity, CAST(k % 6 AS BIGINT) AS attribute, t // 1000 AS t, CASE WHEN kind IN ('click', 'view') THEN 'open' ELSE 'closed' END AS v FROM ob),
 n AS (SELECT *, t - lag(t) OVER p AS away, lag(v) OVER p AS before, lead(t) OVER p - t AS next FROM x WINDOW p AS (PARTITION BY run, entity, attribute ORDER BY t, v))
 SELECT run, entity, attribute, 'started' AS event, v AS value, t AS at FROM n WHERE away IS NULL OR away > {_GAP} OR before <> v
 UNION ALL SELECT run, entity, attribute, 'expired', v, t + {_GAP} FROM n WHERE next IS NULL OR next > {_GAP}""")
def stream_pending_support(spark, sf_dir):
    """How attribute values come to wait and lapse, told by a stream with keyed state and timers.

    The events come in four parts, in order of time; the stream is stopped after
    each of them and goes on from its checkpoint.  Two rows far behind the end
    let the watermark pass everything.
    """
    path, key = scratch_path(spark, "stream"), ["run", "entity", "attribute"]
    ms = F.floor(F.col("t") / 1000).cast("long")
    rows = observed(spark, sf_dir).select("run", "entity", (F.col("k") % 6).cast("long").alias("attribute"), ms.alias("t"), F.when(F.col("kind").isin("click", "view"), "open").otherwise("closed").alias("v")).withColumn("ts", F.timestamp_millis("t"))
    span = rows.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    low, high = span.low or 0, span.high or 0
    part = F.least(F.lit(3), F.floor((F.col("t") - low) * 4 / (high - low + 1)))
    far = spark.range(2).select(*[F.lit(-1).cast("long").alias(k) for k in key], (F.lit(high + 4 * _GAP) + F.col("id")).alias("t"), F.lit("end").alias("v")).withColumn("ts", F.timestamp_millis("t"))
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}

    def run() -> None:
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        found = stream_support(stream, key, _GAP)
        _run(found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())

    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        for i in range(4):
            rows.where(part == i).write.mode("append").parquet(f"{path}/in")
            run()
        for i in range(2):
            far.where(F.col("t") == high + 4 * _GAP + i).write.mode("append").parquet(f"{path}/in")
            run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema("run long, entity long, attribute long, event string, value string, at long").parquet(f"{path}/out").where("run >= 0")
