"""A stateful stream in many batches with a restart, against the whole table at once."""

import random

from pyspark.sql import functions as F

from chronofold.streaming import expiry


def test_timers_in_many_batches_with_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(4), i * 1000 + rng.randrange(900), rng.choice(["open", "open", "closed"])) for i in range(300) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "run long, entity long, t long, v string").withColumn("ts", F.timestamp_millis("t"))
    end = spark.createDataFrame([(-1, -1, 10_000_000, "end"), (-1, -1, 10_000_001, "end")], "run long, entity long, t long, v string").withColumn("ts", F.timestamp_millis("t"))
    for k, v in expiry.STATE_STORE.items():
        spark.conf.set(k, v)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = expiry.stream_support(stream, ["run", "entity"], 7000)
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    for i in range(6):
        df.where(F.floor(F.col("t") / 50_000) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 2:
            run()
    for x in (10_000_000, 10_000_001):
        end.where(F.col("t") == x).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = spark.read.parquet(f"{tmp_path}/out").where("run >= 0").select("run", "entity", "event", "value", "at").collect()
    want = expiry.batch_support(df, ["run", "entity"], 7000).select("run", "entity", "event", "value", "at").collect()
    assert sorted(got) == sorted(want) and sum(r.event == "expired" for r in got) > 20


def test_state_is_kept_by_bucket(spark, tmp_path):
    """Many keys, some of them null, wait in a few rows of state."""
    rows = [(None if i % 50 == 0 else i % 60, None if i % 7 == 0 else i % 5 + 2**60, 1000 + i * 100, "ab"[i % 3 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "run long, entity long, t long, v string").withColumn("ts", F.timestamp_millis("t"))
    for k, v in expiry.STATE_STORE.items():
        spark.conf.set(k, v)
    df.write.parquet(f"{tmp_path}/in")
    for x in (10_000_000, 10_000_001):
        late = spark.createDataFrame([(-1, -1, x, "end")], "run long, entity long, t long, v string").withColumn("ts", F.timestamp_millis("t"))
        late.write.mode("append").parquet(f"{tmp_path}/in") if x > 10_000_000 else None
        found = expiry.stream_support(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["run", "entity"], 7000, buckets=3)
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        assert all(o["numRowsTotal"] <= 9 for p in q.recentProgress for o in p["stateOperators"])  # value, timer and the timer's index of three buckets
    got = spark.read.parquet(f"{tmp_path}/out").where("run is null or run >= 0").select("run", "entity", "event", "value", "at").collect()
    want = expiry.batch_support(df, ["run", "entity"], 7000).select("run", "entity", "event", "value", "at").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.run is None for r in got) and any(r.entity is None for r in got)
