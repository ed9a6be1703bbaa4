"""Causal sliding windows with context and commit parts, as DataFrame algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REGULAR, TAIL = "regular", "tail_completion"


def build_windows(sources: DataFrame, window: int, stride: int, run: str = "run", duration: str = "duration") -> DataFrame:
    """Windows of every source: run, global_index, start, commit_start, end, window_type.

    Regular windows start every stride while they fit; a source that isn't
    longer than a window, or whose end the last regular window doesn't reach,
    gets a last window that ends at its end.  Integers (microseconds) in, integers
    out; a null or non-positive duration gives no windows.
    """
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    d = F.col(duration).cast("long")
    rows = sources.where(d > 0).select(F.col(run).alias("run"), d.alias("d"))
    n = F.when(F.col("d") <= window, F.lit(0)).otherwise(F.floor((F.col("d") - window) / stride) + 1).cast("long")
    rows = rows.withColumn("n", n)
    regular = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct(i.alias("i"), (i * stride).alias("s"), (i * stride + window).alias("e"), F.lit(REGULAR).alias("k")))).otherwise(F.array().cast("array<struct<i:bigint,s:bigint,e:bigint,k:string>>"))
    last_end = F.when(F.col("n") > 0, (F.col("n") - 1) * stride + window).otherwise(F.lit(0))
    tail = F.array(F.struct(F.col("n").alias("i"), F.greatest(F.lit(0).cast("long"), F.col("d") - window).alias("s"), F.col("d").alias("e"), F.lit(TAIL).alias("k")))
    all_ = F.concat(regular, F.when(last_end < F.col("d"), tail).otherwise(F.array().cast("array<struct<i:bigint,s:bigint,e:bigint,k:string>>")))
    out = rows.select("run", F.explode(all_).alias("w")).select("run", F.col("w.i").alias("global_index"), F.col("w.s").alias("start"), F.col("w.e").alias("end"), F.col("w.k").alias("window_type"))
    return derive_commit(out.withColumn("commit_start", F.lit(None).cast("long")))


def derive_commit(windows: DataFrame) -> DataFrame:
    """Fill missing commit starts: the end of the window before, but not before the window's own start."""
    before = F.lag("end").over(Window.partitionBy("run").orderBy("global_index"))
    return windows.withColumn("commit_start", F.coalesce("commit_start", F.greatest("start", before), "start"))


def select_by_time(windows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Windows that overlap [start, end)."""
    out = windows if start is None else windows.where(F.col("end") > start)
    return out if end is None else out.where(F.col("start") < end)


def select_by_index(windows: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Windows whose index lies between first and last, both included."""
    out = windows if first is None else windows.where(F.col("global_index") >= first)
    return out if last is None else out.where(F.col("global_index") <= last)


def limit_windows(windows: DataFrame, most: int | None = None) -> DataFrame:
    """The first windows of every run, with run_index counted from 0."""
    out = windows.withColumn("run_index", (F.row_number().over(Window.partitionBy("run").orderBy("global_index")) - 1).cast("long"))
    return out if most is None else out.where(F.col("run_index") < most)


def with_warmup(windows: DataFrame, chosen: DataFrame, warmup: int) -> DataFrame:
    """chosen windows and up to `warmup` windows before them, with processing_role, cold_start and a new run_index."""
    first = chosen.groupBy("run").agg(F.min("global_index").alias("first"))
    before = windows.join(first, "run").where(F.col("global_index") < F.col("first")).drop("first")
    before = before.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("global_index")))).where(F.col("r") <= warmup).drop("r")
    columns = ["run", "global_index", "start", "commit_start", "end", "window_type"]
    both = before.select(*columns, F.lit("warmup").alias("processing_role")).unionByName(chosen.select(*columns, F.lit("commit").alias("processing_role")))
    found = F.sum(F.when(F.col("processing_role") == "warmup", 1).otherwise(0)).over(Window.partitionBy("run"))
    both = both.withColumn("cold_start", F.lit(warmup > 0) & (found < warmup))
    return both.withColumn("run_index", (F.row_number().over(Window.partitionBy("run").orderBy("global_index")) - 1).cast("long"))


def assign_to_windows(points: DataFrame, windows: DataFrame, window: int, stride: int, t: str = "t") -> DataFrame:
    """Every point with all windows that hold it, and whether it lies in the window's commit part.

    A range join without a range join: a point lists the few indices of the
    regular grid that can hold it, and joins windows by run and index; the last
    windows, one a run, are joined by run.
    """
    low = F.greatest(F.floor((F.col(t) - window) / stride) + 1, F.lit(0))
    grid = points.withColumn("global_index", F.explode(F.sequence(low.cast("long"), F.greatest(low, F.floor(F.col(t) / stride)).cast("long"))))
    inside = (F.col(t) >= F.col("start")) & (F.col(t) < F.col("end"))
    regular = grid.join(windows.where(F.col("window_type") == REGULAR), ["run", "global_index"]).where(inside)
    tail = points.join(windows.where(F.col("window_type") == TAIL), "run").where(inside)
    return regular.unionByName(tail.select(regular.columns)).withColumn("in_commit", F.col(t) >= F.col("commit_start"))


def frame_plan(windows: DataFrame, fps: float, least: int, most: int, source_fps: float = 24.0) -> DataFrame:
    """Sampled frames of every window: sample_index, time in seconds, frame_index (half to even).

    As many frames as seconds times fps, but between least and most, evenly spaced from the window's start.
    """
    seconds = (F.col("end") - F.col("start")) / F.lit(1e6)
    n = F.greatest(F.lit(least), F.least((seconds * fps).cast("int"), F.lit(most)))
    rows = windows.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.col("start") / F.lit(1e6) + F.col("i") * (seconds / F.col("n"))
    return rows.select("run", "global_index", F.col("i").cast("long").alias("sample_index"), at.alias("at_seconds"), F.bround(at * source_fps, 0).cast("long").alias("frame_index"))


def assign_to_intervals(points: DataFrame, intervals: DataFrame, key: list[str], t: str = "t", start: str = "start", end: str = "end", parts: int = 8) -> DataFrame:
    """Every point with all intervals of its key that hold it, start <= t < end, whatever their lengths, gaps and overlaps.

    t, start and end are whole numbers; empty and null intervals hold nothing.
    An interval lies in at most two bins of the power of two that is not below
    its length, and a point in one bin of each power that its key has, so the
    join is an equi join on key, power and bin, which no long interval widens.
    Points are dealt over `parts` parts, to each of which intervals are copied:
    a crowded bin is split.
    """
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.col(end) - F.col(start)) - 1e-9)).cast("int")
    real = intervals.where(F.col(end) > F.col(start)).withColumn("_power", power)
    # rounding of large numbers may miss a power
    real = real.withColumn("_power", F.when(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_power")) < F.col(end) - F.col(start), F.col("_power") + 1).otherwise(F.col("_power")))
    bin_of = lambda x: F.call_function("shiftright", x.cast("long"), F.col("_power"))
    placed = real.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end) - 1)))).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    powers = real.select(*key, "_power").distinct().groupBy(*key).agg(F.collect_list("_power").alias("_powers"))  # at most 63 a key
    asked = points.join(powers, key).withColumn("_power", F.explode("_powers")).drop("_powers").withColumn("_bin", bin_of(F.col(t)))
    asked = asked.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    met = asked.join(placed, [*key, "_power", "_bin", "_deal"])
    return met.where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("_power", "_bin", "_deal")


def evidence_times(evidence: Column, frames: Column) -> Column:
    """Sorted times of the distinct evidence indices; null where an index has no frame.  frames: map<int, time>."""
    ids = F.array_sort(F.array_distinct(evidence))
    times = F.transform(ids, lambda i: F.try_element_at(frames, i))
    return F.when(F.exists(times, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_sort(times))


def in_commit(times: Column, commit_start: Column, end: Column) -> Column:
    """True if any evidence time lies in [commit_start, end)."""
    return F.coalesce(F.exists(times, lambda x: (x >= commit_start) & (x < end)), F.lit(False))
