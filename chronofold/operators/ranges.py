"""Running values over sorted ranges of rows, so that one key's history may span tasks.

Rows are dealt over partitions by ranges of key and order, so a long history is
cut where its order says.  Each partition runs its window functions alone; what a
key carries into a partition is one row, as a partition begins in at most one
key's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.sources.scratch import stored

_PART = "_part"


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """df with running values of each key's rows in their order, however long its history is.

    sums: totals up to and including the row (nulls count nothing); lasts: the
    last value that isn't null, up to and including the row; before: the row
    before's value, tops: the greatest value of all rows before, null at a key's
    beginning.  Null keys are equal; the order must be total within a key and
    hold no nulls.  Without a key all rows are one history.  The rows are written once, ranged over `parts` partitions.
    """
    sums, lasts, before, tops = sums or {}, lasts or {}, before or {}, tops or {}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {**{f"_s{i}": c for i, c in enumerate(sums.values())}, **{f"_l{i}": c for i, c in enumerate(lasts.values())}, **{f"_b{i}": c for i, c in enumerate(before.values())}, **{f"_t{i}": c for i, c in enumerate(tops.values())}}
    rows = df.select("*", *[c.alias(n) for n, c in named.items()]).repartitionByRange(parts, *[F.col(c) for c in (*key, *order)])
    rows = stored(rows.withColumn(_PART, F.spark_partition_id()), "ranges")
    here = Window.partitionBy(_PART, *key).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = lambda kind: [n for n in named if n.startswith(kind)]
    # what each partition adds to a key
    at = F.struct(*order)
    ends = [F.sum(n).alias(n) for n in values("_s")] + [F.max(n).alias(n) for n in values("_t")] + [F.max_by(F.when(F.col(n).isNotNull(), F.struct(n)), F.when(F.col(n).isNotNull(), at)).alias(n) for n in values("_l")] + [F.max_by(F.struct(n), at).alias(n) for n in values("_b")]
    borders = rows.groupBy(_PART, *key).agg(*ends, F.count("*").alias("_n"))
    past = Window.partitionBy(*key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.select(_PART, *key, F.sum("_n").over(past).alias("_n"), *[F.sum(n).over(past).alias(f"c{n}") for n in values("_s")], *[F.max(n).over(past).alias(f"c{n}") for n in values("_t")], *[F.last(n, ignorenulls=True).over(past).alias(f"c{n}") for n in (*values("_l"), *values("_b"))])
    # one row a partition at most: only the key that a partition begins with can have rows before it
    carried = carried.where("_n is not null").drop("_n").select(F.col(_PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[f"c{n}" for n in named])
    local = rows.select("*", *[F.sum(n).over(upto).alias(f"o{n}") for n in values("_s")], *[F.last(F.when(F.col(n).isNotNull(), F.struct(n)), ignorenulls=True).over(upto).alias(f"o{n}") for n in values("_l")], *[F.lag(F.struct(n)).over(here).alias(f"o{n}") for n in values("_b")], *[F.max(n).over(here.rowsBetween(Window.unboundedPreceding, -1)).alias(f"o{n}") for n in values("_t")])
    same = F.col(_PART) == F.col("_p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = local.join(F.broadcast(carried), same, "left")
    out = [F.when(F.col(f"o{n}").isNull() & F.col(f"c{n}").isNull(), F.lit(None)).otherwise(F.coalesce(f"o{n}", F.lit(0)) + F.coalesce(f"c{n}", F.lit(0))).alias(name) for n, name in zip(values("_s"), sums, strict=True)]
    out += [F.coalesce(f"o{n}", f"c{n}")[n].alias(name) for kind, given in (("_l", lasts), ("_b", before)) for n, name in zip(values(kind), given, strict=True)]
    out += [F.greatest(f"o{n}", f"c{n}").alias(name) for n, name in zip(values("_t"), tops, strict=True)]
    return both.select(*[F.col(c) for c in df.columns], *out)


def numbered(df: DataFrame, key: list[str], order: list[str], name: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """df with the number of each row within its key, in order, from start."""
    return running(df, key, order, sums={name: F.lit(1).cast("long")}, parts=parts).withColumn(name, F.col(name) + (start - 1))


def last_before(points: DataFrame, samples: DataFrame, key: list[str], at: str, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """points with the value of the last sample of their key before them, null if there is none: an as-of join by one sorted pass.

    Both have key and at; samples at the same place as a point aren't before it.
    Points may be repeated.
    """
    mine = points.select(*key, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(samples.select(value).schema[0].dataType).alias("_value"))
    theirs = samples.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), value.alias("_value"))
    both = mine.unionByName(theirs).withColumn("_tie", F.monotonically_increasing_id())
    found = running(both, key, ["_at", "_side", "_tie"], lasts={"_found": F.col("_value")}, parts=parts).where("_side = 0")
    return found.select("_row.*", F.col("_found").alias(name))
