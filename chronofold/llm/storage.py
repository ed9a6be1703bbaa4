"""Where intermediate tables go: the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache(1)
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where it is unset, a temporary folder in local mode (as in tests); on a
    cluster an error, as driver and executors share no such folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/chronofold-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def free_name(columns: list[str], name: str) -> str:
    """name with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a written table with a number for each row, however equal rows are, and that column's name."""
    name = free_name(df.columns, "_row")
    return written(df.select(F.monotonically_increasing_id().alias(name), *[F.col(f"`{c}`") for c in df.columns]), "keyed"), name


def delete_path(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df._written_at)


def frequent(keys: DataFrame, key: str, share: int = 1000, least: int = 10_000) -> list:
    """Values of a column that hold more than one row in `share` and more than `least`: at most `share` values, whatever the size."""
    counts = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least)
    total = keys.count()
    return [r[0] for r in counts.where(F.col("n") > total / share).select(key).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: list, spread: F.Column, how: str = "left", salts: int = 64) -> DataFrame:
    """Equi join on key in which the rows of hot keys are dealt over `salts` parts by `spread`, and small's rows of these keys are copied to each.

    small has at most one row a key; hot has a bounded length (see frequent).
    """
    if not hot:
        return big.join(small.hint("merge"), key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
