"""A corpus pipeline of five operators: language, quality, near duplicates, mixing, tokens.

Every stage works on rows, not on ids: rows that share a doc_id, or have none,
are judged each by itself.  Columns besides those that a stage reads pass
through under any name; null texts are empty; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import bpe_table, language_mixture, parity_join, quality, source_mixing
from chronofold.llm.queries import VOCABULARY
from chronofold.llm.storage import free_name, keyed, written

#: Least share of a text in its main language, and least probability of good quality, to stay.
LEAST_SHARE = 0.5
LEAST_QUALITY = 0.5


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly in one of the learned languages; learned from the input itself.

    Null texts and texts without a letter go, as they have no language; so does
    everything where nothing can be learned.  Equal texts share their fate.
    """
    names, table = language_mixture.fit(docs.where(~language_mixture.held_out("doc_id")))
    prefix = free_name(docs.columns, "_found_")
    marked = language_mixture.predict(docs.withColumn("text", F.col("text").cast("string")), names, table, prefix=prefix)
    return marked.where((F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= LEAST_SHARE)).select(_columns(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by their own text and their site; ties with the bound stay.

    Null sources and languages are sites of their own; labels meet all rows with
    their doc_id.
    """
    rows, key = keyed(docs)
    scored = quality.score_quality(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(key,))
    good = scored.where(F.col("score") >= LEAST_QUALITY).select(key)
    return rows.join(good.hint("merge"), key, "left_semi").select(_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, null ids last, then by a hash of its text.

    Groups are made of rows, so a row is never dropped for a text that another
    row with its doc_id holds.  Texts without words are in no group and stay.
    """
    rows, key = keyed(docs)
    found = parity_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"))
    order = rows.select(key, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(key)).alias("_order"))
    groups = found.select(F.col("doc_id").alias(key), F.col("component_id").alias("_group"))
    first = order.hint("merge").join(groups.hint("merge"), key).groupBy("_group").agg(F.min_by(key, "_order").alias(key)).select(key)
    return rows.join(first.hint("merge"), key, "left_semi").select(_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows that are equal in all columns, nulls included, share what is taken of
    them together; they are told from others by 128 bits.  Texts without words
    are never taken.
    """
    key, copies, times = (free_name(docs.columns, x) for x in ("_content", "_copies", "_times"))
    # a hash leaves nulls out, so where they are is hashed too
    values = [*_columns(docs), *[c.isNull() for c in _columns(docs)]]
    rows = docs.withColumn(key, F.concat(F.lower(F.hex(F.xxhash64(*values))), F.lit("-"), F.lower(F.hex(F.xxhash64(F.lit(1), *values)))))
    taken = source_mixing.mix_sources(rows, id_col=key).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").cast("int").alias(copies))
    distinct = rows.dropDuplicates([key])
    return distinct.join(taken.hint("merge"), key).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(_columns(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, as digests: one row per input row, repeated rows included."""
    return bpe_table.encode_decode(docs, VOCABULARY)


STAGES = [("language", keep_languages), ("quality", keep_quality), ("near duplicates", drop_near_duplicates), ("mixing", mix), ("tokens", tokenize)]

#: SQL can't express the models of the first stages; tests hold the stages against plainer code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
