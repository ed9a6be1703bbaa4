"""Repeated rows and ids, nulls, clashing names and damage, by value."""

import gzip
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronofold.llm import chat_format, ivfpq, media, parity_join, source_mixing, warc

PAGES = "page_id long, url string, html string"


def test_equal_long_pages_in_two_partitions(spark):
    big = "<p>" + "x" * 60_000
    one = lambda *rows: spark.createDataFrame(list(rows), PAGES).coalesce(1)
    df = one((1, "u", big), (2, "v", None)).union(one((1, "u", big), (2, "v", None))).union(one((None, "u", big), (3, "w", big)))
    got = warc.archive_round_trip(df).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.error) for r in got) == Counter({(1, "response", None, 60_003, None): 2, (2, "response", None, 0, None): 2, (None, "revisit", 1, 60_003, None): 1, (3, "revisit", 1, 60_003, None): 1})


def test_warc_empty_table_clashing_names_and_least_bytes(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []
    df = spark.createDataFrame([(1, "u", "same", "a", 1), (2, "u", "same", "b", 2)], PAGES + ", sha string, key int")
    assert {r.record_type for r in warc.archive_round_trip(df).collect()} == {"response", "revisit"}
    assert {r.record_type for r in warc.archive_round_trip(df, least_bytes=5).collect()} == {"response"}


def test_damaged_archives_give_rows(spark, tmp_path):
    good = b"\r\n\r\n".join(warc.page_records(1, "a", "u", b"fine")) + b"\r\n\r\n"
    revisit = b"\r\n\r\n".join(warc.page_records(2, "b", "u", b"fine", refers_to="nowhere")) + b"\r\n\r\n"
    broken = good.replace(b"X-Page-ID: 1", b"X-Page-ID: one")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good * 3 + revisit)[:-60])
    (tmp_path / "b.warc").write_bytes(good + good[:40])
    (tmp_path / "c.warc").write_bytes(broken + good + revisit)
    (tmp_path / "d.warc").write_bytes(good.replace(b"Content-Length: ", b"Content-Length: x"))
    found = warc.reassemble(warc.read_records(spark, str(tmp_path))).drop("payload").cache()
    got = warc.resolve_revisits(found).collect()
    assert Counter(r.error is None for r in got if r.record_type == "response")[True] >= 2
    assert sum(r.record_type is None and r.error is not None for r in got) == 4
    assert [r.error for r in got if r.record_type == "revisit"] == ["the response that is referred to is missing"]


def test_vectors_of_any_scale_and_length(spark):
    rows = [(0, [1e-200, 0.0]), (50, [1.0, 1e-3]), (2, [1e200, 1.0]), (3, [0.0, 5.0]), (100, [1e-310, 0.0]), (4, [1.0, 2.0, 3.0]), (150, [1.0, 2.0, 2.9]), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, []), (200, [7.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, list string, key int")
    got = {}
    for r in ivfpq.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got[0] == [(2, 1.0), (100, 1.0), (50, 1.0), (3, 0.0)]
    assert [v for v, _ in got[50]] == [0, 2, 100, 3] and [v for v, _ in got[100]] == [0, 2, 50, 3]
    assert [v for v, _ in got[150]] == [4] and 200 not in got


def test_search_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(9).normal(size=(600, 8))
    df = spark.createDataFrame([(int(i) // 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    search = lambda d: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ivfpq.search(d, F.col("vec_id") % 50 == 0, probes=99).collect())
    assert search(df.coalesce(1)) == search(df.repartition(7)) and len(search(df)) == 60


@pytest.fixture(scope="module")
def documents(spark):
    a = " ".join(f"alpha{i}" for i in range(40))
    b = " ".join(f"beta{i}" for i in range(40))
    rows = [(1, a, "en", "s", 1, "p"), (2, a, "en", "s", 1, "q"), (2, b, "en", None, 1, "q"), (None, a, None, "s", None, None), (None, b + " x", "en", "s", 1, "r"), (3, None, "en", "s", 0, None), (4, "", "de", "t", 0, None), (4, "", "de", "t", 0, None), (5, "some other words", None, "t", 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _row string")


def test_near_duplicates_go_by_row(spark, documents):
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, "")
    got = Counter((r.doc_id, (r.text or "")[:4]) for r in kept.collect())
    assert got == Counter({(1, "alph"): 1, (2, "beta"): 1, (3, ""): 1, (4, ""): 2, (5, "some"): 1})
    assert kept.columns == documents.columns
    assert corpus_pipeline.drop_near_duplicates(spark, documents.limit(0), "").collect() == []


def test_mixing_stage_goes_by_row(spark, documents):
    got = corpus_pipeline.mix(spark, documents, "")
    assert got.columns == documents.columns
    taken = Counter((r.doc_id, r.text) for r in got.collect())
    assert set(taken) <= {(r.doc_id, r.text) for r in documents.collect() if r.text} and max(taken.values()) <= 3
    assert corpus_pipeline.mix(spark, documents.limit(0), "").collect() == []


def test_mixing_keeps_rows_whose_nulls_are_elsewhere(spark):
    """Rows of the same values in other columns are items of their own; equal rows share what is taken."""
    rows = [(1, "x y z", None, "a", 5), (1, "x y z", "a", None, 5), (1, "x y z", "a", None, None), (None, "x y z", "a", "a", 5), (5, "x y z", "a", "a", None)]
    rows = [r for r in rows for _ in range(40)] + [(i, "one two three four five", "en", "b", 1) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = Counter(map(tuple, corpus_pipeline.mix(spark, df.repartition(3), "").collect()))
    mixed = source_mixing.mix_sources(df)
    target = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    words = Counter()
    for r, n in got.items():
        assert r in set(rows) and n <= 3 * rows.count(r)
        words[r[3]] += n * len(r[1].split())
    assert set(got) >= set(rows[:200:40]) and all(abs(words[s] - t) < 6 for s, t in target.items())
    assert got == Counter(map(tuple, corpus_pipeline.mix(spark, df.coalesce(1), "").collect()))


def test_language_and_quality_stages(spark, documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = corpus_pipeline.keep_languages(spark, documents, "")
    assert kept.columns == documents.columns and {r.text for r in kept.collect()} <= {r.text for r in documents.collect() if r.text}
    good = corpus_pipeline.keep_quality(spark, documents, f"file://{tmp_path}")
    assert good.columns == documents.columns and good.count() <= documents.count()
    for stage in (corpus_pipeline.keep_languages, corpus_pipeline.keep_quality):
        assert stage(spark, documents.limit(0), f"file://{tmp_path}").collect() == []
    tokens = corpus_pipeline.tokenize(spark, documents, "")
    assert tokens.count() == documents.count() and corpus_pipeline.tokenize(spark, documents.limit(0), "").collect() == []


def test_equal_rows_are_dealt_over_blocks(spark):
    df = spark.createDataFrame([(7, "w " * 5, "s", "x")] * 9000 + [(8, "w " * 9, "t", "x")] * 100, "doc_id long, text string, source string, n string")
    got = source_mixing.mix_sources(df)
    assert got.count() == 9100
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect():
        assert abs(r.taken - r.target) <= 9 and r.most <= 3
    assert sorted(source_mixing.mix_sources(df.repartition(3)).collect()) == sorted(got.collect())


def test_columns_with_clashing_names(spark, documents):
    turns = documents.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", F.lit(1).alias("formatted"), F.lit(2).alias("loss"))
    assert chat_format.chat_digests(chat_format.format_chats(turns)).count() == 6
    more = documents.withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit(1)).withColumn("set_id", F.lit(1))
    assert media.media_features(media.to_media(more)).count() == 9 and parity_join.jaccard_components(more).count() == 9
