"""Streaming jobs resume from their checkpoint: committed files are not reprocessed, keys not repeated."""

import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skillgrid.operators import state as M
from skillgrid.streaming import jobs as ST


def _dirs():
    base = tempfile.mkdtemp(prefix="sg-stream-")
    return f"{base}/src", f"{base}/sink", f"{base}/ckpt"


def test_incremental_model_restart(spark):
    src, sink, ckpt = _dirs()
    first = spark.range(0, 100).select(F.col("id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("course_name"))
    first.repartition(2).write.mode("append").parquet(src)
    ST.incremental_model(spark, src, "id long, course_name string", sink, ckpt, "id")
    assert ST.read_model(spark, sink).count() == 100
    # second run: overlapping and new keys; the first drop is not read again
    second = spark.range(50, 150).select(F.col("id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("course_name"))
    second.repartition(2).write.mode("append").parquet(src)
    ST.incremental_model(spark, src, "id long, course_name string", sink, ckpt, "id")
    out = ST.read_model(spark, sink)
    assert out.count() == 150 and out.select("id").distinct().count() == 150


def test_crawl_dedup_restart(spark):
    src, sink, ckpt = _dirs()
    links = spark.createDataFrame([(1, "https://a/1"), (1, "https://a/2"), (2, "https://a/1")], "page_id long, url string")
    links.write.mode("append").parquet(src)
    ST.crawl_dedup_stream(spark, src, "page_id long, url string", sink, ckpt)
    more = spark.createDataFrame([(3, "https://a/2"), (3, "https://a/3")], "page_id long, url string")
    more.write.mode("append").parquet(src)
    ST.crawl_dedup_stream(spark, src, "page_id long, url string", sink, ckpt)
    urls = sorted(r.url for r in spark.read.parquet(sink).collect())
    assert urls == ["https://a/1", "https://a/2", "https://a/3"]


def test_index_refresh_supersedes_redelivered_docs(spark):
    src, sink, ckpt = _dirs()
    docs = spark.createDataFrame([(1, "alpha beta", "en"), (2, "gamma", "en")], "doc_id long, text string, lang string")
    docs.write.mode("append").parquet(src)
    ST.index_refresh(spark, src, "doc_id long, text string, lang string", sink, ckpt)
    spark.createDataFrame([(1, "delta", "en")], "doc_id long, text string, lang string").write.mode("append").parquet(src)
    ST.index_refresh(spark, src, "doc_id long, text string, lang string", sink, ckpt)
    got = sorted((r.doc_id, r.term) for r in ST.read_index(spark, sink).collect())
    assert got == [(1, "delta"), (2, "gamma")]


def test_two_deliveries_within_one_run(spark):
    """A backlog is one micro-batch: of each document only the last delivery is indexed, and copies count once."""
    import glob
    import os
    src, sink, ckpt = _dirs()
    schema = "doc_id long, text string, lang string"
    drops = [[(1, "alpha beta beta", "en"), (2, "gamma", "en"), (3, "old words", "en"), (4, "once", "en")],
             [(1, "delta", "de"), (2, "gamma", "en"), (3, "", "en"), (5, "first", "en"), (5, "second", "en")]]
    for n, rows in enumerate(drops):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}-{n}")
        os.makedirs(src, exist_ok=True)
        # the later drop's name sorts first
        os.rename(glob.glob(f"{src}-{n}/part-*.parquet")[0], f"{src}/{9 - n}.parquet")
        os.utime(f"{src}/{9 - n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    ST.index_refresh(spark, src, schema, sink, ckpt)
    got = sorted((r.lang, r.term, r.doc_id, r.cnt) for r in ST.read_index(spark, sink).collect())
    assert got == [("de", "delta", 1, 1), ("en", "gamma", 2, 1), ("en", "once", 4, 1), ("en", "second", 5, 1)]


def test_redelivered_document_without_words_loses_its_postings(spark):
    src, sink, ckpt = _dirs()
    schema = "doc_id long, text string, lang string"
    for text in ("alpha beta", "123 !"):
        spark.createDataFrame([(1, text, "en")], schema).write.mode("append").parquet(src)
        ST.index_refresh(spark, src, schema, sink, ckpt)
    assert ST.read_index(spark, sink).collect() == []


def test_stream_of_many_files_is_complete_or_raises(spark):
    src, sink, ckpt = _dirs()
    spark.range(600).withColumn("user_id", F.col("id") % 7).repartition(30).write.parquet(src)
    ST.session_stream(spark, src, "id long, user_id long", sink, ckpt, max_files=4)
    assert spark.read.parquet(sink).count() == 600

    bad, bad_sink, bad_ckpt = _dirs()
    spark.range(5).selectExpr("CAST(id AS STRING) AS id").write.parquet(bad)
    with pytest.raises(StreamingQueryException):
        ST.session_stream(spark, bad, "id long", bad_sink, bad_ckpt)


def test_replayed_epoch_writes_the_same_rows(spark):
    src, sink, ckpt = _dirs()
    spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "id long, course_name string").repartition(3).write.parquet(src)
    ST.incremental_model(spark, src, "id long, course_name string", sink, ckpt, "id")
    assert sorted((r.id, r.course_name) for r in ST.read_model(spark, sink).collect()) == [(1, "a"), (2, "c")]
