"""Streaming queries (ST1-ST4): file drops derived from the tables, run with ``availableNow``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs as ST
from . import fixtures as X
from .registry import register
from .q_pages import LINKS_SQL
from ..operators import pages as P


def _dirs(spark, name):
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"


def _drop(df, path: str) -> None:
    """Land ``df`` as files, one per task that made it."""
    df.write.mode("append").parquet(path)


@register("index_refresh", """
SELECT lang, term, doc_id, count(*) AS cnt FROM (
  SELECT lang, doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda t: t <> '')) AS term FROM documents)
GROUP BY lang, term, doc_id""")
def index_refresh(spark, sf_dir):
    """ST1: inverted index maintained from a document stream (equals the batch index)."""
    src, sink, ckpt = _dirs(spark, "index")
    docs = X._t(spark, sf_dir, "documents", "doc_id", "text", "lang")
    # The German documents come first with another text and again with their own, which supersedes it.
    schema = "doc_id long, text string, lang string"
    _drop(docs.filter(F.col("lang") == "de").withColumn("text", F.reverse("text")), src)
    ST.index_refresh(spark, src, schema, sink, ckpt)
    _drop(docs, src)
    ST.index_refresh(spark, src, schema, sink, ckpt)
    return ST.read_index(spark, sink).select("lang", "term", "doc_id", "cnt")


@register("session_stream", """
SELECT user_id, ts, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""")
def session_stream(spark, sf_dir):
    """ST2 + W4: sessions appended by a stream, read back as the latest five per user."""
    from ..operators.windows import recent_n
    src, sink, ckpt = _dirs(spark, "sessions")
    ev = X._t(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    _drop(ev, src)
    ST.session_stream(spark, src, "event_id long, user_id long, ts timestamp_ntz, event_type string", sink, ckpt)
    out = spark.read.parquet(sink)
    return recent_n(out, "user_id", "ts", 5, tie_col="event_id").select("user_id", "ts", "event_type")


@register("crawl_dedup_stream", LINKS_SQL + "\nSELECT DISTINCT link AS url FROM links")
def crawl_dedup_stream(spark, sf_dir):
    """ST3: links found on pages streamed in batches; each link is emitted once."""
    src, sink, ckpt = _dirs(spark, "crawl")
    links = P.extract_links(X._t(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", F.col("link").alias("url"))
    _drop(links, src)
    ST.crawl_dedup_stream(spark, src, "page_id long, url string", sink, ckpt)
    return spark.read.parquet(sink).select("url")


@register("incremental_model", """
SELECT DISTINCT id, course_name FROM (SELECT d.doc_id AS id, p.p_name || ' ' || CAST(d.doc_id AS VARCHAR) AS course_name
FROM documents d JOIN part p ON p.p_partkey = d.doc_id)""")
def incremental_model(spark, sf_dir):
    """ST4: each run appends only new keys to the model table (re-delivered keys ignored)."""
    src, sink, ckpt = _dirs(spark, "incr")
    c = X.courses(spark, sf_dir).select("id", "course_name")
    # Every row is delivered twice, in two runs: re-delivered keys are not appended again.
    for _ in range(2):
        _drop(c, src)
        ST.incremental_model(spark, src, "id long, course_name string", sink, ckpt, "id")
    return ST.read_model(spark, sink).select("id", "course_name")
