"""Streamed postings, counted within the rows of a batch."""
import uuid
from collections import Counter

from skillgrid.session import scratch_path
from skillgrid.streaming import jobs as ST


def test_streamed_postings_are_counted_in_one_pass(spark, monkeypatch):
    base = scratch_path(spark, f"idx-{uuid.uuid4().hex}")
    rows = [(1, "a b a", "en"), (2, "c", "de"), (None, "a b", "en"), (None, "b a", "en"), (3, None, "en"), (2, "d d", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{base}/src")
    passes = []
    count = ST.SR.row_postings
    monkeypatch.setattr(ST.SR, "row_postings", lambda docs, *a: passes.append(docs.columns) or count(docs, *a))
    ST.index_refresh(spark, f"{base}/src", "doc_id long, text string, lang string", f"{base}/sink", f"{base}/ckpt")
    got = Counter((r.lang, r.term, r.doc_id, r.cnt) for r in ST.read_index(spark, f"{base}/sink").collect())
    assert got == Counter([("en", "a", 1, 2), ("en", "b", 1, 1), ("de", "d", 2, 2), ("en", "a", None, 2), ("en", "b", None, 2)])
    assert 1 <= len(passes) <= 3               # one for the documents, the others for rows without a key
