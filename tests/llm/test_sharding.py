import zlib
from collections import Counter

import pytest

from skillgrid.llm import sharding as SD
from skillgrid.llm.queries import QUERIES

from .conftest import ODD, SF


def check(rows, docs, n):
    """Sizes and checksums of every row, counts at most one apart, slots gapless."""
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    counts = Counter(r.shard for r in rows)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(n)), default=0) <= 1
    for s, k in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def cuts(rows):
    """Links to the first row of each equal-text group that cross shards."""
    first, cut = {}, 0
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        cut += first.setdefault((r.size, r.text_crc32), r.shard) != r.shard
    return cut


def test_query(spark, documents):
    rows = QUERIES["op7_sharding"](spark, SF).collect()
    check(rows, documents, 16)
    assert cuts(rows) == 0  # no group of equal texts is larger than a shard here


@pytest.mark.parametrize("n", [1, 3, 16])
def test_hot_group(spark, n):
    """A third of all rows are one text, more than a shard holds: far fewer links are cut than by chance."""
    docs = [(i, "hot") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(400)] + [(5000 + i, f"alone {i}") for i in range(401)]
    rows = SD.shard(spark.createDataFrame(docs, "doc_id long, text string"), n, rounds=20).collect()
    check(rows, docs, n)
    random_cuts = (1 - 1 / n) * (399 + 200)
    assert cuts(rows) <= 0.8 * random_cuts


def test_odd_rows(spark, odd_docs, no_docs):
    check(SD.shard(odd_docs, 4).collect(), ODD, 4)
    assert SD.shard(no_docs).collect() == []
