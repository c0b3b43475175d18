import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from skillgrid.llm import suffixes as SX
from skillgrid.llm.queries import QUERIES

from .conftest import ODD, SF


def slow(docs, width=200):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[i:i + width] for _, r in raws for i in range(len(r) - width + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                gone[i:i + width] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("seed", range(20))
def test_order_and_prefixes(seed):
    rng = random.Random(seed)
    raw = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 300))) + b"abab" * rng.randint(0, 40)
    depth = rng.choice([8, 9, 20, 50])
    data = np.frombuffer(raw, np.uint8)
    sa, rank = SX.suffix_order(data, depth)
    assert sorted(sa.tolist()) == list(range(len(raw)))
    keys = [raw[i:i + depth].ljust(depth, b"\0") for i in sa]
    assert keys == sorted(keys)
    got = SX.common_prefixes(data, sa, depth)
    for a, b, n in zip(sa, sa[1:], got[1:]):
        same = 0
        while same < depth and max(a, b) + same < len(raw) and raw[a + same] == raw[b + same]:
            same += 1
        assert n == same


def test_query_against_all_strings(spark, documents):
    got = QUERIES["op9_suffix_array_dedup"](spark, SF)
    want = slow(documents)
    assert rows(got) == sorted(map(str, want))
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("seed,hot", [(0, 256), (1, 256), (2, 2), (3, 2), (4, 1)])
def test_random_texts(spark, monkeypatch, seed, hot):
    """Few letters, short windows, periodic runs; small shards, and anchors that span shards."""
    monkeypatch.setattr(SX, "HOT", hot)
    monkeypatch.setattr(SX, "SHARD_BYTES", 500)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(5, 70))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.2:
            parts.append("xy" * rng.randint(3, 60))
        docs.append((i, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(SX.report(df, width=30, gram=6)) == sorted(map(str, slow(docs, 30)))


def test_odd_rows(spark, odd_docs, no_docs):
    assert rows(SX.report(odd_docs)) == sorted(map(str, slow(ODD)))
    assert SX.report(no_docs).collect() == []


def test_texts_of_one_id_with_equal_32_bit_hashes(spark):
    """Spark's hash() agrees on each pair of a short and a long text; their rows are still told apart."""
    from pyspark.sql import functions as F
    body = " ".join(f"w{i}" for i in range(80))
    pairs = [(f"short {i}", f"{body} {j}") for i, j in ((12605, 190405), (32535, 165531), (39678, 48822), (47930, 105916), (51759, 60840))]
    docs = [(None, t) for pair in pairs for t in pair]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert df.select(F.hash("text")).distinct().count() < df.select("text").distinct().count()
    assert rows(SX.report(df)) == sorted(map(str, slow(docs)))
