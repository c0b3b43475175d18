import hashlib
import random

import pytest

from skillgrid.llm import phrases as PH
from skillgrid.llm.queries import QUERIES

from .conftest import ODD, SF


def slow(docs, width=50):
    """docs: (id, text) rows -> (id, n_words, n_removed, sha) rows; every window in a dict of first ids."""
    split = [(2 ** 63 if d is None else d, d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for o, _, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, o), o)
    out = []
    for o, d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < o:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_query_against_all_windows(spark, documents):
    got = QUERIES["op2_substring_dedup"](spark, SF)
    want = slow(documents)
    assert rows(got) == sorted(map(str, want))
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    """Few words, short windows: every kind of overlap, periodic runs, passages at both ends."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(5, 40))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.2:
            parts.append("x y " * rng.randint(3, 30))
        docs.append((rng.randint(0, 50), "  \n".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(PH.report(df, width=12, gram=4)) == sorted(map(str, slow(docs, 12)))


def test_odd_rows(spark, odd_docs, no_docs):
    assert rows(PH.report(odd_docs)) == sorted(map(str, slow(ODD)))
    assert PH.report(no_docs).collect() == []


def test_deduplicated(spark, no_docs):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"first {passage} end", "x", 7), (2, f"before,\n\t{passage}\nand  after", "y", 8), (3, passage, "z", 9), (4, None, None, None), (5, "short", "s", 5)],
                                 "doc_id long, text string, hints string, n_chars long")
    got = {r.doc_id: r for r in PH.deduplicated(docs).collect()}
    assert set(got) == {1, 2, 4, 5}  # nothing is left of the third
    assert got[2].text == "before,\n\nand  after" and got[2].n_chars == len(got[2].text) and got[2].hints == "y"
    assert got[1].text == f"first {passage} end" and got[4].text is None
    assert PH.deduplicated(no_docs).count() == 0


def test_texts_of_one_id_with_equal_32_bit_hashes(spark):
    """Spark's hash() agrees on each pair of a short and a long text; their rows are still told apart."""
    from pyspark.sql import functions as F
    body = " ".join(f"w{i}" for i in range(80))
    pairs = [(f"short {i}", f"{body} {j}") for i, j in ((12605, 190405), (32535, 165531), (39678, 48822), (47930, 105916), (51759, 60840))]
    docs = [(n, t) for n, pair in enumerate(pairs) for t in pair] + [(10 + n, f"before {long} after") for n, (_, long) in enumerate(pairs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert df.select(F.hash("text")).distinct().count() < df.select("text").distinct().count()
    assert rows(PH.report(df)) == sorted(map(str, slow(docs)))
