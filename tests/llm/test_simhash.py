import numpy as np
import pytest
import xxhash

from skillgrid.llm import simhash as SH
from skillgrid.llm.components import components
from skillgrid.llm.queries import QUERIES

from .conftest import ODD, SF


def slow_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    if not grams:
        return 0
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(pairs):
    """pairs: (id, fp) -> {index: least id reachable}"""
    label = list(range(len(pairs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), 2 ** 63), 2 ** 63 if doc is None else doc)
    return [least[find(i)] for i in range(len(pairs))]


def test_query_against_all_pairs(spark, documents):
    fps = [(d, slow_fp(t)) for d, t in documents]
    want = {d: (f"{fp:016x}", g) for (d, fp), g in zip(fps, slow_groups(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    assert got == want
    assert len({g for _, g in got.values()}) < len(got)


@pytest.mark.parametrize("limit", [1024, 8])
def test_ball_of_codes(spark, monkeypatch, limit):
    """A dense ball (every code near every other), chains and far codes; also with groups split at once."""
    monkeypatch.setattr(SH, "GROUP", limit)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2 ** 63))
    codes = {base}
    for _ in range(300):
        codes.add(base ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    chain = int(rng.integers(0, 2 ** 63))
    for b in range(0, 60, 2):
        chain ^= 3 << b
        codes.add(chain)
    codes |= {int(x) for x in rng.integers(0, 2 ** 63, 200)}
    codes = sorted(codes)
    df = spark.createDataFrame([(c - 2 ** 64 if c >> 63 else c,) for c in codes], "fp long")
    got = {(r.node % 2 ** 64): r.root % 2 ** 64 for r in components(SH.close_codes(df)).collect()}
    groups = slow_groups(list(enumerate(codes)))
    mine = {}
    for i, c in enumerate(codes):
        mine.setdefault(got.get(c, c), set()).add(i)
    theirs = {}
    for i, g in enumerate(groups):
        theirs.setdefault(g, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = SH.report(odd_docs).collect()
    assert len(rows) == len(ODD)
    want = slow_groups([(d, slow_fp(t)) for d, t in ODD])
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows)
    assert got == sorted((str(d), f"{slow_fp(t):016x}", None if g == 2 ** 63 else g) for (d, t), g in zip(ODD, want))
    assert SH.report(no_docs).collect() == []


def test_one_stays(spark, odd_docs, no_docs):
    kept = SH.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    want = slow_groups([(d, slow_fp(t)) for d, t in ODD])
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(want)) and {x for x in ids if x is not None} == {g for g in want if g < 2 ** 63}
    assert SH.one_per_group(no_docs).count() == 0


def test_unlinked_rows_that_share_an_id_stay(spark):
    """Far apart texts are groups of their own, also with null ids or one id; copies and near copies still go."""
    words = [" ".join(f"{name}{i}" for i in range(60)) for name in ("oak", "elm", "ash", "fir")]
    docs = [(None, words[0]), (None, words[1]), (None, words[0]), (7, words[2]), (7, words[3]), (9, words[3])]
    fps = [slow_fp(t) for t in words]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    kept = SH.one_per_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", words[0]), ("None", words[1]), ("7", words[2]), ("7", words[3])])


def test_long_text_in_pieces():
    text = " ".join(f"w{i % 977}" for i in range(5000))
    assert SH.fingerprint(text) == SH.fingerprint(text, piece=333) == slow_fp(text)
