"""V1 feature hashing by hand, T1 for many queries against the whole product."""

import hashlib
import math

import numpy as np
import pytest

from skillgrid.operators import vectors as V


def _embed(text, dim):
    out = {}
    for w in (text or "").lower().split():
        h = hashlib.md5(w.encode()).hexdigest()
        i = int(h[:8], 16) % dim
        out[i] = out.get(i, 0) + (1 if int(h[8], 16) % 2 == 0 else -1)
    out = {i: c for i, c in out.items() if c}
    norm = math.sqrt(sum(c * c for c in out.values()))
    return {i: c / norm for i, c in out.items()}


def test_embedding_by_hand(spark):
    texts = [(1, "red red Blue"), (2, ""), (3, None), (4, "été naïve straße"), (5, "a " * 900)]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in texts], "id long, text string, i string, x double")
    got = {}
    for r in V.embed_text(df, "id", "text", 16).collect():
        got.setdefault(r.id, {})[r.i] = r.x
    want = {i: _embed(t, 16) for i, t in texts if _embed(t, 16)}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys() and all(abs(got[k][i] - want[k][i]) < 1e-12 for i in want[k])


def _frame(spark, ids, x, name):
    rows = [(int(k), [int(i) for i in np.flatnonzero(v)], [float(a) for a in v[np.flatnonzero(v)]]) for k, v in zip(ids, x)]
    return spark.createDataFrame(rows, f"{name} long, indices array<int>, values array<double>")


@pytest.mark.parametrize("rows,asks", [(40, 3), (10_000, 100)])
def test_many_queries_against_the_whole_product(spark, rows, asks):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) + 4 * rng.integers(0, 2, (300, 1))
    x[200:240] = x[7]                                              # one vector that many rows share
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.concatenate([x[:10], rng.normal(size=(5, 12))])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    got = V.rank_by_similarity(_frame(spark, range(300), x, "id"), _frame(spark, range(500, 515), q, "qid"), "id", "qid", 6, 12, rows, asks)
    want = []
    for i, scores in enumerate(q @ x.T):
        best = sorted(range(300), key=lambda d: (-round(scores[d], 9), d))[:6]
        want += [(500 + i, d, r + 1) for r, d in enumerate(best)]
    assert sorted((r.qid, r.id, r["rank"]) for r in got.collect()) == sorted(want)


def test_no_rows_no_queries(spark):
    none = spark.createDataFrame([], "id long, indices array<int>, values array<double>")
    one = spark.createDataFrame([(1, [0], [1.0])], "qid long, indices array<int>, values array<double>")
    assert V.rank_by_similarity(none, one, "id", "qid", 3, 4).collect() == []
    assert V.rank_by_similarity(one.withColumnRenamed("qid", "id"), none.withColumnRenamed("id", "qid"), "id", "qid", 3, 4).collect() == []


def test_far_slabs_are_skipped():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(2048, 16)) * 0.05 + c for c in np.eye(16)[:4]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block = V.PivotBlock(x)
    held = block.top(x[:20], 5)
    assert block.scored < 0.5 * 20 * len(x)
    for i, (at, scores) in enumerate(held):
        best = np.sort(x @ x[i])[::-1][:5]
        assert np.allclose(np.sort(scores)[::-1][:5], best)
