import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import negatives as NG
from skillgrid.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row int, score string, window int"


def slow(rows, every, k_pos, k_neg):
    """Every anchor against every row, by the words of the contract."""
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (aid, q, lab) in enumerate(rows):
        if aid is None or aid % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i is None, i, rl) for r, (i, v, rl) in enumerate(rows) if r != a]
        scored.sort(key=lambda t: (t[0], t[1], t[2] or 0))
        for s, _, pid, _ in [t for t in scored if t[3] == lab][:k_pos]:
            near = [t for t in scored if t[3] != lab and 80 * -s <= 100 * -t[0] <= 100 * -s][:k_neg]
            out += [(aid, pid, n + 1, t[2], -s, -t[0]) for n, t in enumerate(near)]
    return sorted(out, key=str)


def fast(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], SCHEMA)
    got = NG.hard_negatives(NG.quantised(df, F.col("label")), F.col("id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_twin(twin):
    mine, other = twin("op11_hard_negatives", "/root/testdata/sf0.01")
    assert mine == other and mine


@pytest.mark.parametrize("seed", range(2))
def test_random_rows_in_small_chunks(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) + (i % 3 == 0) for _ in range(6)], rng.randint(0, 3)) for i in range(240)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]                     # one vector that many rows share
    assert fast(spark, rows, 10, n_positives=4, n_negatives=3, chunk=37, block=5) == slow(rows, 10, 4, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2),
            (5, [1.0, 1.5], None), (None, [1.0, 1.9], 1), (None, [1.0, 1.8], 2), (6, [1.0], 2), (7, [], 2), (8, [0.9, 1.7, 5.0], 2),
            (10, [0.0, 0.0], 1), (20, [], 3), (30, [-1.0, -2.0], 3), (9, [1.0, 1.9], 1), (40, [1e30, 1.0], 9)]
    held = [(i, [min(max(x, -65536.0), 65536.0) if x is not None and math.isfinite(x) else x for x in v] if v is not None else v, lab) for i, v, lab in rows]
    assert fast(spark, rows, 10, n_positives=3, n_negatives=4, chunk=4, block=2) == slow(held, 10, 3, 4)
    assert fast(spark, [], 10) == []


def test_reading_stops_before_the_end():
    """An anchor along one axis meets its neighbours long before all rows, and the threshold is strict."""
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, (4096, 3))
    x[:40, 0] = 1000
    lists = NG.SortedLists(x, 100)
    best = NG.Best(5, *NG.ALL)
    ids, nulls = np.arange(4096)[::-1].copy(), np.zeros(4096, bool)
    met = lists.search(np.array([100, 0, 1]), [best], lambda at, s: best.offer(at, s, ids, nulls))
    scores = x @ np.array([100, 0, 1])
    want = np.lexsort((ids, -scores))[:5]
    assert met < 4096 and best.at.tolist() == want.tolist() and best.scores.tolist() == scores[want].tolist()


def test_large_components_stay_exact():
    x = np.array([[2 ** 24, 2 ** 24 - 1], [2 ** 24, 2 ** 24]] * 300)
    lists = NG.SortedLists(x, 2 ** 24)
    best = NG.Best(1, *NG.ALL)
    lists.search(np.array([2 ** 24, 2 ** 24]), [best], lambda at, s: best.offer(at, s, np.arange(600), np.zeros(600, bool)))
    assert best.scores.tolist() == [2 ** 49] and best.at.tolist() == [1]


def test_query_is_whole(spark):
    rows = QUERIES["op11_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                 "positive_score": "bigint", "negative_score": "bigint"}
