"""Commit log, buckets and conflicts of keyed tables."""

import threading
import uuid

import pytest

from skillgrid.session import scratch_path
from skillgrid.sources import materialize as M
from skillgrid.sources.keyed import KeyedTable, SharedFolder

SCHEMA = "id long, v string, n int"


def table(spark, path=None, buckets=8):
    return KeyedTable(spark, path or scratch_path(spark, f"keyed-{uuid.uuid4().hex}"), SCHEMA, "id", buckets)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(df):
    return sorted((r.id, r.v, r.n) for r in df.collect())


def test_upsert_rewrites_touched_buckets_only(spark):
    t = table(spark)
    t.insert_new(rows(spark, *[(i, "a", i) for i in range(100)]))
    before = t.snapshot()
    t.upsert(rows(spark, (5, "b", 1), (5, "c", 2), (5, "d", 0), (None, "x", 9), (500, "new", 1)), order=["n"])
    after = t.snapshot()
    changed = [b for b in after.files if after.files[b] != before.files.get(b)]
    assert 1 <= len(changed) <= 2 and len(before.files) == 8          # the other buckets keep their very files
    assert held(after.read()) == sorted([(i, "a", i) for i in range(100) if i != 5] + [(5, "c", 2), (500, "new", 1)])
    assert held(before.read()) == [(i, "a", i) for i in range(100)]    # pinned


def test_ties_have_one_winner_and_repeats_add_nothing(spark):
    t = table(spark)
    t.insert_new(rows(spark, (1, "a", 1), (1, "b", 1), (1, None, 1)))
    first = held(t.read())
    assert len(first) == 1
    v = t.insert_new(rows(spark, (1, "z", 9)))
    assert held(t.read()) == first and t.snapshot().version == v
    t2 = table(spark)
    t2.insert_new(rows(spark, (1, None, 1), (1, "b", 1), (1, "a", 1)))
    assert held(t2.read()) == first                                    # whatever the order of the rows


def test_delete_compact_and_empty(spark):
    t = table(spark)
    assert held(t.read()) == [] and t.upsert(rows(spark)) == 0
    for k in range(5):
        t.insert_new(rows(spark, *[(10 * k + i, "a", k) for i in range(10)]))
    t.delete(rows(spark, *[(i, None, None) for i in range(0, 50, 2)], (999, None, None)))
    want = [(i, "a", i // 10) for i in range(1, 50, 2)]
    assert held(t.read()) == want
    t.insert_new(rows(spark, (0, "b", 0)))
    t.compact(most=1)
    assert held(t.read()) == [(0, "b", 0), *want] and all(len(f) == 1 for f in t.snapshot().files.values())
    t.delete(t.read())
    assert held(t.read()) == []


def test_survives_a_new_application(spark):
    t = table(spark, buckets=4)
    t.insert_new(rows(spark, (1, "a", 1)))
    M._WRITTEN.clear()                                                 # nothing in the process is needed
    again = KeyedTable(spark.newSession(), t.path, SCHEMA, "id", buckets=16)
    assert again.buckets == 4
    again.insert_new(rows(spark, (1, "b", 1), (2, "b", 2)))
    assert held(t.read()) == [(1, "a", 1), (2, "b", 2)]
    name, df = f"model-{uuid.uuid4().hex}", rows(spark, (1, "a", 1))
    M.materialize(df, name, "incremental", "id")
    M._WRITTEN.clear()
    assert held(M.materialize(rows(spark, (1, "z", 1), (3, "c", 3)), name, "incremental", "id")) == [(1, "a", 1), (3, "c", 3)]


def test_writers_at_once_lose_nothing(spark):
    path = table(spark).path
    failures = []

    def work(w):
        try:
            t = KeyedTable(spark, path, SCHEMA, "id", 8)
            for k in range(3):
                t.upsert(rows(spark, (w * 100 + k, f"w{w}", k), (7, f"w{w}", k)))
        except Exception as e:
            failures.append(e)
    threads = [threading.Thread(target=work, args=(w,)) for w in range(1, 4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    got = held(table(spark, path).read())
    assert not failures and [r[0] for r in got] == sorted([7] + [w * 100 + k for w in range(1, 4) for k in range(3)])
    assert table(spark, path).snapshot().version == 9                  # every change is a version of its own


def test_a_late_writer_keeps_its_files_where_buckets_are_untouched(spark):
    t = table(spark)
    t.insert_new(rows(spark, *[(i, "a", i) for i in range(64)]))
    other = table(spark, t.path)
    calls, real = [], t._write

    def slow_write(df):
        made = real(df)
        calls.append(made)
        if len(calls) == 1:                                            # another writer commits between our files and our manifest
            mine = next(iter(made))
            far = next(r.id for r in t._bucketed(t.read()).collect() if str(r.bucket) != mine)
            other.upsert(rows(spark, (far, "other", 0)))
        return made
    t._write = slow_write
    t.upsert(rows(spark, (3, "mine", 0)))
    got = {r.id: r.v for r in t.read().collect()}
    assert len(calls) == 1 and got[3] == "mine" and sorted(got.values()).count("other") == 1 and len(got) == 64


def test_put_if_absent(spark):
    f = SharedFolder(spark, scratch_path(spark, f"log-{uuid.uuid4().hex}"))
    assert f.put_if_absent("1.json", "é") and not f.put_if_absent("1.json", "b")
    assert f.read("1.json") == "é" and f.names() == ["1.json"]
    with pytest.raises(ValueError):
        table(spark).snapshot(3)
