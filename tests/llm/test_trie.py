import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skillgrid.llm import trie as TR
from skillgrid.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part int, node string, words string"


def slow(convs):
    """{conv_id: [(role, text), ...]} -> the nodes, by a dictionary of all prefixes."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)

    def below(p):
        yield p
        for k in kids[p]:
            yield from below(k)

    out = []
    for p, own in members.items():
        tree = list(below(p))
        words = [(len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in tree if q]
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), sum(not kids[q] for q in tree),
                    sum(words), hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=str)


def fast(spark, convs, parts):
    rows = [(c, None if k == 0 else k, r, t, 1, "x", "y") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = TR.prefix_trie(TR.conversations(spark.createDataFrame(rows, SCHEMA)), parts)
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_twin(twin):
    mine, other = twin("op13_conversation_trie")
    assert mine == other and mine


@pytest.mark.parametrize("seed,parts", [(0, 1), (1, 3), (2, 7), (3, 40)])
def test_random_trees_over_ranges(spark, seed, parts):
    rng = random.Random(seed)
    convs = {}
    for c in range(120):
        turns = [(rng.choice(["user", ""]), " ".join(["w"] * rng.randint(0, 2))) for _ in range(rng.choice([1, 2, 3, 4, 9]))]
        convs[c * 7 - 30] = turns
    assert fast(spark, convs, parts) == slow(convs)


def test_one_conversation_copied_across_all_ranges(spark):
    long = [("user", f"turn {i}") for i in range(12)]
    convs = {i: list(long) for i in range(90)} | {500 + i: long[:5] for i in range(40)} | {700 + i: long + [("a", f"{i} b")] for i in range(9)}
    assert fast(spark, convs, 16) == slow(convs)


def rebuilt(rows):
    own = defaultdict(list)
    for c, k, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            own[c].append((k is not None, k or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32], r, t))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def test_odd_rows_and_openings(spark):
    rows = [(20, 1, "user", "a b"), (20, 2, None, None), (20, 2, "", ""), (20, None, "user", "first"), (21, 0, "user", "x"), (21, 0, "user", "x"),
            (22, 5, None, "t" * 40_000), (23, None, None, None), (None, 1, "user", "no id"), (None, None, None, None), (47, 1, "u", "base is absent"),
            (47, 2, "u", "b"), (40 + 1, 3, "u", " \t\n"), (24, 1, "user", "a b"), (25, 1, "1:u", "ser"), (25, 1, "1:", "user")]
    rows += [(c, k, "user", f"{k % 2}") for c in range(60, 100) for k in range(c % 4)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    opening = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    got = TR.prefix_trie(TR.shared_openings(TR.conversations(df), 20, opening, 3), 5)
    assert sorted([tuple(r) for r in got.collect()], key=str) == slow(rebuilt(rows))


def test_empty_table(spark):
    df = TR.prefix_trie(TR.conversations(spark.createDataFrame([], SCHEMA)))
    assert df.collect() == [] and [c for c, _ in df.dtypes] == [c.split()[0] for c in TR.NODE.split(", ")]


def test_query_is_whole(spark):
    rows = QUERIES["op13_conversation_trie"](spark, "/root/testdata/sf0.01").collect()
    data = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted([tuple(r) for r in rows], key=str) == slow(rebuilt([tuple(r) for r in data]))
