import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from skillgrid.llm import decontaminate as DC
from skillgrid.llm.queries import QUERIES

from .conftest import ODD, SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def slow(text, items, window=10):
    """items: (id, text) -> contract row without doc_id, by comparing word lists everywhere."""
    words = WORD.findall(lower(text))
    hit, found = set(), []
    for item, body in items:
        w = WORD.findall(lower(body))
        grams = {tuple(w[i:i + window]) for i in range(len(w) - window + 1)} if len(w) >= window else {tuple(w)} if w else set()
        size = min(window, len(w))
        at = [i for i in range(len(words) - size + 1) if tuple(words[i:i + size]) in grams]
        if at:
            found.append(str(item))
        for i in at:
            hit.update(range(i, i + size))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_query_against_word_lists(spark, documents):
    items = duckdb.execute(f"SELECT item_id, text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op6_decontamination"](spark, SF).collect()}
    assert got == {d: slow(t, items) for d, t in documents}
    assert any(r[4] for r in got.values()) and not all(r[4] for r in got.values())


@pytest.mark.parametrize("seed", range(40))
def test_automaton_random(seed):
    """Few different words, items shorter and longer than the window, equal and nested items."""
    rng = random.Random(seed)
    window = rng.choice([2, 3, 5])
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(1, 5))]
    items += [(99, items[0][1])]
    a = DC.Automaton.build([DC.words_of(t) for _, t in items], window)
    for _ in range(20):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
        spans, found = a.hits(DC.words_of(text), window)
        n, n_hit, n_items, _, _ = slow(text, items, window)
        assert sum(e - s for s, e in spans) == n_hit and len(found) == n_items


def test_blocks_agree(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = DC.matches(docs, items).collect()
    many = DC.matches(docs, items, block_words=150).collect()
    assert sorted((r.doc_id, r.spans, r.items) for r in one) == sorted((r.doc_id, r.spans, r.items) for r in many)
    kept = [sorted((r.doc_id, r.text) for r in DC.cleaned(docs, items, block_words=n).collect()) for n in (100_000, 150)]
    assert kept[0] == kept[1] != sorted(documents)


def test_blocks_are_bounded(spark, documents):
    """Every automaton holds one item or at most the given words, and all items with words are in one block each."""
    rows = [(d, t) for d, t in documents[:200]] + [(-1, "long " * 900), (-2, None), (-3, " ")]
    items = spark.createDataFrame(rows, "item_id long, text string").repartition(7)
    blocks = DC.item_blocks(items, 10, block_words=500)
    words = {str(d): len(DC.words_of(t)) for d, t in rows}
    held = [ids for ids, _ in blocks]
    assert blocks.count == len(held) > 10
    assert all(len(ids) == 1 or sum(words[i] for i in ids) <= 500 for ids in held)
    assert sorted(i for ids in held for i in ids) == sorted(d for d, n in words.items() if n)


def test_pools(monkeypatch):
    """Several blocks: rows are held in pools, none lost, in order; a pool closes once it is full."""
    monkeypatch.setattr(DC, "POOL_BYTES", 100)
    batches = [pa.record_batch([pa.array([i]), pa.array(["x" * 30])], names=["doc_id", "text"]) for i in range(10)]
    pools = list(DC.Blocks(("a",), 2).pools(iter(batches), "text"))
    assert [i for p in pools for i in p.column("doc_id").to_pylist()] == list(range(10))
    assert 1 < len(pools) < 10


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, "two words"), (1, None), (2, ""), (3, "ONE"), (4, "a b c a b c a b c a b c")], "item_id long, text string")
    rows = [(i if i is not None else "", t) for i, t in [(None, "two words"), (3, "ONE"), (4, "a b c a b c a b c a b c")]]
    got = sorted(map(str, (tuple(r) for r in DC.report(odd_docs, items).collect())))
    assert got == sorted(str((d, *slow(t, rows))) for d, t in ODD)
    assert DC.report(no_docs, items).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated for r in DC.report(odd_docs, none).collect())


def test_cleaned(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    filler = " ".join(f"z{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{filler}\nThen {passage.upper()}, and  more.", "x", 9), (2, filler, "y", 8), (3, passage, "z", 7), (4, None, None, None)],
                                 "doc_id long, text string, lang string, n_chars long")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in DC.cleaned(docs, items).collect()}
    want = f"{filler}\nThen, and  more."
    assert set(got) == {1, 2, 4} and got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == filler and got[2].n_chars == 8 and got[4].text is None
