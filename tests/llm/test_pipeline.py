import re

import duckdb
import pytest

import corpus_pipeline as CP
from skillgrid.llm.packing import CAPACITIES
from skillgrid.llm.tokens import Tokenizer

from .conftest import SF
from .test_decontaminate import WORD, lower
from .test_packing import check as check_packing
from .test_quality import slow as measure
from .test_simhash import slow_fp, slow_groups


def rejected(text):
    n, chars, symbols, lines, dup, again, caps, latin = measure(text)
    return (n < 10 or 100 * again > 20 * n or 10 * symbols > n or 100 * dup > 35 * lines or 10 * chars < 25 * n or chars > 12 * n or 2 * caps > latin)


def cut_words(text, words, gone):
    """``text`` without the words (match objects) whose index is in ``gone``, and without the blanks before each removed run."""
    out, at, i = "", 0, 0
    while i < len(words):
        if i in gone:
            out += text[at:words[i].start()].rstrip(" \t")
            while i in gone:
                at = words[i].end()
                i += 1
        else:
            i += 1
    return out + text[at:]


def slow_pipeline(docs, items):
    """docs: (id, text) sorted by id; every stage by brute force."""
    docs = [(d, t) for d, t in docs if not rejected(t)]
    after = [len(docs)]
    groups = slow_groups([(d, slow_fp(t)) for d, t in docs])
    docs = [(d, t) for (d, t), g in zip(docs, groups) if d == g]
    after.append(len(docs))
    seen, out = set(), []
    for d, t in docs:
        ms = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
        ws = [m[0] for m in ms]
        grams = [tuple(ws[i:i + 50]) for i in range(len(ws) - 49)]
        gone = {j for i, g in enumerate(grams) if g in seen for j in range(i, i + 50)}
        seen.update(grams)
        if len(gone) < len(ws):
            out.append((d, cut_words(t, ms, gone) if gone else t))
    after.append(len(out))
    windows = {tuple(w[i:i + 10]) for _, b in items for w in [WORD.findall(lower(b))] if w for i in range(max(1, len(w) - 9))}
    sizes, clean = {len(w) for w in windows}, []
    for d, t in out:
        ms = list(WORD.finditer(lower(t)))
        ws = [m[0] for m in ms]
        hit = {j for k in sizes for i in range(len(ws) - k + 1) if tuple(ws[i:i + k]) in windows for j in range(i, i + k)}
        if 2 * len(hit) < len(ws) or not hit:
            clean.append((d, cut_words(t, ms, hit) if hit else t))
    after.append(len(clean))
    return clean, after


def test_run_against_brute_force(spark, documents):
    items = duckdb.execute(f"SELECT item_id, text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    want, after = slow_pipeline(documents, items)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in CP.STAGES[:-1]:
        docs = CP.staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == after and after[-1] < after[0] < len(documents)
    for mine, other in zip(sorted((r.doc_id, r.text) for r in docs.collect()), want):
        at = next((i for i, (a, b) in enumerate(zip(mine[1], other[1])) if a != b), None)
        assert mine == other, (at, mine[1][max(0, (at or 0) - 60):][:120], other[1][max(0, (at or 0) - 60):][:120])
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    check_packing(CP.run(spark, SF).collect(), want, Tokenizer("x"), CAPACITIES)


@pytest.mark.parametrize("name,stage", CP.STAGES)
def test_stages_on_odd_rows(spark, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, SF)
    assert name == "best_fit_packing" or out.columns == odd_docs.columns
    out.collect()
    assert stage(spark, no_docs, SF).count() == 0
