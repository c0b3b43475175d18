import re
from collections import Counter

from skillgrid.llm import quality as QL

from .conftest import ODD


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(again),
            len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)))


def test_query_matches_twin(twin):
    mine, other = twin("op1_quality_rules")
    assert mine == other and mine


def test_odd_rows(spark, odd_docs, no_docs):
    rows = QL.ledger(odd_docs).collect()
    assert sorted(str((r.doc_id, *(r[m] for m in QL.MEASURES))) for r in rows) == sorted(str((d, *slow(t))) for d, t in ODD)
    assert QL.ledger(no_docs).collect() == []
    assert QL.kept_documents(no_docs).count() == 0
    kept = QL.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {d for d, t in ODD if d is not None and not slow(t)[0] < 10 and not 100 * slow(t)[5] > 20 * slow(t)[0]}
    assert {r.doc_id for r in kept.collect()} <= want


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 2), (5, 128)], "doc_id long, fail_bits long")
    kept = {p.version: [r.doc_id for r in QL.apply_policy(rows, p).where("kept").orderBy("doc_id").collect()] for p in (QL.BASE,)}
    assert kept == {1: [1, 5]}
    got = {r.rule: (r.n_failed, r.n_only_this, r.n_rows) for r in QL.ablation(rows, QL.BASE).collect()}
    assert got == {"too_few_words": (2, 1, 5), "repeated_word_windows": (2, 1, 5)}
    groups = QL.shared_failures(rows.selectExpr("*", "doc_id > 2 AS late"), "late").collect()
    assert {r.late: (r.all_fail, r.any_fail, r.n_clean, r.n_rows) for r in groups} == {False: (0, 1, 1, 2), True: (0, 131, 0, 3)}


def test_labelled_documents(spark):
    """The standard policy keeps nearly all documents of quality 1 and rejects most of quality 0."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = QL.apply_policy(QL.ledger(docs), QL.STANDARD).join(labels, "doc_id")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg({"*": "count"}).join(
        judged.selectExpr("quality", "cast(kept AS int) AS k").groupBy("quality").avg("k").withColumnRenamed("avg(k)", "share"), "quality").collect()}
    assert share[1] > 0.95 and share[0] < 0.1
