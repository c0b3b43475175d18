import random
import uuid

from skillgrid.llm import rollups as RL
from skillgrid.llm.queries import QUERIES, TOKENIZERS
from skillgrid.llm.tokens import Tokenizer

from .conftest import SF


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def slow_totals(state):
    out = {}
    for (_, tok), (source, lang, n) in state.items():
        d, t = out.get((source, lang, tok), (0, 0))
        out[source, lang, tok] = d + 1, t + n
    return out


def test_query_against_recount(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    state = {}
    for r in docs:
        one, two = (t.count(r.text) for t in TOKENIZERS)
        mark = labels.get(r.doc_id)
        if mark is not None and mark.toxic == 1:
            continue
        state[r.doc_id, TOKENIZERS[0].version] = (r.source, r.lang, two if mark is not None and mark.quality == 0 else one)
        state[r.doc_id, TOKENIZERS[1].version] = (r.source, r.lang, two)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in QUERIES["op5_token_rollups"](spark, SF).collect()}
    assert got == slow_totals(state)


def test_random_batches(spark, tmp_path):
    """Inserts, deletes, revisions and moves in any order, repeated and broken-off commits."""
    rng = random.Random(5)
    rollup, state = RL.TokenRollup(spark, str(tmp_path / "ledger")), {}
    assert totals(rollup) == {}
    for b in range(4):
        changes = [(rng.choice([None, *range(12)]), rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]),
                    rng.choice(["insert", "insert", "revise", "delete"]), rng.choice([None, 3, 8, 13]), i) for i in range(10)]
        df = spark.createDataFrame(changes, RL.CHANGE)
        if b == 2:  # a writer that died before its commit record
            RL.TokenRollup._compare(rollup, df.limit(4)).selectExpr("*", f"'{b}' AS batch").write.mode("append").partitionBy("batch").parquet(f"{rollup.path}/deltas")
            assert totals(rollup) == slow_totals(state)
        assert rollup.commit(str(b), df)
        for doc, source, lang, tok, op, n, _ in changes:
            state.pop((doc, tok), None)
            if op != "delete":
                state[doc, tok] = (source, lang, n or 0)
        assert totals(rollup) == slow_totals(state)
        assert not rollup.commit(str(b), df) and totals(rollup) == slow_totals(state)


def test_odd_rows(spark, tmp_path, no_docs):
    docs = spark.createDataFrame([(1, None, None, "en"), (2, "", "s", None), (3, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    rows = RL.token_counts(docs, TOKENIZERS[:1]).collect()
    assert sorted((r.doc_id, r.source, r.lang, r.n_tokens) for r in rows) == [(1, None, "en", 0), (2, "s", None, 0), (3, "s", "en", 2)]
    assert RL.token_counts(no_docs, TOKENIZERS).collect() == []
    rollup = RL.TokenRollup(spark, str(tmp_path / "none"))
    assert rollup.commit("empty", spark.createDataFrame([], RL.CHANGE)) and totals(rollup) == {}


def test_rows_without_or_with_shared_ids_all_count(spark, odd_docs):
    """Null ids, repeated ids and equal rows: the totals are those of all rows, and deletes take all of them away."""
    docs = odd_docs.selectExpr("doc_id", "text", "'en' AS lang", "CASE WHEN doc_id = 5 THEN NULL ELSE 's' END AS source", "1 AS fold", "2 AS row", "3 AS copies")
    docs = docs.union(docs.where("doc_id IS NULL")).union(docs.where("doc_id = 6").withColumn("text", docs.lang))
    t = Tokenizer("t")
    want = {}
    for r in docs.collect():
        k, n = want.get((r.source, r.lang), (0, 0))
        want[(r.source, r.lang)] = (k + 1, n + t.count(r.text))
    rollup = RL.TokenRollup(spark, f"{spark.sparkContext.getCheckpointDir()}/rollup-all-{uuid.uuid4().hex}")
    rows = RL.counted_rows(RL.token_counts(docs, [t]))
    rollup.commit("in", rows.selectExpr("*", "'insert' AS op", "1L AS seq"))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == want
    rollup.commit("out", rows.where("doc_id IS NULL").selectExpr("*", "'delete' AS op", "1L AS seq"))
    gone = docs.where("doc_id IS NULL").collect()
    k, n = want[("s", "en")]
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().where("source = 's'").collect()} == {
        ("s", "en"): (k - len(gone), n - sum(t.count(r.text) for r in gone))}
