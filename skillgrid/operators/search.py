"""Ranked text search (V4-V6) over an inverted index, with score bounds.

* index: (doc, term, tf), the words of a document counted within its row;
* idf per term from a grouped count of the index (map-side combine, so a term
  present in every document is one counter per task, not a hot shuffle key);
* terms with idf = 0 (present in every document) cannot change a score, so
  they are dropped before the join - exact, and it removes the largest posting
  lists;
* most postings of common words are never scored.  A term's postings lie in
  blocks of falling weight, each with a greatest weight.  A query reads the
  first blocks of its lists, about K postings of each, with the least K for
  which the greatest weights of the unread blocks add up to less than the n-th
  best score: a document that stands in unread blocks only cannot be among the
  best n.  Of those met, the ones that can still win have their unread weights
  looked up;
* the threshold comes from the first blocks of the lists (rare words' lists
  whole): the n-th best sum over them is a lower bound of the n-th best score.

Scores, and so ranks, are those of the full sum; nothing is approximated.  No
query x document cross join is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.materialize import stored

HEAD = 16          # postings of each word, per result row, that the first threshold may read
BLOCKS = 64        # blocks of a list
NOISE = 1e-8       # far above summation noise, and above what rounding scores to 1e-9 can move

TOKEN_SPLIT = r"[^\p{L}]+"


def tokens(text) -> F.Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != "")


def row_postings(docs: DataFrame, key: str, text: str, attrs=()) -> DataFrame:
    """(attrs..., key, doc_len, term, cnt): the words of each row counted within the row, so that nothing is shuffled.

    The sorted words are cut into runs of equal words; a run is one posting.
    """
    word = lambda i: F.get("_tok", i)
    t = docs.select(key, *attrs, F.sort_array(tokens(text)).alias("_tok")).withColumn("doc_len", F.size("_tok"))
    places = F.when(F.col("doc_len") > 0, F.sequence(F.lit(0), F.col("doc_len") - 1))
    t = t.withColumn("_starts", F.filter(places, lambda i: ~word(i).eqNullSafe(word(i - 1))))
    runs = F.transform("_starts", lambda at, j: F.struct(
        word(at).alias("term"), (F.coalesce(F.get("_starts", j + 1), F.col("doc_len")) - at).cast("long").alias("cnt")))
    return t.select(key, *attrs, "doc_len", F.explode(runs).alias("_run")).select(key, *attrs, "doc_len", "_run.term", "_run.cnt")


def document_postings(docs: DataFrame, key: str, text: str, attrs=()) -> DataFrame:
    """(attrs..., term, key, doc_len, cnt) of every document.

    Rows are counted each by itself; only rows that share their key, or have
    none, meet in a grouped sum.  Their keys are written first, so that the
    join with them is planned by their size.
    """
    cols = [*attrs, "term", key, "doc_len"]
    several = stored(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(key).isNull()).select(key), "repeated-keys")
    if several.isEmpty():
        return row_postings(docs, key, text, attrs).select(*cols, "cnt")
    named = several.filter(F.col(key).isNotNull())
    lone = docs.filter(F.col(key).isNotNull()).join(named, key, "left_anti")
    together = docs.join(named, key, "left_semi").select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))
    return (row_postings(lone, key, text, attrs).select(*cols, "cnt")
            .unionByName(row_postings(together, key, text, attrs).groupBy(*cols).agg(F.sum("cnt").alias("cnt"))))


def build_index(docs: DataFrame, key: str, text: str, attrs=()) -> DataFrame:
    """V6: inverted index rows (attrs..., term, key, doc_len, cnt, tf)."""
    return document_postings(docs, key, text, attrs).withColumn("tf", F.col("cnt") / F.col("doc_len"))


def idf(index: DataFrame, key: str, n_docs) -> DataFrame:
    """ln(N / df) per term."""
    return (index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .withColumn("idf", F.log(F.lit(n_docs).cast("double") / F.col("df"))))


def query_terms(queries: DataFrame, qkey: str, text: str) -> DataFrame:
    return queries.select(qkey, F.explode(F.array_distinct(tokens(text))).alias("term"))


def vocabulary_postings(docs: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(term, key, tf, block) of the vocabulary's words.

    Blocks are quarter octaves of tf, so a list has at most ``BLOCKS`` of them whatever its length.

    Other words are dropped right after the explode (semi join; its strategy
    follows the measured size), so only query words are counted and shuffled.
    """
    t = docs.select(key, tokens(text).alias("_tok")).withColumn("doc_len", F.size("_tok"))
    post = (t.select(key, "doc_len", F.explode("_tok").alias("term"))
            .join(vocab, "term", "left_semi")
            .groupBy("term", key, "doc_len").agg(F.count(F.lit(1)).alias("cnt"))
            .select("term", key, (F.col("cnt") / F.col("doc_len")).alias("tf")))
    block = F.floor(F.lit(4.0) * -F.log2("tf")).cast("int")
    return post.withColumn("block", F.least(F.greatest(block, F.lit(0)), F.lit(BLOCKS - 1)))


def weight_blocks(post: DataFrame, n_docs) -> DataFrame:
    """(term, block, n, above, df, idf, bound): each list's blocks, with the postings before them and their greatest weight.

    Terms with idf = 0 have none.
    """
    counts = post.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("top"))
    every = Window.partitionBy("term")
    return (counts.withColumn("df", F.sum("n").over(every)).withColumn("idf", F.log(F.lit(n_docs).cast("double") / F.col("df"))).filter(F.col("idf") > 0)
            .withColumn("above", F.coalesce(F.sum("n").over(every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .select("term", "block", "n", "above", "df", "idf", (F.col("idf") * F.col("top")).alias("bound")))


def _nth_best(scores: DataFrame, qkey: str, score: str, n: int) -> DataFrame:
    """(qkey, least): the n-th best score of each query that has n rows (limited per task before the shuffle)."""
    w = Window.partitionBy(qkey).orderBy(F.col(score).desc())
    return (scores.select(qkey, score).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .filter(F.col("_rn") == n).select(qkey, F.col(score).alias("least")))


def query_cuts(post: DataFrame, blocks: DataFrame, qt: DataFrame, key: str, qkey: str, n: int) -> DataFrame:
    """(qkey, term, idf, cut, rest): each query reads the blocks before ``cut`` of a list; no other weight exceeds ``rest``."""
    lists = blocks.groupBy("term").agg(F.first("idf").alias("idf"), F.first("df").alias("df"))
    first = (blocks.filter(F.col("above") + F.col("n") <= HEAD * n).groupBy("term")
             .agg(F.max("block").alias("_last"), F.first("idf").alias("idf")))
    heads = (post.join(first, "term").filter(F.col("block") <= F.col("_last")).select("term", key, (F.col("tf") * F.col("idf")).alias("w")))
    terms = qt.join(lists, "term")
    partial = heads.join(qt, "term").groupBy(qkey, key).agg(F.sum("w").alias("part"))
    floor = _nth_best(partial, qkey, "part", n)
    # the places where reading a list may stop: before each block, or at its end
    stops = blocks.select("term", F.col("above").alias("read"), F.struct(F.col("block").alias("cut"), F.col("bound").alias("rest")).alias("stop"))
    ends = lists.select("term", F.col("df").alias("read"), F.struct(F.lit(BLOCKS).alias("cut"), F.lit(0.0).alias("rest")).alias("stop"))
    # at depth j a list is read to its last stop of at most 2^j postings: each stop serves a run of depths
    deep = lambda c: F.when(c > 0, F.ceil(F.log2(c))).otherwise(F.lit(0)).cast("int")
    following = F.lead("read").over(Window.partitionBy("term").orderBy("read"))
    per_depth = (stops.union(ends).withColumn("_next", following).withColumn("longest", lists.agg(F.max("df")).scalar())
                 .withColumn("_from", deep(F.col("read"))).withColumn("_to", F.when(F.col("_next").isNull(), deep(F.col("longest"))).otherwise(deep(F.col("_next")) - 1))
                 .filter(F.col("_from") <= F.col("_to"))
                 .select("term", F.explode(F.sequence("_from", "_to")).alias("j"), "stop"))
    sums = qt.join(per_depth, "term").groupBy(qkey, "j").agg(F.sum("stop.rest").alias("unread"))
    chosen = (sums.join(floor, qkey, "left").filter((F.col("unread") == 0) | (F.col("unread") < F.col("least") - NOISE))
              .groupBy(qkey).agg(F.min("j").alias("j")))
    return (terms.join(chosen, qkey).join(per_depth, ["term", "j"])
            .select(qkey, "term", "idf", F.col("stop.cut").alias("cut"), F.col("stop.rest").alias("rest")))


def candidates(post: DataFrame, cuts: DataFrame, key: str, qkey: str) -> DataFrame:
    """(qkey, key, part, seen): documents in the blocks that a query reads, their weights there, and what these took of the bound.

    Blocks that no query reads leave before the join.
    """
    lists = cuts.groupBy("term").agg(F.first("idf").alias("idf"), F.max("cut").alias("_deepest"))
    read = (post.join(lists, "term").filter(F.col("block") < F.col("_deepest"))
            .select("term", key, "block", (F.col("tf") * F.col("idf")).alias("w")))
    return (read.join(cuts.select(qkey, "term", "cut", "rest"), "term").filter(F.col("block") < F.col("cut"))
            .groupBy(qkey, key).agg(F.sum("w").alias("part"), F.sum("rest").alias("seen")))


def bounded_topn(post: DataFrame, cuts: DataFrame, key: str, qkey: str, n: int) -> DataFrame:
    """(qkey, key, score, rank): the best n documents of every query; ties broken by document key."""
    cand = stored(candidates(post, cuts, key, qkey), "candidates")
    unread = cuts.groupBy(qkey).agg(F.sum("rest").alias("unread"))
    floor = _nth_best(cand, qkey, "part", n)
    alive = (cand.join(unread, qkey).join(floor, qkey, "left")
             .filter(F.col("part") + F.col("unread") - F.col("seen") >= F.coalesce("least", F.lit(0.0)) - NOISE)
             .select(qkey, key, "part"))
    # the weights in unread blocks, looked up for what is left
    light = (alive.select(qkey, key).join(cuts.filter(F.col("rest") > 0), qkey).join(post, ["term", key])
             .filter(F.col("block") >= F.col("cut")).groupBy(qkey, key).agg(F.sum(F.col("tf") * F.col("idf")).alias("light")))
    scored = alive.join(light, [qkey, key], "left").select(qkey, key, (F.col("part") + F.coalesce("light", F.lit(0.0))).alias("score"))
    # Rank on the score rounded to 1e-9 so summation-order noise cannot reorder true ties.
    w = Window.partitionBy(qkey).orderBy(F.round("score", 9).desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def search_topn(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, qtext: str,
                n: int = 10) -> DataFrame:
    """V4: TF-IDF top-n documents per query; ties broken by document key."""
    qt = stored(query_terms(queries, qkey, qtext), "query-terms")
    post = stored(vocabulary_postings(docs, key, text, qt.select("term").distinct()), "postings")    # read by thresholds and scores
    blocks = stored(weight_blocks(post, docs.select(F.count(F.lit(1))).scalar()), "blocks")
    cuts = stored(query_cuts(post, blocks, qt, key, qkey, n), "query-cuts")
    return bounded_topn(post, cuts, key, qkey, n)
