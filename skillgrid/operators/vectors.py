"""Vector operators.

Cosine similarity is a higher-order-function expression in double precision
(no Python).  A single query vector is attached as a scalar subquery, which
Spark evaluates once and inlines as a literal: no join, no shuffle.  A set of
queries is ranked by matrix products of bounded blocks, in numpy inside tasks;
slabs of rows that lie too far from a query, by their distances to a few pivot
rows, are skipped, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col
from ..sources.materialize import stored

EMBED_DIM = 768


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cosine_similarity(a, b) -> Column:
    """V2: cos(a, b) in double; NULL when either vector is NULL or has zero norm."""
    a = _col(a).cast("array<double>")
    b = _col(b).cast("array<double>")
    denom = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(denom > 0, _dot(a, b) / denom)


def hybrid_score(similarity, rating, sim_weight: float = 0.7, rating_weight: float = 0.3,
                 sentinel_as_missing: bool = True) -> Column:
    """V3: ``0.7 * cosine + 0.3 * rating / 5``.

    A rating of -1 is the "no rating" sentinel; by default it contributes 0
    (the reference would subtract 0.06; pass ``sentinel_as_missing=False``).
    """
    r = _col(rating).cast("double")
    if sentinel_as_missing:
        r = F.when(r < 0, F.lit(0.0)).otherwise(r)
    return _col(similarity) * sim_weight + (r / 5.0) * rating_weight


def query_vector(vectors: DataFrame, key_col: str, key, vec_col: str) -> Column:
    """The vector of one row as a scalar subquery (evaluated once per query)."""
    return vectors.filter(F.col(key_col) == key).select(vec_col).scalar()


def score_against(df: DataFrame, vec_col: str, query: Column, out: str = "similarity") -> DataFrame:
    """Every row scored against one query vector.

    The query (often a scalar subquery) is projected into a column first:
    subqueries may not sit inside higher-order functions.
    """
    return df.withColumn("_qvec", query).withColumn(out, cosine_similarity(vec_col, "_qvec")).drop("_qvec")


def score_histogram(df: DataFrame, score_col: str, digits: int = 2) -> DataFrame:
    """A2: number of rows per (rounded) score, highest score first."""
    # ``+ 0.0`` folds a rounded -0.0 into 0.0 so both signs share one bucket.
    return (df.groupBy((F.round(score_col, digits) + F.lit(0.0)).alias("score"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("score").desc_nulls_last()))


def _component(h, dim: int):
    """(component, 0 for plus or 1 for minus) of a word's MD5."""
    return ((F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int"),
            F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2)


def embed_text(df: DataFrame, key: str, text_col: str, dim: int = EMBED_DIM) -> DataFrame:
    """V1: (key, i, x): the unit vector of a text by feature hashing, one row per component that is not 0.

    A word's MD5 gives its component (first 32 bits modulo ``dim``) and its sign
    (parity of the next digit); a component is the signed count of its words.
    Counting is a partial aggregation on (key, i), and no vector is ever longer
    than ``dim``.  A text without words, or whose signed counts all cancel, has
    no rows.  Keys must be unique.
    """
    from .search import tokens
    word = df.select(F.col(key), F.explode(tokens(text_col)).alias("_w")).withColumn("_h", F.md5(F.col("_w").cast("binary")))
    place, odd = _component(F.col("_h"), dim)
    sign = F.when(odd == 0, 1).otherwise(-1)
    counts = (word.groupBy(key, place.alias("i")).agg(F.sum(sign).cast("double").alias("c")).filter(F.col("c") != 0))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(key)))
    return counts.select(key, "i", (F.col("c") / norm).alias("x"))


def same_row_similarity(df: DataFrame, key: str, stored_text: str, other_text: str) -> DataFrame:
    """V2: (key, similarity): each row's vector against the vector of another text of that row.

    Both vectors of a row are made and multiplied within the row; only rows
    that share their key meet, as one text each.  Rows of which one text has no
    vector, or without a key, have a NULL similarity.
    """
    several = stored(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(key).isNull()).select(key), "repeated-keys")
    if several.isEmpty():
        return _within_rows(df, key, stored_text, other_text)
    named = several.filter(F.col(key).isNotNull())
    lone = df.filter(F.col(key).isNotNull()).join(named, key, "left_anti")
    none = df.filter(F.col(key).isNull()).select(key, F.lit(None).cast("double").alias("similarity"))
    return (_within_rows(lone, key, stored_text, other_text).unionByName(none)
            .unionByName(_by_key(df.join(named, key, "left_semi"), key, stored_text, other_text)))


def _within_rows(df: DataFrame, key: str, stored_text: str, other_text: str, dim: int = EMBED_DIM) -> DataFrame:
    """Every word becomes a number (component, sign, text); sorted, the words of a component stand together and are folded."""
    from .search import tokens

    def codes(text, side):
        def code(w):
            place, odd = _component(F.md5(w.cast("binary")), dim)
            return place * 4 + odd * 2 + side
        return F.transform(tokens(text), code)

    at = lambda i: F.get("_codes", i)
    t = df.select(key, F.sort_array(F.concat(codes(stored_text, 0), codes(other_text, 1))).alias("_codes"))
    places = F.when(F.size("_codes") > 0, F.sequence(F.lit(0), F.size("_codes") - 1))
    t = t.withColumn("_starts", F.filter(places, lambda i: ~at(i).eqNullSafe(at(i - 1))))
    runs = F.transform("_starts", lambda s, j: F.struct(at(s).alias("code"), (F.coalesce(F.get("_starts", j + 1), F.size("_codes")) - s).cast("double").alias("n")))
    t = t.select(key, runs.alias("_runs"))
    zero = F.lit(0.0)

    def state(place, a, b, aa, bb, ab):
        return F.struct(place.alias("place"), a.alias("a"), b.alias("b"), aa.alias("aa"), bb.alias("bb"), ab.alias("ab"))

    def step(acc, x):
        place = F.shiftright(x["code"], 2)
        same = place == acc["place"]
        n = F.when(x["code"].bitwiseAND(2) == 0, x["n"]).otherwise(-x["n"])
        other = x["code"].bitwiseAND(1) == 1
        kept = lambda c: F.when(same, acc[c]).otherwise(zero)
        ended = lambda c, d: F.when(same, zero).otherwise(acc[c] * acc[d])
        return state(place, kept("a") + F.when(other, zero).otherwise(n), kept("b") + F.when(other, n).otherwise(zero),
                     acc["aa"] + ended("a", "a"), acc["bb"] + ended("b", "b"), acc["ab"] + ended("a", "b"))

    t = t.select(key, F.aggregate("_runs", state(F.lit(-1), zero, zero, zero, zero, zero), step).alias("_s"))
    s = F.col("_s")
    t = t.select(key, (s["aa"] + s["a"] * s["a"]).alias("_aa"), (s["bb"] + s["b"] * s["b"]).alias("_bb"), (s["ab"] + s["a"] * s["b"]).alias("_ab"))
    return t.select(key, F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_ab") / (F.sqrt("_aa") * F.sqrt("_bb"))).alias("similarity"))


def _by_key(df: DataFrame, key: str, stored_text: str, other_text: str) -> DataFrame:
    """Components of a key meet on (key, i); the words of all its rows count together."""
    a, b = embed_text(df, key, stored_text), embed_text(df, key, other_text).withColumnRenamed("x", "y")
    dot = a.join(b, [key, "i"]).groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))
    both = a.select(key).distinct().join(b.select(key).distinct(), key)
    known = both.join(dot, key, "left").select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return df.select(key).join(known, key, "left")


# ---- T1 for many queries: blocked products, pruned by distances to pivots ----
PIVOTS = 8        # rows of a block that distances are taken to
SLAB = 512        # rows of a block that are skipped or scored together
SLACK = 1e-9      # above the rounding error of distances and products


def packed_vectors(components: DataFrame, key: str) -> DataFrame:
    """(key, indices, values): one row per vector (at most the dimension's length)."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    return (components.groupBy(key).agg(pairs.alias("_p"))
            .select(key, F.transform("_p", lambda p: p["i"]).alias("indices"), F.transform("_p", lambda p: p["x"]).alias("values")))


def rank_by_similarity(corpus: DataFrame, queries: DataFrame, key: str, qkey: str, k: int = 5, dim: int = EMBED_DIM,
                       rows: int = 8192, asks: int = 1024) -> DataFrame:
    """T1 for a set of queries: (qkey, key, similarity, rank), ties by key.

    ``corpus`` and ``queries`` hold (key, indices, values) unit vectors.  The
    corpus is dealt to blocks of about ``rows`` vectors and the queries to
    blocks of ``asks``; every pair of blocks is one task's matrix product that
    keeps k rows per query, so at most blocks x k rows per query are merged.
    """
    corpus, queries = stored(corpus, "vectors"), stored(queries, "query-vectors")
    n_blocks, n_asks = corpus.count() // rows + 1, queries.count() // asks + 1

    def dealt(df, own, block, other, copies, total):
        return (df.select(F.col(own).alias("id"), "indices", "values").withColumn(block, F.pmod(F.xxhash64("id"), F.lit(total)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))

    right = dealt(corpus, key, "b", "a", n_asks, n_blocks)
    left = dealt(queries, qkey, "a", "b", n_blocks, n_asks)
    kinds = dict(corpus.dtypes)[key], dict(queries.dtypes)[qkey]
    found = (left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
             .applyInArrow(_block_top(k, dim), f"q {kinds[1]}, d {kinds[0]}, similarity double"))
    # Rank on the rounded similarity so that the order of a sum's terms cannot reorder true ties.
    w = Window.partitionBy("q").orderBy(F.round("similarity", 9).desc(), F.col("d").asc())
    return (found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
            .select(F.col("q").alias(qkey), F.col("d").alias(key), "similarity", "rank"))


def _dense(table, dim: int):
    import numpy as np
    out = np.zeros((table.num_rows, dim))
    lists = table["indices"].combine_chunks()
    at = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
    out[at, lists.flatten().to_numpy()] = table["values"].combine_chunks().flatten().to_numpy()
    return out


class PivotBlock:
    """A block of unit vectors in order of distance to its pivots; ``scored`` counts the rows that products were taken of."""

    def __init__(self, x):
        import numpy as np
        pivots = x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)] if len(x) else x
        near = np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))
        self.order = np.lexsort((near.min(axis=1), near.argmin(axis=1))) if len(x) else np.zeros(0, int)
        self.x, self.pivots, self.scored = x[self.order], pivots, 0
        starts = np.arange(0, len(x), SLAB)
        self.low = np.minimum.reduceat(near[self.order], starts, axis=0) if len(x) else near
        self.high = np.maximum.reduceat(near[self.order], starts, axis=0) if len(x) else near
        self.starts = starts

    def top(self, q, k: int):
        """Per query the places of rows that can be among its best k, and their products."""
        import numpy as np
        far = np.sqrt(np.maximum(2 - 2 * (q @ self.pivots.T), 0))
        # |d(x, p) - d(q, p)| <= d(x, q): the least distance any row of a slab can have to a query
        gap = np.maximum(np.maximum(self.low[None] - far[:, None], far[:, None] - self.high[None]), 0).max(axis=2)
        bound = 1 - gap * gap / 2 + SLACK
        least = np.full(len(q), -np.inf)
        held = [(np.zeros(0, int), np.zeros(0)) for _ in q]
        for s in np.argsort(-bound.max(axis=0), kind="stable"):
            asks = np.flatnonzero(bound[:, s] >= least - SLACK)
            if not len(asks):
                continue
            at = self.starts[s]
            block = self.x[at:at + SLAB]
            self.scored += len(asks) * len(block)
            product = q[asks] @ block.T
            for i, scores in zip(asks, product):
                keep = np.flatnonzero(scores >= least[i] - SLACK)
                if len(keep):
                    places, all_scores = np.concatenate([held[i][0], self.order[at + keep]]), np.concatenate([held[i][1], scores[keep]])
                    if len(all_scores) > k:
                        least[i] = np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]
                        good = all_scores >= least[i] - SLACK       # ties stay until ranks are rounded
                        places, all_scores = places[good], all_scores[good]
                    held[i] = places, all_scores
        return held


def _block_top(k: int, dim: int):
    def solve(asks, rows):
        import numpy as np
        import pyarrow as pa
        block, out = PivotBlock(_dense(rows, dim)), []
        ids = rows["id"].combine_chunks()
        if asks.num_rows and rows.num_rows:
            for i, (at, scores) in enumerate(block.top(_dense(asks, dim), k)):
                # rank as the merge does: rounded score, then id
                ranked = pa.table({"q": pa.array([asks["id"][i].as_py()] * len(at), asks["id"].type), "d": ids.take(pa.array(at)),
                                   "similarity": pa.array(scores), "r": pa.array(-np.round(scores, 9))})
                out.append(ranked.sort_by([("r", "ascending"), ("d", "ascending")]).slice(0, k).select(["q", "d", "similarity"]))
        empty = pa.table({"q": asks["id"].slice(0, 0), "d": rows["id"].slice(0, 0), "similarity": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *out]).combine_chunks()
    return solve
