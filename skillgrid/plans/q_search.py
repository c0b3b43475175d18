"""Vector and text-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import pii_scrub, PII_PATTERNS
from ..operators import search as SR
from ..operators import vectors as V
from ..operators.windows import topk
from . import fixtures as X
from .fixture_sql import q, with_catalog
from .registry import catalog, register

COS_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label / 2.0 AS rating FROM embeddings),
qv AS (SELECT e AS qe FROM v WHERE vec_id = 0),
s AS (SELECT vec_id, rating, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS similarity
      FROM v, qv)"""


def _scored(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    qv = V.query_vector(v, "vec_id", 0, "embedding")
    return V.score_against(v, "embedding", qv)


@register("cosine_similarity", COS_SQL + "\nSELECT vec_id, round(similarity, 6) AS similarity FROM s")
def cosine_similarity(spark, sf_dir):
    """V2: cosine of every stored vector with the query vector (vec_id 0)."""
    return _scored(spark, sf_dir).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("query_cross", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
idx AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
c AS (SELECT list(m ORDER BY i) AS qe FROM (SELECT i, avg(x) AS m FROM idx GROUP BY i))
SELECT vec_id, round(list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))), 6) AS similarity
FROM v, c""")
def query_cross(spark, sf_dir):
    """Every vector scored against one query vector (the collection centroid, a scalar subquery)."""
    v = X.vectors(spark, sf_dir)
    dims = v.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    centroid = dims.groupBy("i").agg(F.avg("x").alias("m")) \
                   .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    qv = centroid.select("c").scalar()
    return V.score_against(v, "embedding", qv).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("topk_similarity", COS_SQL + """
SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity IS NOT NULL
ORDER BY round(similarity, 9) DESC, vec_id LIMIT 5""")
def topk_similarity(spark, sf_dir, k: int = 5):
    """Top 5 vectors by cosine with the query."""
    s = _scored(spark, sf_dir).withColumn("_r", F.round("similarity", 9))
    return topk(s, "_r", k, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


HYB = "(similarity * 0.7 + (CASE WHEN rating < 0 THEN 0.0 ELSE rating END / 5.0) * 0.3)"


@register("hybrid_score", COS_SQL + f"\nSELECT vec_id, round({HYB}, 6) AS hybrid_score FROM s")
def hybrid_score(spark, sf_dir):
    """V3: 0.7 * cosine + 0.3 * rating / 5 (rating = label / 2)."""
    s = _scored(spark, sf_dir)
    return s.select("vec_id", F.round(V.hybrid_score("similarity", "rating"), 6).alias("hybrid_score"))


@register("topk_hybrid", COS_SQL + f"""
SELECT vec_id, round({HYB}, 6) AS hybrid_score FROM s WHERE {HYB} IS NOT NULL ORDER BY round({HYB}, 9) DESC, vec_id LIMIT 5""")
def topk_hybrid(spark, sf_dir, k: int = 5):
    """Top 5 by hybrid score."""
    s = _scored(spark, sf_dir).withColumn("h", V.hybrid_score("similarity", "rating")).withColumn("_r", F.round("h", 9))
    return topk(s, "_r", k, "vec_id").select("vec_id", F.round("h", 6).alias("hybrid_score"))


@register("score_histogram", COS_SQL + "\nSELECT round(similarity, 2) + 0.0 AS score, count(*) AS n FROM s GROUP BY 1")
def score_histogram(spark, sf_dir):
    """A2: rows per similarity score (2 decimals), highest first."""
    return V.score_histogram(_scored(spark, sf_dir), "similarity", 2)


def _embed_sql(name: str, key: str, source: str, text: str) -> str:
    """CTE ``name(key, i, x)``: the hashed unit vectors of a text column."""
    return f"""
{name}_w AS (SELECT {key}, md5(unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+'), lambda t: t <> ''))) AS h FROM {source}),
{name}_c AS (SELECT {key}, CAST(CAST('0x' || h[1:8] AS BIGINT) % 768 AS INTEGER) AS i,
                    sum(CASE WHEN CAST('0x' || h[9:9] AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS c
             FROM {name}_w GROUP BY ALL HAVING c <> 0),
{name} AS (SELECT {key}, i, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM {name}_c)"""


@register("embed_text", "WITH " + _embed_sql("v", "doc_id", "documents", "text") + "\nSELECT doc_id, i, round(x, 9) AS x FROM v")
def embed_text(spark, sf_dir):
    """V1: every document embedded as a 768-component unit vector (feature hashing), all components that are not 0."""
    return V.embed_text(X._t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "i", F.round("x", 9).alias("x"))


@register("embedding_search", "WITH " + _embed_sql("v", "doc_id", "documents", "text") + "," + _embed_sql("u", "item_id", "benchmark", "text") + """,
s AS (SELECT item_id, doc_id, sum(v.x * u.x) AS similarity FROM u JOIN v USING (i) GROUP BY ALL),
every AS (SELECT item_id, doc_id, coalesce(similarity, 0.0) AS similarity
          FROM (SELECT DISTINCT item_id FROM u) CROSS JOIN (SELECT DISTINCT doc_id FROM v) LEFT JOIN s USING (item_id, doc_id))
SELECT item_id, rank, doc_id, round(similarity, 6) + 0.0 AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM every) WHERE rank <= 5""")
def embedding_search(spark, sf_dir, k: int = 5):
    """V1 -> V2 -> T1: documents and query texts embedded by one embedder, the five nearest documents of every query."""
    docs = V.packed_vectors(V.embed_text(X._t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")
    asks = V.packed_vectors(V.embed_text(X._t(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text"), "item_id")
    return V.rank_by_similarity(docs, asks, "doc_id", "item_id", k).select("item_id", "rank", "doc_id", (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"))


@register("row_text_similarity", with_catalog() + """,
t AS (SELECT id, course_name || ' ' || coalesce(skills, '') || ' ' || coalesce(description, '') AS stored,
             coalesce(skills, '') || ' ' || course_name || ' ' || coalesce(level, '') || ' ' || platform AS other FROM catalog),"""
          + _embed_sql("a", "id", "t", "stored") + "," + _embed_sql("b", "id", "t", "other") + """,
s AS (SELECT a.id, sum(a.x * b.x) AS similarity FROM a JOIN b USING (id, i) GROUP BY a.id)
SELECT t.id, round(CASE WHEN t.id IN (SELECT id FROM a) AND t.id IN (SELECT id FROM b) THEN coalesce(s.similarity, 0.0) END, 6) + 0.0 AS similarity
FROM t LEFT JOIN s ON s.id = t.id""")
def row_text_similarity(spark, sf_dir):
    """V2: each course's stored vector against the vector of another text of the same course."""
    none = lambda c: F.coalesce(c, F.lit(""))
    t = catalog(spark, sf_dir).select("id", F.concat_ws(" ", "course_name", none("skills"), none("description")).alias("stored"),
                                      F.concat_ws(" ", none("skills"), "course_name", none("level"), "platform").alias("other"))
    return V.same_row_similarity(t, "id", "stored", "other").select("id", (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"))


def _tfidf_sql(docs_where: str, query_text: str, n: int) -> str:
    tok = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}]+'), lambda t: t <> '')"
    return f"""
WITH docs AS (SELECT doc_id, {tok.format(x='text')} AS tok FROM documents WHERE {docs_where}),
nd AS (SELECT count(*) AS n FROM docs),
qt AS (SELECT DISTINCT item_id, unnest({tok.format(x=query_text)}) AS term FROM benchmark),
post AS (SELECT doc_id, len(tok) AS doc_len, unnest(tok) AS term FROM docs),
tf AS (SELECT term, doc_id, count(*) / any_value(doc_len) AS tf FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term, doc_id),
w AS (SELECT term, ln((SELECT n FROM nd) / count(*)) AS idf FROM tf GROUP BY term),
scored AS (SELECT item_id, doc_id, sum(tf * idf) AS score FROM tf JOIN w USING (term) JOIN qt USING (term)
           WHERE idf > 0 GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
WHERE rank <= {n}"""


def _search(spark, sf_dir, docs, qtext_col, n):
    bench = X._t(spark, sf_dir, "benchmark", "item_id", "text")
    if qtext_col is not None:
        bench = bench.withColumn("text", qtext_col)
    res = SR.search_topn(docs, "doc_id", "text", bench, "item_id", "text", n)
    return res.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@register("text_search_topn", _tfidf_sql("TRUE", "text", 10))
def text_search_topn(spark, sf_dir):
    """V4: TF-IDF search of every benchmark passage over the documents of all languages, top 10 each."""
    return _search(spark, sf_dir, X._t(spark, sf_dir, "documents", "doc_id", "text"), None, 10)


def _pii_sql(x: str) -> str:
    out = x
    for p in PII_PATTERNS:
        out = f"regexp_replace({out}, {q(p)}, '', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@register("resume_search", _tfidf_sql("source = 'src1'", _pii_sql("text"), 5))
def resume_search(spark, sf_dir, source: str = "src1"):
    """V5: scrubbed query text (N23), attribute filter pushed before scoring, top 5."""
    docs = X._t(spark, sf_dir, "documents", "doc_id", "text", "source").filter(F.col("source") == source)
    return _search(spark, sf_dir, docs.select("doc_id", "text"), pii_scrub(F.col("text")), 5)


@register("resume_index", """
SELECT lang, term, doc_id, count(*) AS cnt FROM (
  SELECT lang, doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda t: t <> '')) AS term FROM documents)
GROUP BY lang, term, doc_id""")
def resume_index(spark, sf_dir):
    """V6: the inverted index (term, doc, count) of every document, partitioned by language."""
    d = X._t(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return SR.build_index(d, "doc_id", "text", attrs=("lang",)).select("lang", "term", "doc_id", "cnt")
