"""Predicates, aggregates, windows, joins, keyed state and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import courses as C
from ..functions import skills as S
from ..functions.rules import bucket_sql
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import state as M
from ..operators import windows as W
from ..operators.enrich import infer_level, with_course_text
from . import fixtures as X
from .fixture_sql import USER_ROLES, infer_level_sql, with_catalog, with_courses
from .q_scalar import JOB_POSTINGS_SQL, SKILL_LIST_INPUT_SQL, _skill_list_input
from .registry import catalog, register

# The reference's five hand-cut enrichment id ranges (inclusive).
ID_RANGES = ((2762, 1000000), (1000001, 2000000), (2000001, 3000000), (3000001, 4000000), (4000001, 4582612))


def _range_case_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN {i}" for i, (lo, hi) in enumerate(ID_RANGES)) + " END"


@register("range_between", with_courses() + f""", spread AS (SELECT id, id * {ID_RANGES[-1][1]} // (SELECT max(id) + 1 FROM courses) AS cid FROM courses)
SELECT {_range_case_sql('cid')} AS range_no, count(*) AS n, min(id) AS first_id, max(id) AS last_id
FROM spread GROUP BY 1""")
def range_between(spark, sf_dir):
    """Rows per inclusive id range (ids spread evenly over the reference's id space)."""
    c = X.courses(spark, sf_dir).select("id")
    c = c.withColumn("_m", c.agg(F.max("id") + 1).scalar()).selectExpr("id", f"(id * {ID_RANGES[-1][1]}) div _m AS cid")
    rng = None
    for i, (lo, hi) in enumerate(ID_RANGES):
        cond = F.col("cid").between(lo, hi)
        rng = F.when(cond, F.lit(i)) if rng is None else rng.when(cond, F.lit(i))
    return c.groupBy(rng.alias("range_no")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
                                                F.max("id").alias("last_id"))


@register("range_half_open", with_courses() + """
SELECT id, course_name FROM courses WHERE id >= 0 AND id < (SELECT (max(id) + 1) // 2 FROM courses)""")
def range_half_open(spark, sf_dir, lo: int = 0, hi: int | None = None):
    """P5: parameterised ``lo <= id < hi`` batch; by default the lower half of the ids there are."""
    c = X.courses(spark, sf_dir)
    top = c.agg(F.expr("(max(id) + 1) div 2")).scalar() if hi is None else F.lit(hi)
    return c.filter((F.col("id") >= lo) & (F.col("id") < top)).select("id", "course_name")


@register("point_lookup", """
SELECT o.o_orderkey AS path_id, o.o_custkey AS user_id, o.o_orderpriority AS target_role
FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def point_lookup(spark, sf_dir):
    """P6 (batch form): learning paths of the users in a key list, as a semi join."""
    keys = X._t(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").filter(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("user_id"))
    lp = X.learning_paths(spark, sf_dir)
    return lp.join(keys, "user_id", "left_semi").select("path_id", "user_id", "target_role")


@register("keyword_search", with_courses() + """
SELECT id, course_name FROM courses
WHERE lower(course_name) LIKE '%blue%' OR lower(skills) LIKE '%blue%' OR lower(description) LIKE '%blue%'
ORDER BY id LIMIT 10""")
def keyword_search(spark, sf_dir, keyword: str = "blue", k: int = 10):
    """Case-insensitive substring over several columns, OR-ed, first 10 by id."""
    c = X.courses(spark, sf_dir)
    kw = keyword.lower()
    cond = F.lower("course_name").contains(kw) | F.lower("skills").contains(kw) | F.lower("description").contains(kw)
    return c.filter(cond).select("id", "course_name").orderBy("id").limit(k)


@register("language_filter", with_courses() + """
SELECT id, lang FROM (
  SELECT id, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name
  FROM courses) WHERE NOT (trim(name) ILIKE 'English')""")
def language_filter(spark, sf_dir):
    """Rows whose detected language is not English (trimmed, any case)."""
    c = X.courses(spark, sf_dir).withColumn("name", X._lang_name(F.col("lang")))
    return c.filter(~F.trim("name").ilike("English")).select("id", "lang")


@register("valid_result_filter", with_catalog() + """
SELECT id, course_name, url FROM catalog
WHERE course_name IS NOT NULL AND url IS NOT NULL AND lower(coalesce(skills, '')) <> 'none'""")
def valid_result_filter(spark, sf_dir):
    """Drop results with NULL name or URL, or the string ``none`` as skills."""
    cat = catalog(spark, sf_dir)
    return cat.filter(F.col("course_name").isNotNull() & F.col("url").isNotNull()
                      & (F.lower(F.coalesce("skills", F.lit(""))) != "none")).select("id", "course_name", "url")


@register("literal_columns", with_catalog() + """
SELECT id, platform, 'Free' AS price, 'catalog' AS provider FROM catalog""")
def literal_columns(spark, sf_dir):
    """P10: constant columns added to every row."""
    return catalog(spark, sf_dir).select("id", "platform", F.lit("Free").alias("price"), F.lit("catalog").alias("provider"))


@register("schema_evolve", with_catalog() + """
SELECT id, course_name AS title, NULL::DOUBLE AS embedding_norm, platform FROM catalog""")
def schema_evolve(spark, sf_dir):
    """Add-if-absent, drop-if-exists, rename; the evolved table."""
    df = catalog(spark, sf_dir).select("id", "course_name", "platform", "url")
    if "embedding_norm" not in df.columns:
        df = df.withColumn("embedding_norm", F.lit(None).cast("double"))
    if "url" in df.columns:
        df = df.drop("url")
    return df.withColumnRenamed("course_name", "title")


@register("conditional_update", with_courses() + """
SELECT id, CASE WHEN url_path LIKE '/%' THEN 'https://www.udemy.com' || url_path ELSE url_path END AS url,
       CASE WHEN rating_raw = 'Not found' THEN NULL ELSE rating_raw END AS rating FROM courses""")
def conditional_update(spark, sf_dir):
    """Rewrite a column where a predicate holds; other rows unchanged."""
    c = X.courses(spark, sf_dir)
    return c.select("id", F.when(F.col("url_path").startswith("/"), F.concat(F.lit("https://www.udemy.com"), "url_path"))
                    .otherwise(F.col("url_path")).alias("url"),
                    F.when(F.col("rating_raw") == "Not found", F.lit(None).cast("string")).otherwise(F.col("rating_raw")).alias("rating"))


@register("fill_if_missing", with_catalog() + """
SELECT id, prerequisites, skills, level FROM enr_udacity
UNION ALL SELECT id, prerequisites, skills, level FROM enr_edx""")
def fill_if_missing(spark, sf_dir):
    """P13 + P14: the enriched Udacity and edX models (fill rules differ per provider)."""
    from ..operators import catalog as CAT
    c = X.courses(spark, sf_dir)
    u = CAT.enrich_udacity(CAT.stage_udacity(X.udacity_raw(c), X.INGESTION_TIME))
    e = CAT.enrich_edx(CAT.stage_edx(X.edx_raw(c), X.INGESTION_TIME))
    cols = ["id", "prerequisites", "skills", "level"]
    return u.select(*cols).unionByName(e.select(*cols))


# ---- aggregates --------------------------------------------------------

@register("count_checked", with_catalog() + """
SELECT count(*) AS n FROM catalog WHERE url IS NOT NULL AND has_prerequisites""")
def count_checked(spark, sf_dir):
    """A1: COUNT(*) under a not-null predicate."""
    return catalog(spark, sf_dir).filter(F.col("url").isNotNull() & F.col("has_prerequisites")).agg(F.count(F.lit(1)).alias("n"))


@register("level_counts", with_catalog() + f"""
SELECT platform, {bucket_sql('level')} AS level_category, count(*) AS n FROM catalog GROUP BY 1, 2""")
def level_counts(spark, sf_dir):
    """A3: courses per level bucket and provider."""
    cat = catalog(spark, sf_dir)
    return cat.groupBy("platform", C.level_category("level").alias("level_category")).agg(F.count(F.lit(1)).alias("n"))


RATINGS_SQL = """
ratings AS (
  SELECT user_id, 'skill_' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS skill,
         CAST(1 + event_id % 5 AS INTEGER) AS rating, ts, event_id
  FROM events WHERE event_type = 'view'
), latest AS (
  SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY user_id, skill ORDER BY ts DESC, event_id DESC) = 1
)"""


def latest_ratings(spark, sf_dir):
    """(user, skill) -> latest rating (max_by over (ts, event_id); partial aggregation)."""
    r = X.ratings(spark, sf_dir)
    return W.latest_per_key(r, ["user_id", "skill"], "ts", "event_id")


@register("high_rating_ratio", "WITH " + RATINGS_SQL + """
SELECT user_id, count(*) FILTER (WHERE rating >= 3) AS high_rated, count(*) AS total_skills FROM latest GROUP BY user_id""")
def high_rating_ratio(spark, sf_dir):
    """A4: skills rated >= 3 over all rated skills, per user."""
    lr = latest_ratings(spark, sf_dir)
    return lr.groupBy("user_id").agg(F.count_if(F.col("rating") >= 3).alias("high_rated"), F.count(F.lit(1)).alias("total_skills"))


@register("rows_to_objects", """
SELECT l_orderkey, to_json(list({'line': l_linenumber, 'part': l_partkey, 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag)) AS lines
FROM lineitem GROUP BY l_orderkey""")
def rows_to_objects(spark, sf_dir):
    """Rows collapsed to an array of objects per key (an order's lines: a bounded group)."""
    li = X._t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    obj = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    agg = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(obj)).alias("lines"))
    return agg.select("l_orderkey", F.to_json("lines").alias("lines"))


# ---- windows / top-k -------------------------------------------------------

@register("sequential_ids", with_catalog() + """
SELECT id, course_name, 'U' || CAST(row_number() OVER (ORDER BY course_name, id) AS VARCHAR) AS seq_id FROM catalog""")
def sequential_ids(spark, sf_dir):
    """``'U' || ROW_NUMBER() OVER (ORDER BY title)`` via range partitions + offsets (no single-task window)."""
    cat = catalog(spark, sf_dir).select("id", "course_name")
    return W.sequential_ids(cat, ["course_name", "id"], "U", "seq_id")


@register("latest_per_key", "WITH " + USER_ROLES + """
, lp AS (SELECT o_custkey AS user_id, o_orderpriority AS target_role, o_orderdate, o_orderkey FROM orders
         QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT u.user_id, coalesce(lp.target_role, 'data engineer') AS target_role FROM user_roles u LEFT JOIN lp ON lp.user_id = u.user_id""")
def latest_per_key(spark, sf_dir):
    """Latest learning-path role per user (ties by path id), default ``data engineer``."""
    lp = X.learning_paths(spark, sf_dir)
    latest = W.latest_per_key(lp, ["user_id"], "created_at", "path_id").select("user_id", "target_role")
    users = X.user_roles(spark, sf_dir).select("user_id")
    return J.attach_default(users, latest, "user_id", "target_role", "data engineer")


@register("recent_n", """
SELECT user_id, ts, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""")
def recent_n(spark, sf_dir, n: int = 5):
    """Last N sessions per user by timestamp (N clamped to 1..20)."""
    s = X._t(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return W.recent_n(s, "user_id", "ts", n, tie_col="event_id").select("user_id", "ts", "event_type")


@register("first_k_of_list", "WITH " + JOB_POSTINGS_SQL + """
SELECT id, to_json(hard_skill_labels[1:3]) AS top3, to_json(hard_skill_labels[1:5]) AS top5,
       to_json(soft_skill_labels[1:8]) AS top8 FROM job_postings""")
def first_k_of_list(spark, sf_dir):
    """T4: first k items of a list (3, 5, 8)."""
    jp = X.job_postings(spark, sf_dir)
    return jp.select("id", F.to_json(W.first_k_of_list("hard_skill_labels", 3)).alias("top3"),
                     F.to_json(W.first_k_of_list("hard_skill_labels", 5)).alias("top5"),
                     F.to_json(W.first_k_of_list("soft_skill_labels", 8)).alias("top8"))


# ---- joins -----------------------------------------------------------------

@register("merge_update", with_catalog() + """
, src AS (SELECT course_name, min('U' || CAST(rn AS VARCHAR)) AS code FROM
          (SELECT course_name, row_number() OVER (ORDER BY course_name, id) AS rn FROM catalog) GROUP BY course_name)
SELECT c.id, c.course_name, coalesce(s.code, c.platform) AS course_code FROM catalog c LEFT JOIN src s ON s.course_name = c.course_name""")
def merge_update(spark, sf_dir):
    """MERGE on title: matched rows get the generated code; unmatched keep theirs."""
    cat = catalog(spark, sf_dir).select("id", "course_name", F.col("platform").alias("course_code"))
    src = W.sequential_ids(cat.select("id", "course_name"), ["course_name", "id"], "U", "code")
    return J.merge_update(cat, src, "course_name", "course_code", "code").select("id", "course_name", "course_code")


@register("incremental_new_only", with_courses() + """
, target AS (SELECT id, course_name FROM courses WHERE level_raw = 'All Levels')
SELECT id, course_name FROM target
UNION ALL SELECT id, course_name FROM courses WHERE id NOT IN (SELECT id FROM target)""")
def incremental_new_only(spark, sf_dir):
    """Incremental model run: only keys not yet in the target are appended."""
    c = X.courses(spark, sf_dir).select("id", "course_name", "level_raw")
    target = c.filter(F.col("level_raw") == "All Levels").select("id", "course_name")
    new = J.incremental_new_only(c.select("id", "course_name"), target, "id")
    return target.unionByName(new)


@register("insert_if_absent", """
WITH existing AS (SELECT c_name AS username FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE'))
SELECT c_custkey AS user_id, c_name AS username, c_name NOT IN (SELECT username FROM existing) AS accepted FROM customer""")
def insert_if_absent(spark, sf_dir):
    """A sign-up batch; users whose username exists are rejected, the rest inserted."""
    cust = X._t(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    existing = cust.filter(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).select(F.col("c_name").alias("username"))
    batch = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    fresh, dup = J.insert_if_absent(existing, batch, "username")
    return fresh.withColumn("accepted", F.lit(True)).unionByName(dup.withColumn("accepted", F.lit(False)))


@register("chained_models", with_catalog() + """
SELECT id, rating FROM catalog WHERE rating >= 3""")
def chained_models(spark, sf_dir):
    """A model selecting from another model's view, filtered."""
    return J.chained_models(catalog(spark, sf_dir), "catalog_model", F.col("rating") >= 3).select("id", "rating")


# ---- keyed state -------------------------------------------------------------

@register("upsert_by_key", with_courses() + f"""
, upd AS (SELECT id, {infer_level_sql('course_name', 'description')} AS level FROM courses WHERE trim(level_raw) = '')
SELECT id, level_raw AS level FROM courses WHERE id NOT IN (SELECT id FROM upd)
UNION ALL SELECT id, level FROM upd""")
def upsert_by_key(spark, sf_dir):
    """M1: inferred levels upserted by key into the course table."""
    c = X.courses(spark, sf_dir)
    target = c.select("id", F.col("level_raw").alias("level"))
    upd = with_course_text(c.filter(F.trim("level_raw") == ""), "course_name", "description") \
        .select("id", infer_level("_clow").alias("level"))
    return M.upsert_by_key(target, upd, "id")


@register("delete_by_key", """
SELECT user_id, ts, event_type FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND d.ts = e.ts)""")
def delete_by_key(spark, sf_dir):
    """M2: sessions deleted by (user, exact timestamp)."""
    s = X._t(spark, sf_dir, "events", "user_id", "ts", "event_type")
    deletes = s.filter(F.col("event_type") == "error").select("user_id", "ts")
    return M.delete_by_key(s, deletes, ["user_id", "ts"])


@register("update_by_key", """
SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 9000 THEN 'VIP' ELSE c_mktsegment END AS segment FROM customer""")
def update_by_key(spark, sf_dir):
    """M3: a column set for the keys in an update batch; other keys unchanged."""
    cust = X._t(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    df = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    upd = cust.filter(F.col("c_acctbal") > 9000).select(F.col("c_custkey").alias("user_id"), F.lit("VIP").alias("segment"))
    return M.update_by_key(df, upd, "user_id", "segment")


@register("append_session", """
SELECT user_id, ts, event_type FROM events""")
def append_session(spark, sf_dir):
    """M4: the session table after appending a batch of new sessions."""
    s = X._t(spark, sf_dir, "events", "user_id", "ts", "event_type")
    cut = s.agg(F.percentile_approx("ts", 0.5).alias("cut"))
    old = s.join(F.broadcast(cut), F.col("ts") < F.col("cut")).drop("cut")
    new = s.join(F.broadcast(cut), F.col("ts") >= F.col("cut")).drop("cut")
    return M.append_rows(old, new)


# ---- data quality ------------------------------------------------------------

@register("unique_check", with_catalog() + """
SELECT course_name, count(*) AS n FROM catalog WHERE course_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT 'customer:' || c_name, count(*) FROM customer GROUP BY c_name HAVING count(*) > 1
UNION ALL SELECT 'text:' || md5(text), count(*) FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1""")
def unique_check(spark, sf_dir):
    """Q1: duplicated course names, usernames and document texts."""
    a = Q.unique_check(catalog(spark, sf_dir), "course_name")
    cust = X._t(spark, sf_dir, "customer", "c_name")
    b = Q.unique_check(cust, "c_name").select(F.concat(F.lit("customer:"), "c_name").alias("course_name"), "n")
    texts = X._t(spark, sf_dir, "documents", "text").select(F.md5("text").alias("course_name"))
    d = Q.unique_check(texts, "course_name").select(F.concat(F.lit("text:"), "course_name").alias("course_name"), "n")
    return a.unionByName(b).unionByName(d)


@register("not_null_check", with_catalog() + """
SELECT count(*) FILTER (WHERE skills IS NULL) AS skills_nulls, count(*) FILTER (WHERE prerequisites IS NULL) AS prerequisites_nulls,
       count(*) FILTER (WHERE duration_hours IS NULL) AS duration_hours_nulls FROM catalog""")
def not_null_check(spark, sf_dir):
    """Q2: NULL counts per checked column."""
    return Q.not_null_check(catalog(spark, sf_dir), ["skills", "prerequisites", "duration_hours"])


@register("min_length_check", "SELECT conv_id, turn, length(text) AS n_chars FROM conversations WHERE text IS NULL OR length(text) < 50")
def min_length_check(spark, sf_dir):
    """Q3: texts shorter than 50 characters are rejected."""
    c = X._t(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return Q.min_length_check(c, "text", 50).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


@register("list_size_check", with_courses() + f"""
, parts AS (SELECT id, list_filter(list_transform(string_split({SKILL_LIST_INPUT_SQL}, ','), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))),
            lambda s: s <> '') AS arr FROM courses)
SELECT id, len(list_filter(arr[1:5], lambda s: s IS NOT NULL AND trim(s) <> '')) = 5 AS valid FROM parts""")
def list_size_check(spark, sf_dir):
    """Q4: a parsed skill list must hold exactly five skills."""
    c = X.courses(spark, sf_dir)
    return c.select("id", Q.list_size_check(S.skill_list_parse(_skill_list_input(), 5)).alias("valid"))


@register("skill_type_check", "WITH " + JOB_POSTINGS_SQL + """
SELECT id, to_json(list_filter(list_concat(hard_skill_labels, [NULL, ''], coalesce(soft_skill_labels, [])),
                   lambda s: s IS NOT NULL AND length(s) > 0)) AS skills FROM job_postings""")
def skill_type_check(spark, sf_dir):
    """Q5: NULL and empty entries dropped from skill lists."""
    jp = X.job_postings(spark, sf_dir)
    arr = F.concat("hard_skill_labels", F.array(F.lit(None).cast("string"), F.lit("")),
                   F.coalesce("soft_skill_labels", F.array().cast("array<string>")))
    return jp.select("id", F.to_json(Q.skill_type_check(arr)).alias("skills"))
