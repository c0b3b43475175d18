"""Scalar column operators (N1-N23, N31, N35) applied to every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import courses as C
from ..functions import rules as RULES
from ..functions import skills as S
from ..functions import text as T
from . import fixtures as X
from .fixture_sql import COURSES, RAW_PROVIDERS, clean_ws, q, with_catalog, with_courses
from .registry import catalog, register

LANG_NAME_SQL = "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END"


def _courses(spark, sf_dir):
    return X.courses(spark, sf_dir)


@register("clean_whitespace", with_courses() + f"\nSELECT id, {clean_ws('description')} AS description FROM courses")
def clean_whitespace(spark, sf_dir):
    """newline/CR/tab -> space, trimmed, over every course description."""
    return _courses(spark, sf_dir).select("id", T.clean_whitespace("description").alias("description"))


@register("blank_to_null", with_courses() + """
SELECT id, nullif(trim(prerequisites), '') AS prerequisites, nullif(trim(level_raw), '') AS level FROM courses""")
def blank_to_null(spark, sf_dir):
    """NULLIF(TRIM(x), '')."""
    return _courses(spark, sf_dir).select("id", T.blank_to_null("prerequisites").alias("prerequisites"),
                                          T.blank_to_null("level_raw").alias("level"))


@register("prereq_clean", "WITH " + COURSES + "," + RAW_PROVIDERS + f"""
SELECT doc_id, prerequisites AS raw,
       nullif(trim(CASE WHEN {RULES.has_prerequisites_sql('prerequisites', 'edx')} THEN prerequisites END), '') AS prerequisites
FROM edx_raw""")
def prereq_clean(spark, sf_dir):
    """NOT FOUND / NONE / empty after dropping dots -> NULL (edX records)."""
    e = X.edx_raw(_courses(spark, sf_dir))
    return e.select("doc_id", F.col("prerequisites").alias("raw"), T.prereq_clean("prerequisites").alias("prerequisites"))


@register("has_prereq", "WITH " + COURSES + "," + RAW_PROVIDERS + f"""
SELECT c.id, {RULES.has_prerequisites_sql('c.prerequisites', 'udemy')} AS udemy, {RULES.has_prerequisites_sql('c.prerequisites', 'udacity')} AS udacity,
       {RULES.has_prerequisites_sql('e.prerequisites', 'edx')} AS edx
FROM courses c LEFT JOIN edx_raw e ON e.doc_id = c.id""")
def has_prereq(spark, sf_dir):
    """The three provider rules for HAS_PREREQUISITES side by side."""
    c = _courses(spark, sf_dir)
    e = X.edx_raw(c).select("doc_id", F.col("prerequisites").alias("edx_pre"))
    j = c.join(e, F.col("doc_id") == F.col("id"), "left")
    return j.select("id", C.has_prereq("prerequisites", "udemy").alias("udemy"),
                    C.has_prereq("prerequisites", "udacity").alias("udacity"),
                    F.when(F.col("doc_id").isNull(), F.lit(False)).otherwise(C.has_prereq("edx_pre", "edx")).alias("edx"))


@register("strip_not_found", "WITH " + COURSES + "," + RAW_PROVIDERS + """
SELECT doc_id, nullif(replace(associated_skills, 'Not found', ''), '') AS skills,
       nullif(replace(grow_these_skills, 'Not found', ''), '') AS grow_these_skills FROM edx_raw""")
def strip_not_found(spark, sf_dir):
    """Literal ``Not found`` -> empty -> NULL."""
    e = X.edx_raw(_courses(spark, sf_dir))
    return e.select("doc_id", T.strip_not_found("associated_skills").alias("skills"),
                    T.strip_not_found("grow_these_skills").alias("grow_these_skills"))


@register("language_flag", with_courses() + f"""
SELECT id, {RULES.language_sql('lang', 'edx')} AS edx, {RULES.language_sql('lang', 'udacity')} AS udacity, {RULES.language_sql('name', 'udemy')} AS udemy
FROM (SELECT id, lang, {LANG_NAME_SQL} AS name FROM courses)""")
def language_flag(spark, sf_dir):
    """ENGLISH / OTHERS under the three provider rules."""
    c = _courses(spark, sf_dir)
    name = X._lang_name(F.col("lang"))
    return c.select("id", C.language_flag("lang", "edx").alias("edx"), C.language_flag("lang", "udacity").alias("udacity"),
                    C.language_flag(name, "udemy").alias("udemy"))


@register("duration_udemy", with_courses() + f"""
SELECT id, {RULES.duration_sql('content_info', 'udemy')} AS duration, round({RULES.hours_sql('content_info', 'udemy')}, 6) AS duration_hours
FROM courses""")
def duration_udemy(spark, sf_dir):
    """``<number> <unit>`` and hours from Udemy content info."""
    c = _courses(spark, sf_dir)
    return c.select("id", C.duration("content_info", "udemy").alias("duration"),
                    F.round(C.duration_hours("content_info", "udemy"), 6).alias("duration_hours"))


@register("duration_udacity", with_courses() + f"""
SELECT id, iso_duration, {RULES.duration_sql('iso_duration', 'udacity')} AS duration, {RULES.hours_sql('iso_duration', 'udacity')} AS duration_hours
FROM courses""")
def duration_udacity(spark, sf_dir):
    """ISO-like durations, ordered rules (``PT30M`` counts as months)."""
    c = _courses(spark, sf_dir)
    return c.select("id", "iso_duration", C.duration("iso_duration", "udacity").alias("duration"),
                    C.duration_hours("iso_duration", "udacity").alias("duration_hours"))


@register("duration_edx", "WITH " + COURSES + "," + RAW_PROVIDERS + f"""
SELECT doc_id, trim(duration) AS duration, {RULES.hours_sql('duration', 'edx')} AS duration_hours FROM edx_raw""")
def duration_edx(spark, sf_dir):
    """Weeks x 168 when the text mentions a week."""
    e = X.edx_raw(_courses(spark, sf_dir))
    return e.select("doc_id", F.trim("duration").alias("duration"), C.duration_hours("duration", "edx").alias("duration_hours"))


@register("rating_sentinel", with_courses() + """
SELECT id, rating_raw, coalesce(TRY_CAST(rating_raw AS DOUBLE), -1.0) AS rating FROM courses""")
def rating_sentinel(spark, sf_dir):
    """Unparsable rating -> -1."""
    return _courses(spark, sf_dir).select("id", "rating_raw", C.rating_sentinel("rating_raw").alias("rating"))


@register("level_normalize", "WITH " + COURSES + "," + RAW_PROVIDERS + f"""
SELECT c.id, {RULES.level_sql('c.level_raw', 'udemy')} AS udemy, {RULES.level_sql('u.lvl', 'udacity')} AS udacity, {RULES.level_sql('e.level', 'edx')} AS edx
FROM courses c LEFT JOIN udacity_raw u ON u.doc_id = c.id LEFT JOIN edx_raw e ON e.doc_id = c.id""")
def level_normalize(spark, sf_dir):
    """Provider level label -> catalogue label, three rule sets."""
    c = _courses(spark, sf_dir)
    u = X.udacity_raw(c).select(F.col("doc_id").alias("u_id"), F.col("Level").alias("u_level"))
    e = X.edx_raw(c).select(F.col("doc_id").alias("e_id"), F.col("level").alias("e_level"))
    j = c.join(u, F.col("u_id") == F.col("id"), "left").join(e, F.col("e_id") == F.col("id"), "left")
    return j.select("id", C.level_normalize("level_raw", "udemy").alias("udemy"),
                    C.level_normalize("u_level", "udacity").alias("udacity"),
                    C.level_normalize("e_level", "edx").alias("edx"))


@register("level_category", with_catalog() + f"\nSELECT id, level, {RULES.bucket_sql('level')} AS level_category FROM catalog")
def level_category(spark, sf_dir):
    """Catalogue label -> bucket used by the recommender."""
    return catalog(spark, sf_dir).select("id", "level", C.level_category("level").alias("level_category"))


@register("level_category_transition", with_courses() + f"""
SELECT id, level, {RULES.transition_bucket_sql('level')} AS level_category FROM (SELECT id, level_raw AS level FROM courses)""")
def level_category_transition(spark, sf_dir):
    """Second bucket rule set (unknown and NULL -> ADVANCED)."""
    c = _courses(spark, sf_dir)
    return c.select("id", F.col("level_raw").alias("level"), C.level_category_transition("level_raw").alias("level_category"))


@register("combine_skills", with_courses() + """
SELECT id, trim(coalesce(skills, '') || CASE WHEN skills IS NOT NULL AND nullif(prerequisites, '') IS NOT NULL THEN ', ' ELSE '' END
            || coalesce(nullif(prerequisites, ''), '')) AS combined_skills FROM courses""")
def combine_skills(spark, sf_dir):
    """Join two nullable skill strings with ``", "`` only when both exist."""
    c = _courses(spark, sf_dir)
    return c.select("id", C.combine_skills("skills", F.nullif("prerequisites", F.lit(""))).alias("combined_skills"))


JOB_POSTINGS_SQL = """
job_postings AS (
  SELECT l_suppkey AS id, s_name AS company_reported,
         array_sort(array_agg(DISTINCT p_brand)) AS hard_skill_labels,
         CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE array_sort(array_agg(DISTINCT p_type)) END AS soft_skill_labels
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY l_suppkey, s_name
)"""


@register("array_skills", "WITH " + JOB_POSTINGS_SQL + """
SELECT id, company_reported, array_to_string(list_concat(coalesce(hard_skill_labels, []), coalesce(soft_skill_labels, [])), ', ') AS skills
FROM job_postings WHERE company_reported IS NOT NULL""")
def array_skills(spark, sf_dir):
    """N15 (+P2): hard and soft label arrays joined NULL-safely; postings without company dropped."""
    jp = X.job_postings(spark, sf_dir).filter(F.col("company_reported").isNotNull())
    return jp.select("id", "company_reported", C.array_skills("hard_skill_labels", "soft_skill_labels").alias("skills"))


@register("list_string_clean", with_courses() + """
SELECT id, translate('[''' || replace(skills, ', ', ''', ''') || ''']', '[]''', '') AS skills FROM courses""")
def list_string_clean(spark, sf_dir):
    """A Python-list-looking string stripped of brackets and quotes."""
    c = _courses(spark, sf_dir)
    listy = F.concat(F.lit("['"), F.replace("skills", F.lit(", "), F.lit("', '")), F.lit("']"))
    return c.select("id", T.list_string_clean(listy).alias("skills"))


@register("split_rejoin", with_courses() + """
SELECT id, array_to_string(string_split(trim(skills), ','), ', ') AS skills,
       array_to_string(string_split(trim(course_name), ' '), ', ') AS name_parts FROM courses""")
def split_rejoin(spark, sf_dir):
    """Split on a delimiter, re-join with ``", "`` (elements not trimmed)."""
    c = _courses(spark, sf_dir)
    return c.select("id", T.split_rejoin("skills", ",").alias("skills"), T.split_rejoin("course_name", " ").alias("name_parts"))


@register("url_prefix", with_courses() + """
SELECT id, CASE WHEN url_path LIKE '/%' THEN 'https://www.udemy.com' || url_path ELSE url_path END AS url_once,
       CASE WHEN url_path LIKE '/%' THEN 'https://www.udemy.com' || url_path ELSE url_path END AS url_twice FROM courses""")
def url_prefix(spark, sf_dir):
    """Host prefixed to relative paths only; applying it twice changes nothing."""
    c = _courses(spark, sf_dir)
    once = T.url_prefix("url_path", "https://www.udemy.com")
    return c.select("id", once.alias("url_once"), T.url_prefix(once, "https://www.udemy.com").alias("url_twice"))


@register("url_strip_query", "SELECT page_id, url, regexp_replace(url, '\\?.*', '') AS url_clean FROM pages")
def url_strip_query(spark, sf_dir):
    """``?query`` suffix removed from every page URL."""
    p = X._t(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", "url", T.url_strip_query("url").alias("url_clean"))


def _skill_list_input():
    return F.concat_ws(", ", F.col("skills"), F.concat(F.lit("("), F.col("lang")), F.concat(F.col("level_raw"), F.lit(")")),
                       F.lit(" "))


SKILL_LIST_INPUT_SQL = "concat_ws(', ', skills, '(' || lang, level_raw || ')', ' ')"


@register("skill_list_parse", with_courses() + f"""
, parts AS (
  SELECT id, list_filter(list_transform(string_split({SKILL_LIST_INPUT_SQL}, ','), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))),
                         lambda s: s <> '') AS arr FROM courses
), fixed AS (
  SELECT id, list_transform(arr, lambda s:
      CASE WHEN (CASE WHEN s LIKE '%(%' AND s NOT LIKE '%)%' THEN replace(s, '(', '') ELSE s END) LIKE '%)%'
            AND (CASE WHEN s LIKE '%(%' AND s NOT LIKE '%)%' THEN replace(s, '(', '') ELSE s END) NOT LIKE '%(%'
           THEN replace((CASE WHEN s LIKE '%(%' AND s NOT LIKE '%)%' THEN replace(s, '(', '') ELSE s END), ')', '')
           ELSE (CASE WHEN s LIKE '%(%' AND s NOT LIKE '%)%' THEN replace(s, '(', '') ELSE s END) END) AS arr FROM parts
)
SELECT id, to_json(arr[1:5]) AS skills FROM fixed""")
def skill_list_parse(spark, sf_dir):
    """Comma list -> cleaned skills, unbalanced parenthesis dropped, first 5."""
    c = _courses(spark, sf_dir)
    return c.select("id", F.to_json(S.skill_list_parse(_skill_list_input(), 5)).alias("skills"))


@register("skill_token_sanitize", with_courses() + """
, toks AS (SELECT id, string_split(course_name || ' ''ab'' "q;" ;x; ' || coalesce(prerequisites, ''), ' ') AS arr FROM courses)
SELECT id, to_json(list_filter(list_transform(list_filter(arr, lambda s: s IS NOT NULL AND length(s) > 0),
       lambda s: trim(translate(s, '''";', ''), ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) > 2)[1:3]) AS skills
FROM toks""")
def skill_token_sanitize(spark, sf_dir):
    """quote/semicolon removal, length > 2, first three."""
    c = _courses(spark, sf_dir)
    arr = F.split(F.concat(F.col("course_name"), F.lit(" 'ab' \"q;\" ;x; "), F.coalesce("prerequisites", F.lit(""))), " ")
    return c.select("id", F.to_json(S.skill_token_sanitize(arr, 3)).alias("skills"))


def _stop_sql(x: str) -> str:
    return " OR ".join(f"contains(lower({x}), {q(w)})" for w in S.SKILL_STOPLIST)


@register("skill_stoplist", f"""
WITH parts AS (
  SELECT doc_id, list_filter(list_transform(list_filter(string_split(replace(text, '.', ','), ','), lambda s: s IS NOT NULL AND s <> ''),
                 lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '' AND NOT ({_stop_sql('s')})) AS kept
  FROM documents
)
SELECT doc_id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ', ') ELSE 'Not found' END AS skills FROM parts""")
def skill_stoplist(spark, sf_dir):
    """Every sentence of every document treated as a scraped label; stop substrings dropped."""
    d = X._t(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", S.skill_stoplist_text(F.replace("text", F.lit("."), F.lit(","))).alias("skills"))


def _pii_sql(x: str) -> str:
    out = x
    for p in T.PII_PATTERNS:
        out = f"regexp_replace({out}, {q(p)}, '', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@register("pii_scrub", f"SELECT doc_id, md5({_pii_sql('text')}) AS scrubbed_md5, length({_pii_sql('text')}) AS scrubbed_len FROM documents")
def pii_scrub(spark, sf_dir):
    """E-mail, phone, address, non-whitelisted characters removed; whitespace collapsed."""
    d = X._t(spark, sf_dir, "documents", "doc_id", "text").withColumn("s", T.pii_scrub("text"))
    return d.select("doc_id", F.md5("s").alias("scrubbed_md5"), F.length("s").cast("long").alias("scrubbed_len"))


@register("title_case_source", """
SELECT event_id,
  array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '),
                  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS source_page,
  replace(substr(CAST(ts AS VARCHAR), 1, 19), 'T', ' ') AS ts_display
FROM events""")
def title_case_source(spark, sf_dir):
    """``event_type`` as a title-cased page name and a 19-character timestamp."""
    e = X._t(spark, sf_dir, "events", "event_id", "event_type", "ts")
    return e.select("event_id", T.title_case_source("event_type").alias("source_page"),
                    T.timestamp_display(F.col("ts").cast("string")).alias("ts_display"))


# The columns of the two embedding texts, in order; instructors and price have no source column.
DOC_COLS = ("url", "course_name", "'Not found'", "rating", "level", "description", "duration", "skills", "platform",
            "ingestion_time", "id", "prerequisites", "'Not found'")
SHORT_DOC_COLS = ("course_name", "skills", "description")


def _doc_sql(cols) -> list[str]:
    return [f"CAST({c} AS VARCHAR)" for c in cols]


@register("nullable_concat_doc", with_catalog() + f"""
SELECT id, md5({" || ' ' || ".join(_doc_sql(DOC_COLS))}) AS doc_strict, md5(concat_ws(' ', {", ".join(_doc_sql(DOC_COLS))})) AS doc_loose,
       md5({" || ' ' || ".join(_doc_sql(SHORT_DOC_COLS))}) AS doc_short
FROM catalog""")
def nullable_concat_doc(spark, sf_dir):
    """The embedding texts of every course (all 13 parts; title, skills and description); strict forms are NULL if any part is."""
    cat = catalog(spark, sf_dir)
    parts = [F.expr(c).cast("string") for c in DOC_COLS]
    short = [F.col(c) for c in SHORT_DOC_COLS]
    return cat.select("id", F.md5(T.nullable_concat_doc(parts, strict=True)).alias("doc_strict"),
                      F.md5(T.nullable_concat_doc(parts, strict=False)).alias("doc_loose"),
                      F.md5(T.nullable_concat_doc(short, strict=True)).alias("doc_short"))
