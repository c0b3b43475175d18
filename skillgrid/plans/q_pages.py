"""Page-extraction queries over the stored ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import pages as P
from . import fixtures as X
from .fixture_sql import q
from .registry import register

LINKS_SQL = f"""
WITH hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, {q(P.HREF)}, 1)) AS href FROM pages),
links AS (
  SELECT DISTINCT page_id,
    regexp_replace(CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END, '\\?.*', '') AS link
  FROM hrefs)"""


def _pages(spark, sf_dir):
    return X._t(spark, sf_dir, "pages", "page_id", "url", "html")


@register("extract_links", LINKS_SQL + "\nSELECT page_id, link FROM links")
def extract_links(spark, sf_dir):
    """H1 (+N18, N19): every page's links made absolute, query stripped, distinct per page."""
    return P.extract_links(_pages(spark, sf_dir))


@register("dedup_links", LINKS_SQL + "\nSELECT DISTINCT link FROM links")
def dedup_links(spark, sf_dir):
    """The distinct set of links over all pages."""
    return P.extract_links(_pages(spark, sf_dir)).select("link").distinct()


@register("skip_processed", LINKS_SQL + """
SELECT DISTINCT link FROM links WHERE link NOT IN (SELECT l.link FROM links l JOIN pages p USING (page_id) WHERE p.url LIKE 'https:%')""")
def skip_processed(spark, sf_dir):
    """Links not yet in the processed set (stand-in for an earlier crawl: the links of the pages served by https)."""
    links = P.extract_links(_pages(spark, sf_dir)).select(F.col("link").alias("url")).distinct()
    processed = P.extract_links(_pages(spark, sf_dir).filter(F.col("url").like("https:%"))).select(F.col("link").alias("url"))
    return J.skip_processed(links, processed, "url").select(F.col("url").alias("link"))


@register("meta_url", f"SELECT page_id, coalesce(nullif(regexp_extract(html, {q(P.OG_URL)}, 1), ''), 'N/A') AS url FROM pages")
def meta_url(spark, sf_dir):
    """H2: ``og:url`` of every page, else ``N/A``."""
    return _pages(spark, sf_dir).select("page_id", P.meta_url("html").alias("url"))


def _listy_sql(path: str) -> str:
    return (f"CASE WHEN json_extract(c, '{path}') IS NULL THEN '' "
            f"WHEN json_type(c, '{path}') = 'ARRAY' THEN array_to_string(from_json(json_extract(c, '{path}'), '[\"VARCHAR\"]'), ', ') "
            f"ELSE coalesce(nullif(json_extract_string(c, '{path}'), ''), 'N/A') END")


JSONLD_SQL = f"""
WITH b AS (
  SELECT page_id, html, nullif(trim(regexp_extract(html, {q(P.JSONLD)}, 1)), '') AS body FROM pages
), v AS (
  SELECT page_id, html, CASE WHEN json_valid(body) THEN json(body) END AS v FROM b
), cc AS (
  SELECT page_id, html,
         CASE WHEN json_type(v) = 'OBJECT' AND json_type(v, '$."@graph"') = 'ARRAY' AND json_array_length(v, '$."@graph"') > 1
              THEN json_extract(v, '$."@graph"[1]') WHEN json_type(v) = 'OBJECT' THEN v END AS c
  FROM v
)
SELECT page_id, coalesce(nullif(regexp_extract(html, {q(P.OG_URL)}, 1), ''), 'N/A') AS url,
  CASE WHEN c IS NOT NULL THEN coalesce(json_extract_string(c, '$.name'), 'N/A') END AS course_name,
  CASE WHEN c IS NOT NULL THEN coalesce(json_extract_string(c, '$.description'), 'N/A') END AS description,
  CASE WHEN c IS NOT NULL THEN coalesce(json_extract_string(c, '$.educationalLevel'), 'N/A') END AS level,
  CASE WHEN c IS NOT NULL THEN {_listy_sql('$.coursePrerequisites')} END AS prerequisites,
  CASE WHEN c IS NOT NULL THEN CASE WHEN json_type(c, '$.hasCourseInstance') = 'ARRAY' AND json_array_length(c, '$.hasCourseInstance') > 0
       THEN coalesce(json_extract_string(c, '$.hasCourseInstance[0].courseWorkload'), 'N/A') ELSE 'N/A' END END AS duration,
  CASE WHEN c IS NOT NULL THEN coalesce(json_extract_string(c, '$.inLanguage'), 'N/A') END AS language,
  CASE WHEN c IS NOT NULL THEN {_listy_sql('$.about')} END AS skills,
  CASE WHEN c IS NOT NULL THEN coalesce(json_extract_string(c, '$.aggregateRating.ratingValue'), 'N/A') END AS rating
FROM cc"""


@register("jsonld_course", JSONLD_SQL)
def jsonld_course(spark, sf_dir):
    """H3: JSON-LD course record of every page (graph or object form)."""
    return P.jsonld_course(_pages(spark, sf_dir))


def _stoplist_sql(arr: str) -> str:
    from ..functions.skills import SKILL_STOPLIST
    stop = " OR ".join(f"contains(lower(s), {q(w)})" for w in SKILL_STOPLIST)
    kept = (f"list_filter(list_transform(list_filter({arr}, lambda s: s IS NOT NULL AND s <> ''), "
            f"lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '' AND NOT ({stop}))")
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ', ') ELSE 'Not found' END"


JSONLD_EDX_SQL = f"""
WITH b AS (
  SELECT page_id, html, nullif(trim(regexp_extract(html, {q(P.JSONLD)}, 1)), '') AS body FROM pages
), j AS (
  SELECT page_id, html, CASE WHEN json_valid(body) THEN json(body) END AS v FROM b
), f AS (
  SELECT page_id, html, v,
    CASE WHEN json_type(v, '$.provider') = 'ARRAY' AND json_array_length(v, '$.provider') > 0
         THEN coalesce(json_extract_string(list_filter(json_extract(v, '$.provider[*]'),
                  lambda p: json_extract_string(p, '$."@type"') = 'CollegeOrUniversity')[1], '$.name'), 'Not found')
         ELSE coalesce(json_extract_string(v, '$.provider.name'), 'Not found') END AS institution,
    CASE WHEN coalesce(json_extract_string(v, '$.educationalLevel'), '') <> ''
         THEN upper(json_extract_string(v, '$.educationalLevel')[1]) || lower(json_extract_string(v, '$.educationalLevel')[2:])
         ELSE 'Not found' END AS level,
    json_extract_string(v, '$.timeRequired') AS tr,
    json_type(v, '$.timeRequired') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'BOOLEAN') AS tr_ok,
    list_filter(list_transform(json_extract(v, '$.hasCourseInstance[*]'),
                lambda i: json_extract_string(i, '$.courseSchedule.repeatCount')),
                lambda r: regexp_matches(r, '^[0-9]+$')) AS repeat,
    json_type(v, '$.about') = 'ARRAY' AS about_is_list,
    list_filter(list_transform(json_extract(v, '$.about[*]'), lambda a: trim(json_extract_string(a, '$.skill'))),
                lambda s: s IS NOT NULL AND s <> '') AS about_skills,
    CASE WHEN json_type(v, '$.skills') = 'ARRAY' THEN from_json(json_extract(v, '$.skills'), '["VARCHAR"]')
         WHEN json_type(v, '$.teaches') = 'ARRAY' THEN from_json(json_extract(v, '$.teaches'), '["VARCHAR"]') END AS grow_list,
    coalesce(json_extract_string(v, '$.skills'), json_extract_string(v, '$.teaches')) AS grow_str,
    CASE WHEN json_type(v, '$.coursePrerequisites') = 'ARRAY' THEN from_json(json_extract(v, '$.coursePrerequisites'), '["VARCHAR"]') END AS pre,
    json_extract_string(v, '$.coursePrerequisites') AS pre_s
  FROM j
)
SELECT page_id, coalesce(nullif(regexp_extract(html, {q(P.OG_URL)}, 1), ''), 'Not found') AS url,
  CASE WHEN v IS NULL THEN 'Not found' ELSE institution END AS institution,
  CASE WHEN v IS NULL THEN 'Not found' ELSE level END AS level,
  CASE WHEN v IS NULL THEN 'Not found'
       WHEN tr_ok AND contains(tr, 'PT') THEN 'Not found'
       WHEN tr_ok AND regexp_matches(tr, '^[0-9]+$') THEN tr || ' weeks'
       WHEN tr_ok THEN 'Not found'
       WHEN len(repeat) > 0 THEN repeat[1] || ' weeks'
       ELSE 'Not found' END AS duration,
  CASE WHEN v IS NULL THEN 'Not found' ELSE coalesce(json_extract_string(v, '$.aggregateRating.ratingValue'), 'Not found') END AS rating,
  CASE WHEN v IS NULL OR NOT coalesce(about_is_list, FALSE) THEN 'Not found' ELSE {_stoplist_sql('about_skills')} END AS associated_skills,
  CASE WHEN v IS NULL THEN 'Not found'
       WHEN grow_list IS NOT NULL THEN {_stoplist_sql('grow_list')}
       WHEN grow_str IS NOT NULL THEN {_stoplist_sql("string_split(grow_str, ',')")}
       ELSE 'Not found' END AS grow_these_skills,
  CASE WHEN v IS NULL THEN 'Not found'
       WHEN pre IS NOT NULL AND len(pre) > 0 AND pre[1] <> 'Not found' THEN pre[1]
       WHEN pre IS NULL AND length(pre_s) > 0 AND pre_s[1] <> 'Not found' THEN pre_s[1]
       ELSE 'Not found' END AS prerequisites,
  CASE WHEN v IS NULL THEN 'Not found'
       ELSE coalesce(json_extract_string(v, '$.inLanguage'), json_extract_string(v, '$.availableLanguage'), 'Not found') END AS language,
  '$199.2' AS price
FROM f"""


@register("jsonld_course_edx", JSONLD_EDX_SQL)
def jsonld_course_edx(spark, sf_dir):
    """H4: edX JSON-LD rules over every page."""
    return P.jsonld_course_edx(_pages(spark, sf_dir))


def _strip_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {q(P.TAGS)}, '', 'g'), '\\s+', ' ', 'g'))"


@register("html_fallbacks", f"""
SELECT page_id,
  coalesce(nullif({_strip_sql(f"regexp_extract(html, {q(P.H1)}, 1)")}, ''), 'Not found') AS course_name,
  coalesce(nullif({_strip_sql(f"regexp_extract(html, {q(P.FIRST_P)}, 1)")}, ''), 'Not found') AS description,
  coalesce(nullif({_strip_sql(f"regexp_extract(html, {q(P.LOCALE)}, 1)")}, ''), 'N/A') AS course_language
FROM pages""")
def html_fallbacks(spark, sf_dir):
    """H5: first h1, first paragraph and locale text of every page."""
    return P.html_fallbacks(_pages(spark, sf_dir))


@register("page_text_quality", """
SELECT page_id FROM pages WHERE html IS NOT NULL AND length(trim(html)) > 0
  AND (regexp_matches(html, '(?s)<h1[^>]*>.*?</h1>') OR regexp_matches(html, 'application/ld\\+json'))""")
def page_text_quality(spark, sf_dir):
    """H6: pages with content and metadata."""
    return P.page_text_quality(_pages(spark, sf_dir)).select("page_id")
