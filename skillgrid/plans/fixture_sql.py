"""DuckDB twins of the binding views in ``fixtures`` and of the catalogue build.

These strings are the oracle's side: the same reshaping written as SQL over
the pre-registered driver tables, so each ``oracle_sql()`` entry can be one
``WITH ... SELECT``.  Pattern lists are generated from the same fixed values
the Spark side uses.
"""

from __future__ import annotations

from ..functions import rules as RULES
from ..functions.skills import dictionary_entries, boundary_pattern
from ..operators.enrich import DEFAULT_PREREQUISITES, LEVEL_KEYWORDS, PREREQ_PATTERN

INGESTION_TS = "TIMESTAMP '2024-01-01 00:00:00'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


COURSES = """
courses AS (
  SELECT d.doc_id AS id,
         p.p_name || ' ' || CAST(d.doc_id AS VARCHAR) AS course_name,
         d.text AS description,
         CASE WHEN p.p_size % 5 = 0 THEN NULL ELSE replace(p.p_name, ' ', ', ') END AS skills,
         CASE WHEN p.p_size % 4 = 0 THEN 'No prerequisites required' WHEN p.p_size % 4 = 1 THEN ''
              WHEN p.p_size % 4 = 2 THEN NULL ELSE p.p_brand END AS prerequisites,
         CASE p.p_type WHEN 'ECONOMY' THEN 'Beginner Level' WHEN 'SMALL' THEN 'Intermediate Level'
                       WHEN 'MEDIUM' THEN 'Expert Level' WHEN 'LARGE' THEN 'All Levels'
                       WHEN 'PROMO' THEN '' ELSE NULL END AS level_raw,
         CAST(p.p_size AS VARCHAR) || CASE p.p_size % 3 WHEN 0 THEN ' total hours' WHEN 1 THEN ' total mins' ELSE ' questions' END AS content_info,
         CASE p.p_size % 3 WHEN 0 THEN 'P' || CAST(p.p_size AS VARCHAR) || 'W'
                           WHEN 1 THEN 'PT' || CAST(p.p_size AS VARCHAR) || 'H' ELSE 'PT30M' END AS iso_duration,
         CASE WHEN p.p_size % 7 = 0 THEN 'Not found' ELSE CAST(CAST(p.p_size % 50 AS DOUBLE) / 10 AS VARCHAR) END AS rating_raw,
         d.lang AS lang,
         '/course/' || CAST(d.doc_id AS VARCHAR) || '/' AS url_path,
         CASE d.doc_id % 3 WHEN 0 THEN 'Udemy' WHEN 1 THEN 'Udacity' ELSE 'edX' END AS platform
  FROM documents d JOIN part p ON p.p_partkey = d.doc_id
)"""

RAW_PROVIDERS = """
udemy_raw AS (
  SELECT id AS course_id, course_name AS title, url_path AS url, description AS objectives_summary,
         prerequisites, skills, level_raw AS instructional_level,
         CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS detected_language,
         content_info, rating_raw AS rating
  FROM courses WHERE platform = 'Udemy'
),
udacity_raw AS (
  SELECT id AS doc_id, 'https://www.udacity.com' || url_path AS url, course_name AS cname, description AS descr,
         CASE level_raw WHEN 'Beginner Level' THEN 'Beginner' WHEN 'Intermediate Level' THEN ' intermediate '
                        WHEN 'Expert Level' THEN 'ADVANCED' WHEN 'All Levels' THEN 'Discovery' ELSE level_raw END AS lvl,
         prerequisites AS pre, iso_duration AS dur, lang AS language, skills, rating_raw AS rating
  FROM courses WHERE platform = 'Udacity'
),
edx_raw AS (
  SELECT id AS doc_id, 'https://www.edx.org' || url_path AS url, course_name, description AS course_description,
         CASE level_raw WHEN 'Beginner Level' THEN 'beginner' WHEN 'Intermediate Level' THEN 'Intermediate'
                        WHEN 'Expert Level' THEN 'Advanced' WHEN 'All Levels' THEN 'Introductory' ELSE level_raw END AS level,
         CASE WHEN prerequisites = '' THEN 'Not found' WHEN prerequisites = 'No prerequisites required' THEN 'None.'
              ELSE prerequisites END AS prerequisites,
         coalesce(skills, 'Not found') AS associated_skills,
         CASE WHEN id % 4 = 2 THEN 'Statistics, Modelling' WHEN id % 4 = 3 THEN NULL ELSE 'Not found' END AS grow_these_skills,
         lang AS language,
         CASE WHEN id % 2 = 0 THEN regexp_extract(content_info, '[0-9]+', 0) || ' weeks' ELSE content_info END AS duration,
         rating_raw AS rating
  FROM courses WHERE platform = 'edX'
)"""


def clean_ws(x: str) -> str:
    return f"trim(translate({x}, chr(10) || chr(13) || chr(9), '   '))"


def infer_skills_sql(title: str, body: str) -> str:
    t = f"({title} || '. ' || {body})"
    items = ", ".join(f"CASE WHEN regexp_matches({t}, {q(boundary_pattern(s))}) THEN {q(s)} END"
                      for _, _, s in dictionary_entries())
    return f"nullif(array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ', '), '')"


def infer_prereq_sql(title: str, body: str) -> str:
    t = f"({title} || '. ' || {body})"
    return f"coalesce(nullif(trim(regexp_extract({t}, {q(PREREQ_PATTERN)}, 1)), ''), {q(DEFAULT_PREREQUISITES)})"


def infer_level_sql(title: str, body: str) -> str:
    low = f"lower({title} || '. ' || {body})"
    scores = []
    for label, words in LEVEL_KEYWORDS:
        s = " + ".join(f"((length({low}) - length(replace({low}, {q(w)}, ''))) / {len(w)})" for w in words)
        scores.append((label, f"({s})"))
    (bl, b), (il, i), (al, a) = scores
    return (f"CASE WHEN ({b} + {i} + {a}) IS NULL OR ({b} + {i} + {a}) = 0 THEN 'Discovery' "
            f"WHEN {b} >= {i} AND {b} >= {a} THEN {q(bl)} WHEN {i} >= {a} THEN {q(il)} ELSE {q(al)} END")


def _or_inferred(column: str, inferred: str) -> str:
    """The column, or the inferred text where it is missing or blank."""
    return f"CASE WHEN coalesce(trim({column}), '') = '' THEN {inferred} ELSE {column} END"


def _blank(x: str) -> str:
    return f"nullif({x}, '')"


def _split_rejoin(column: str, sep: str) -> str:
    return _blank(f"array_to_string(string_split(trim({column}), {q(sep)}), ', ')")


# How each provider's raw columns become the common ones; durations, flags and levels come from the rule tables.
_SHAPES = {
    "Udemy": dict(
        raw="udemy_raw", id="course_id", url="CAST(url AS VARCHAR)", name="title", body="objectives_summary", rating="CAST(rating AS VARCHAR)",
        prerequisites=_blank("trim(prerequisites)"), pre="prerequisites", skills=_blank("trim(skills)"), level="instructional_level",
        lang="detected_language", dur="content_info", keep="TRUE"),
    "Udacity": dict(
        raw="udacity_raw", id="sha256(url)", url="url", name="cname", body="descr", rating="rating",
        prerequisites=_split_rejoin("pre", ","), pre="pre", skills=_split_rejoin("skills", ", "), level="lvl",
        lang="language", dur="dur", keep="cname IS NOT NULL"),
    "edX": dict(
        raw="edx_raw", id="sha256(url)", url="url", name="course_name", body="course_description", rating="rating",
        prerequisites=_blank(f"trim(CASE WHEN {RULES.has_prerequisites_sql('prerequisites', 'edx')} THEN prerequisites END)"), pre="prerequisites",
        skills=_blank("replace(associated_skills, 'Not found', '')"), level="level", lang="language", dur="duration", keep="TRUE"),
}


def _stage(source: str) -> str:
    s, provider = _SHAPES[source], source.lower()
    columns = {
        "id": s["id"], "url": s["url"], "course_name": f"trim({s['name']})", "description": clean_ws(s["body"]),
        "prerequisites": s["prerequisites"], "has_prerequisites": RULES.has_prerequisites_sql(s["pre"], provider), "skills": s["skills"],
        "level": f"trim({s['level']})", "language": RULES.language_sql(s["lang"], provider),
        "duration": f"trim({s['dur']})" if provider == "edx" else RULES.duration_sql(s["dur"], provider),
        "duration_hours": RULES.hours_sql(s["dur"], provider), "rating": f"coalesce(TRY_CAST({s['rating']} AS DOUBLE), -1.0)",
        "source": q(source), "ingestion_time": INGESTION_TS}
    if provider == "edx":
        columns["grow_these_skills"] = _blank(clean_ws("replace(grow_these_skills, 'Not found', '')"))
    listed = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"stg_{provider} AS (SELECT {listed} FROM {s['raw']} WHERE {s['keep']})"


def staging() -> str:
    inferred = infer_skills_sql("course_name", "description")
    prerequisites = infer_prereq_sql("course_name", "description")
    return ", ".join([*map(_stage, _SHAPES), f"""
enr_udacity AS (
  SELECT * REPLACE ({_or_inferred('prerequisites', prerequisites)} AS prerequisites, {_or_inferred('skills', inferred)} AS skills,
                    CASE WHEN level = '' THEN {infer_level_sql('course_name', 'description')} ELSE level END AS level)
  FROM stg_udacity WHERE description IS NOT NULL
)""", f"""
enr_edx AS (
  SELECT * EXCLUDE (grow_these_skills) REPLACE (
    coalesce(prerequisites, {prerequisites}) AS prerequisites,
    coalesce({_blank("trim(concat_ws(', ', skills, grow_these_skills))")}, {inferred}) AS skills)
  FROM stg_edx WHERE description IS NOT NULL
)"""])


def _catalog() -> str:
    shared = "course_name, description, prerequisites, skills, language, duration, duration_hours, rating, source, ingestion_time, url, has_prerequisites"
    parts = [f"SELECT CAST(id AS VARCHAR) AS id, {shared}, {RULES.level_sql('level', source.lower())} AS level, {q(source)} AS platform FROM {table}"
             for source, table in (("Udemy", "stg_udemy"), ("Udacity", "enr_udacity"), ("edX", "enr_edx"))]
    return "\ncatalog AS (" + " UNION ALL ".join(parts) + ")"


CATALOG = _catalog()


def with_catalog(*extra: str) -> str:
    """``WITH courses, raw providers, staging, catalog[, extra]``."""
    parts = [COURSES, RAW_PROVIDERS, staging(), CATALOG, *extra]
    return "WITH " + ",".join(parts)


def with_courses(*extra: str) -> str:
    return "WITH " + ",".join([COURSES, *extra])


def role_of_sql(key: str) -> str:
    return (f"CASE {key} % 5 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Systems Engineer' WHEN 2 THEN 'Software Developer' "
            f"WHEN 3 THEN 'Mechanical Engineer' ELSE 'Nurse' END")


USER_ROLES = f"""
user_roles AS (SELECT c_custkey AS user_id, {role_of_sql('c_custkey')} AS role FROM customer)"""

HELD = """
held AS (
  SELECT DISTINCT o_custkey AS user_id, p_type AS skill
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size <= 20
)"""

REQUIREMENTS = f"""
req AS (
  SELECT {role_of_sql('p_partkey')} AS role,
         CASE p_size % 4 WHEN 0 THEN 'Essential' WHEN 1 THEN 'Preferred skills' WHEN 2 THEN 'Nice to have' ELSE 'Core' END AS skill_category,
         CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_brand END AS skill_name, p_partkey AS ord
  FROM part
), bucketed AS (
  SELECT role, skill_name, ord,
         CASE WHEN contains(lower(coalesce(skill_category, '')), 'essential') OR contains(lower(coalesce(skill_category, '')), 'required')
                   OR contains(lower(coalesce(skill_category, '')), 'must') THEN 'essential'
              WHEN contains(lower(coalesce(skill_category, '')), 'preferred') OR contains(lower(coalesce(skill_category, '')), 'nice')
                   OR contains(lower(coalesce(skill_category, '')), 'optional') THEN 'preferred'
              ELSE 'essential' END AS bucket
  FROM req WHERE skill_name IS NOT NULL
), rr AS (
  SELECT role, bucket, row_number() OVER (PARTITION BY role, bucket ORDER BY ord) AS pos, skill_name FROM bucketed
  QUALIFY row_number() OVER (PARTITION BY role, bucket ORDER BY ord) <= 5
)"""
