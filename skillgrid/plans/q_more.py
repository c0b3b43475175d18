"""Inventory rows whose operator is shared with another query, registered under their own key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skills as S
from ..operators import recommend as R
from ..operators import windows as W
from ..sources import files as FS
from . import fixtures as X
from .fixture_sql import COURSES, RAW_PROVIDERS, with_courses
from .q_io import _fresh, csv_union
from .q_recommend import ADV_SQL, C1_BASE, _recs
from .q_skills import _rules_sql
from .registry import register


@register("csv_encoding_fallback", with_courses() + """
SELECT lower(platform) || '.csv' AS file,
       CASE WHEN platform = 'edX' AND bool_or(regexp_matches(description, '[^\\x00-\\x7F]')) THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding
FROM courses GROUP BY platform""")
def csv_encoding_fallback(spark, sf_dir):
    """The encoding chosen per provider: UTF-8 when every line of its files decodes, else ISO-8859-1."""
    c = X.courses(spark, sf_dir)
    d = _fresh(spark, "enc")
    for platform, name, enc in (("Udemy", "udemy", "UTF-8"), ("Udacity", "udacity", "UTF-8"), ("edX", "edx", "ISO-8859-1")):
        (c.filter(F.col("platform") == platform).select("id", "description").write.option("header", True)
         .option("encoding", enc).option("quote", '"').option("escape", '"').csv(f"{d}/{name}"))
    enc = FS.detect_encodings(spark, [f"{d}/{n}" for n in ("udemy", "udacity", "edx")])
    file = F.concat(F.regexp_extract("file", "/(udemy|udacity|edx)/[^/]*$", 1), F.lit(".csv"))
    return enc.groupBy(file.alias("file")).agg(F.max_by("encoding", F.col("encoding") != "UTF-8").alias("encoding"))


@register("csv_infer_load", with_courses() + """
SELECT CAST(id AS INTEGER) AS id, course_name, rating_raw AS rating FROM courses WHERE platform = 'Udemy'
UNION ALL SELECT CAST(id AS INTEGER), course_name, NULL FROM courses WHERE platform = 'Udacity'
UNION ALL SELECT CAST(id AS INTEGER), course_name, NULL FROM courses WHERE platform = 'edX'""")
def csv_infer_load(spark, sf_dir):
    """Inferred-schema CSV load; columns matched case-insensitively (``ID``, ``Course_Name``)."""
    df = csv_union(spark, sf_dir)
    return df.select(F.col("ID").alias("id"), F.col("COURSE_NAME").alias("course_name"), F.col("Rating").alias("rating"))


@register("union_by_name_missing", with_courses() + """
SELECT lower(platform) AS provider, count(*) AS n,
       count(CASE WHEN platform = 'Udacity' THEN description END) AS with_description,
       count(CASE WHEN platform = 'Udemy' THEN rating_raw END) AS with_rating,
       count(CASE WHEN platform = 'edX' THEN lang END) AS with_language
FROM courses GROUP BY platform""")
def union_by_name_missing(spark, sf_dir):
    """Union by name, columns a file lacks filled with NULL; non-NULL counts per source file."""
    df = csv_union(spark, sf_dir, source_col="source_file")
    provider = F.regexp_extract("source_file", "/(udemy|udacity|edx)/[^/]*$", 1)
    return df.groupBy(provider.alias("provider")).agg(
        F.count(F.lit(1)).alias("n"), F.count("description").alias("with_description"),
        F.count("rating").alias("with_rating"), F.count("language").alias("with_language"))


@register("not_null_filter", "WITH " + COURSES + "," + RAW_PROVIDERS + """
SELECT doc_id, cname AS course_name FROM udacity_raw WHERE cname IS NOT NULL""")
def not_null_filter(spark, sf_dir):
    """Keep records whose key field is present."""
    u = X.udacity_raw(X.courses(spark, sf_dir))
    return u.filter(F.col("`Course Name`").isNotNull()).select("doc_id", F.col("`Course Name`").alias("course_name"))


@register("null_backlog", with_courses() + """
SELECT id FROM courses WHERE skills IS NULL AND description IS NOT NULL""")
def null_backlog(spark, sf_dir):
    """Rows still lacking an enrichment value while their input exists."""
    c = X.courses(spark, sf_dir)
    return c.filter(F.col("skills").isNull() & F.col("description").isNotNull()).select("id")


@register("project_rename", "WITH " + COURSES + "," + RAW_PROVIDERS + """
SELECT 'https://www.udacity.com' || url_path AS url, course_name, 'Udacity' AS source FROM courses WHERE platform = 'Udacity'""")
def project_rename(spark, sf_dir):
    """Final column list with FINAL_* columns renamed over the originals."""
    u = X.udacity_raw(X.courses(spark, sf_dir))
    staged = u.select(F.col("URL").alias("FINAL_URL"), F.col("`Course Name`").alias("FINAL_COURSE_NAME"), F.lit("Udacity").alias("SOURCE"))
    return staged.select(F.col("FINAL_URL").alias("url"), F.col("FINAL_COURSE_NAME").alias("course_name"),
                         F.col("SOURCE").alias("source"))


@register("rules_lookup", "WITH user_roles AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'Data Scientist' "
          "WHEN 1 THEN 'Systems Engineer' WHEN 2 THEN 'Software Developer' WHEN 3 THEN 'Mechanical Engineer' ELSE 'Nurse' END AS role "
          "FROM customer)\n" + f"""
SELECT user_id, role, to_json({_rules_sql('role', S.DEFAULT_SKILL_RULES, S.DEFAULT_SKILLS_ELSE)}) AS default_skills,
       to_json({_rules_sql('role', S.ROLE_KEYWORD_RULES, ())}) AS keywords FROM user_roles""")
def rules_lookup(spark, sf_dir):
    """Role text -> rule row (default skills, keywords) by ordered substring rules."""
    u = X.user_roles(spark, sf_dir)
    return u.select("user_id", "role", F.to_json(S.role_default_skills("role")).alias("default_skills"),
                    F.to_json(S.role_keywords("role")).alias("keywords"))


@register("order_by_level", C1_BASE + "\nSELECT user_id, level_category, rn, course_name FROM recs")
def order_by_level(spark, sf_dir):
    """Recommendations ordered by level bucket (alphabetical), then user and rank."""
    alike, recs, _ = _recs(spark, sf_dir)
    return W.order_by_level(alike.of(recs.select("user_id", "level_category", "rn", "course_name")), "level_category", "user_id", "rn")


@register("append_backfill", ADV_SQL + "\nSELECT user_id, level_category, count(*) AS n FROM combined GROUP BY 1, 2")
def append_backfill(spark, sf_dir):
    """Recommendation rows with the advanced backfill rows appended (count per user and level)."""
    from .q_recommend import advanced_backfill
    out = advanced_backfill(spark, sf_dir)
    return out.groupBy("user_id", "level_category").agg(F.count(F.lit(1)).alias("n"))


@register("priority_tag", """
WITH ratings AS (
  SELECT user_id, 'skill_' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS skill,
         CAST(1 + event_id % 5 AS INTEGER) AS rating FROM events WHERE event_type = 'view')
SELECT user_id, skill, rating, CASE WHEN rating <= 2 THEN 'Prioritize' WHEN rating = 3 THEN 'Focus area' END AS priority FROM ratings""")
def priority_tag(spark, sf_dir):
    """Rating <= 2 Prioritize, = 3 Focus area, else none (every rating event)."""
    r = X.ratings(spark, sf_dir)
    return R.skill_levels_profile(r)
