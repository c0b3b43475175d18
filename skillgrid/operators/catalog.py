"""Catalogue build: per-provider staging, enrichment fill, union.

Every step is a narrow projection or filter, so the three provider branches
run as one scan each and meet only at the ``UNION ALL`` (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import courses as C
from ..functions import text as T
from . import enrich as E

CATALOG_COLUMNS = (
    "id", "course_name", "description", "prerequisites", "skills", "level", "language", "duration",
    "duration_hours", "rating", "source", "ingestion_time", "url", "has_prerequisites", "platform",
)


def stable_id(c) -> Column:
    """Deterministic replacement for UUID_STRING(): sha-256 of the URL."""
    return F.sha2(T._col(c), 256)


def stage_udemy(raw: DataFrame, ingestion_time: str) -> DataFrame:
    pre = F.col("prerequisites")
    return raw.select(
        F.col("course_id").alias("id"), F.col("url").cast("string").alias("url"),
        F.trim(F.col("title")).alias("course_name"),
        T.clean_whitespace("objectives_summary").alias("description"),
        T.blank_to_null(pre).alias("prerequisites"),
        C.has_prereq(pre, "udemy").alias("has_prerequisites"),
        T.blank_to_null("skills").alias("skills"),
        F.trim(F.col("instructional_level")).alias("level"),
        C.language_flag("detected_language", "udemy").alias("language"),
        C.duration("content_info", "udemy").alias("duration"),
        C.duration_hours("content_info", "udemy").alias("duration_hours"),
        C.rating_sentinel("rating").alias("rating"),
        F.lit("Udemy").alias("source"),
        F.lit(ingestion_time).cast("timestamp_ntz").alias("ingestion_time"))


def stage_udacity(raw: DataFrame, ingestion_time: str) -> DataFrame:
    """Typed projection out of the page record, rows without a name dropped."""
    pre = F.col("`Prerequisites`")
    return raw.filter(F.col("`Course Name`").isNotNull()).select(
        stable_id("URL").alias("id"), F.col("URL").alias("url"),
        F.trim(F.col("`Course Name`")).alias("course_name"),
        T.clean_whitespace("Description").alias("description"),
        F.nullif(T.split_rejoin(pre, ","), F.lit("")).alias("prerequisites"),
        C.has_prereq(pre, "udacity").alias("has_prerequisites"),
        F.nullif(T.split_rejoin(F.col("Skills"), ", "), F.lit("")).alias("skills"),
        F.trim(F.col("Level")).alias("level"),
        C.language_flag("Language", "udacity").alias("language"),
        C.duration("Duration", "udacity").alias("duration"),
        C.duration_hours("Duration", "udacity").alias("duration_hours"),
        C.rating_sentinel("Rating").alias("rating"),
        F.lit("Udacity").alias("source"),
        F.lit(ingestion_time).cast("timestamp_ntz").alias("ingestion_time"))


def stage_edx(raw: DataFrame, ingestion_time: str) -> DataFrame:
    grow = F.replace(F.col("grow_these_skills"), F.lit("Not found"), F.lit(""))
    return raw.select(
        stable_id("URL").alias("id"), F.col("URL").alias("url"),
        F.trim(F.col("course_name")).alias("course_name"),
        T.clean_whitespace("course_description").alias("description"),
        T.prereq_clean("prerequisites").alias("prerequisites"),
        C.has_prereq("prerequisites", "edx").alias("has_prerequisites"),
        T.strip_not_found("associated_skills").alias("skills"),
        F.nullif(T.clean_whitespace(grow), F.lit("")).alias("grow_these_skills"),
        F.trim(F.col("level")).alias("level"),
        C.language_flag("language", "edx").alias("language"),
        F.trim(F.col("duration")).alias("duration"),
        C.duration_hours("duration", "edx").alias("duration_hours"),
        C.rating_sentinel("rating").alias("rating"),
        F.lit("edX").alias("source"),
        F.lit(ingestion_time).cast("timestamp_ntz").alias("ingestion_time"))


def _blank(c) -> Column:
    c = T._col(c)
    return c.isNull() | (F.trim(c) == "")


def enrich_udacity(staged: DataFrame) -> DataFrame:
    """P13 + P14: fill level (blank only), prerequisites and skills (NULL or blank)."""
    desc = F.col("description")
    need = (F.trim(F.col("level")) == "") | _blank("prerequisites") | _blank("skills")
    base = E.with_course_text(staged.filter(desc.isNotNull()), "course_name", "description", need)
    base = base.withColumn("_found", F.when(_blank("skills"), E.infer_skills("_ctext", "_clow")))
    final_level = F.when(F.trim(F.col("level")) == "", E.infer_level("_clow")).otherwise(F.col("level"))
    final_pre = F.when(_blank("prerequisites") & desc.isNotNull(),
                       E.infer_prerequisites("_ctext")).otherwise(F.col("prerequisites"))
    final_skills = F.when(_blank("skills") & desc.isNotNull(),
                          E.skills_text("_found")).otherwise(F.col("skills"))
    return base.select(
        "id", "course_name", "description", final_pre.alias("prerequisites"), final_skills.alias("skills"),
        final_level.alias("level"), "language", "duration", "duration_hours", "rating", "source",
        "ingestion_time", "url", "has_prerequisites")


def enrich_edx(staged: DataFrame) -> DataFrame:
    """P13 + N14: fill NULL prerequisites; skills = combined, else inferred when both blank."""
    desc = F.col("description")
    need = F.col("prerequisites").isNull() | (_blank("skills") & _blank("grow_these_skills"))
    base = E.with_course_text(staged.filter(desc.isNotNull()), "course_name", "description", need)
    base = base.withColumn("_found", F.when(_blank("skills") & _blank("grow_these_skills"),
                                            E.infer_skills("_ctext", "_clow")))
    filled_pre = F.when(F.col("prerequisites").isNull() & desc.isNotNull(),
                        E.infer_prerequisites("_ctext")).otherwise(F.col("prerequisites"))
    combined = C.combine_skills("skills", "grow_these_skills")
    inferred = F.when(_blank("skills") & _blank("grow_these_skills") & desc.isNotNull(),
                      E.skills_text("_found"))
    skills = F.when((combined == "") | combined.isNull(), inferred).otherwise(combined)
    return base.select(
        "id", "course_name", "description", "url", filled_pre.alias("prerequisites"), skills.alias("skills"),
        "has_prerequisites", "level", "language", "duration", "duration_hours", "rating", "source",
        "ingestion_time")


def _catalog_select(df: DataFrame, provider: str, platform: str) -> DataFrame:
    return df.select(
        F.col("id").cast("string").alias("id"), "course_name", "description", "prerequisites", "skills",
        C.level_normalize("level", provider).alias("level"), "language", "duration", "duration_hours",
        "rating", "source", "ingestion_time", "url", "has_prerequisites", F.lit(platform).alias("platform"))


def union_catalog(udemy: DataFrame, udacity: DataFrame, edx: DataFrame) -> DataFrame:
    """``UNION ALL`` of three providers projected to the 15-column catalogue."""
    return (_catalog_select(udemy, "udemy", "Udemy")
            .unionByName(_catalog_select(udacity, "udacity", "Udacity"))
            .unionByName(_catalog_select(edx, "edx", "edX")))


def build_catalog(courses: DataFrame, ingestion_time: str) -> DataFrame:
    """Raw course rows -> staged -> enriched -> unified catalogue."""
    from ..plans import fixtures as X
    udemy = stage_udemy(X.udemy_raw(courses), ingestion_time)
    udacity = enrich_udacity(stage_udacity(X.udacity_raw(courses), ingestion_time))
    edx = enrich_edx(stage_edx(X.edx_raw(courses), ingestion_time))
    return union_catalog(udemy, udacity, edx)
