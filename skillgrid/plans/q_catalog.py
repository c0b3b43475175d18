"""Catalogue queries: staging rules, union, level buckets, top-k per level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import courses as C
from ..operators import windows as W
from ..functions.rules import bucket_sql
from .fixture_sql import with_catalog
from .registry import catalog, register

FLAGSHIP_SQL = with_catalog() + f"""
, tagged AS (
  SELECT platform, id, course_name, level, {bucket_sql('level')} AS level_category FROM catalog
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY platform, level_category ORDER BY course_name, id) AS rn FROM tagged
  WHERE level_category IN ('BEGINNER', 'INTERMEDIATE', 'ADVANCED')
)
SELECT platform, level_category, rn, id, course_name, level FROM ranked WHERE rn <= 2
"""


@register("top2_per_level", FLAGSHIP_SQL)
def top2_per_level(spark, sf_dir):
    """W1 + U1 + N12 (flagship): two courses per difficulty level per provider."""
    cat = catalog(spark, sf_dir).select("platform", "id", "course_name", "level")
    tagged = cat.withColumn("level_category", C.level_category("level"))
    top = W.top2_per_level(tagged, extra_keys=["platform"])
    return top.select("platform", "level_category", "rn", "id", "course_name", "level")


CATALOG_COLS = ("id, course_name, description, prerequisites, skills, level, language, duration, "
                "round(duration_hours, 6) AS duration_hours, rating, source, ingestion_time, url, "
                "has_prerequisites, platform")


@register("union_catalog", with_catalog() + f"\nSELECT {CATALOG_COLS} FROM catalog")
def union_catalog(spark, sf_dir):
    """The unified 15-column catalogue (staging N1-N11, P1-P14, enrichment E1-E3)."""
    cat = catalog(spark, sf_dir)
    return cat.withColumn("duration_hours", F.round("duration_hours", 6))
