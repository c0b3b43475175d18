"""Binding views: the driver's tables reshaped into the schemas the operators expect.

Each builder only renames and reshapes driver columns (FIXTURES.md section 3);
none of them does an operator's work.  The SQL twins in ``fixture_sql`` build the
same rows in DuckDB for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

# Fixed ingestion time used instead of CURRENT_TIMESTAMP so results compare.
INGESTION_TIME = "2024-01-01 00:00:00"


def _t(spark, sf_dir, name, *cols):
    df = read_table(spark, sf_dir, name)
    return df.select(*cols) if cols else df


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw course rows of all three providers (FIXTURES.md ``courses``)."""
    d = _t(spark, sf_dir, "documents", "doc_id", "text", "lang")
    p = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = d.join(p, F.col("p_partkey") == F.col("doc_id"))
    size = F.col("p_size")
    sid = F.col("doc_id").cast("string")
    return j.select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("p_name"), F.lit(" "), sid).alias("course_name"),
        F.col("text").alias("description"),
        F.when(size % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit(", "))).alias("skills"),
        F.when(size % 4 == 0, F.lit("No prerequisites required")).when(size % 4 == 1, F.lit(""))
         .when(size % 4 == 2, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("prerequisites"),
        F.when(F.col("p_type") == "ECONOMY", "Beginner Level").when(F.col("p_type") == "SMALL", "Intermediate Level")
         .when(F.col("p_type") == "MEDIUM", "Expert Level").when(F.col("p_type") == "LARGE", "All Levels")
         .when(F.col("p_type") == "PROMO", "").alias("level_raw"),
        F.concat(size.cast("string"), F.when(size % 3 == 0, " total hours").when(size % 3 == 1, " total mins")
                 .otherwise(" questions")).alias("content_info"),
        F.when(size % 3 == 0, F.concat(F.lit("P"), size.cast("string"), F.lit("W")))
         .when(size % 3 == 1, F.concat(F.lit("PT"), size.cast("string"), F.lit("H")))
         .otherwise(F.lit("PT30M")).alias("iso_duration"),
        F.when(size % 7 == 0, F.lit("Not found"))
         .otherwise(((size % 50).cast("double") / 10).cast("string")).alias("rating_raw"),
        F.col("lang"),
        F.concat(F.lit("/course/"), sid, F.lit("/")).alias("url_path"),
        F.when(F.col("doc_id") % 3 == 0, "Udemy").when(F.col("doc_id") % 3 == 1, "Udacity")
         .otherwise("edX").alias("platform"),
    )


def _lang_name(c):
    return (F.when(c == "en", "English").when(c == "de", "German")
            .when(c == "fr", "French").when(c == "es", "Spanish"))


def udemy_raw(c: DataFrame) -> DataFrame:
    """Udemy landing rows: integer id, relative URL, detected language name."""
    return c.filter(F.col("platform") == "Udemy").select(
        F.col("id").alias("course_id"), F.col("course_name").alias("title"), F.col("url_path").alias("url"),
        F.col("description").alias("objectives_summary"), "prerequisites", "skills",
        F.col("level_raw").alias("instructional_level"), _lang_name(F.col("lang")).alias("detected_language"),
        "content_info", F.col("rating_raw").alias("rating"))


def udacity_raw(c: DataFrame) -> DataFrame:
    """Udacity page records with the JSON field names of the crawler."""
    lvl = F.col("level_raw")
    return c.filter(F.col("platform") == "Udacity").select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("https://www.udacity.com"), F.col("url_path")).alias("URL"),
        F.col("course_name").alias("Course Name"), F.col("description").alias("Description"),
        F.when(lvl == "Beginner Level", "Beginner").when(lvl == "Intermediate Level", " intermediate ")
         .when(lvl == "Expert Level", "ADVANCED").when(lvl == "All Levels", "Discovery").otherwise(lvl).alias("Level"),
        F.col("prerequisites").alias("Prerequisites"), F.col("iso_duration").alias("Duration"),
        F.col("lang").alias("Language"), F.col("skills").alias("Skills"), F.col("rating_raw").alias("Rating"))


def edx_raw(c: DataFrame) -> DataFrame:
    """edX page records; missing values spelled ``Not found`` like the crawler."""
    lvl = F.col("level_raw")
    pre = F.col("prerequisites")
    return c.filter(F.col("platform") == "edX").select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("https://www.edx.org"), F.col("url_path")).alias("URL"),
        "course_name", F.col("description").alias("course_description"),
        F.when(lvl == "Beginner Level", "beginner").when(lvl == "Intermediate Level", "Intermediate")
         .when(lvl == "Expert Level", "Advanced").when(lvl == "All Levels", "Introductory").otherwise(lvl).alias("level"),
        F.when(pre == "", "Not found").when(pre == "No prerequisites required", "None.").otherwise(pre).alias("prerequisites"),
        F.coalesce(F.col("skills"), F.lit("Not found")).alias("associated_skills"),
        F.when(F.col("id") % 4 == 2, "Statistics, Modelling").when(F.col("id") % 4 == 3, F.lit(None).cast("string"))
         .otherwise(F.lit("Not found")).alias("grow_these_skills"),
        F.col("lang").alias("language"),
        F.when(F.col("id") % 2 == 0, F.concat(F.regexp_extract("content_info", "[0-9]+", 0), F.lit(" weeks")))
         .otherwise(F.col("content_info")).alias("duration"),
        F.col("rating_raw").alias("rating"))


def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: distinct brands (hard skills) and types (soft skills) it ships."""
    li = _t(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    p = _t(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    s = _t(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    # Pre-aggregate (supplier, part) pairs before joining the wide part table.
    pairs = li.select("l_suppkey", "l_partkey").distinct()
    j = pairs.join(p, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return (j.groupBy("l_suppkey", "s_name")
            .agg(F.array_sort(F.collect_set("p_brand")).alias("hard"), F.array_sort(F.collect_set("p_type")).alias("soft"))
            .select(F.col("l_suppkey").alias("id"), F.col("s_name").alias("company_reported"),
                    F.col("hard").alias("hard_skill_labels"),
                    F.when(F.col("l_suppkey") % 4 == 0, F.lit(None).cast("array<string>"))
                     .otherwise(F.col("soft")).alias("soft_skill_labels")))


def held_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, skill) a user holds: customers x part types they bought."""
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    li = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    p = _t(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").filter(F.col("p_size") <= 20)
    return (o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(p, F.col("p_partkey") == F.col("l_partkey"))
            .select(F.col("o_custkey").alias("user_id"), F.col("p_type").alias("skill")).distinct())


def learning_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning-path rows: user, target role, creation time; order key breaks ties."""
    return _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").select(
        F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("target_role"), F.col("o_orderdate").alias("created_at"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, skill, rating, ts) from ``view`` events; skill = props.k mod 10."""
    e = _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props").filter(F.col("event_type") == "view")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select("user_id", F.concat(F.lit("skill_"), (k % 10).cast("string")).alias("skill"),
                    (F.lit(1) + F.col("event_id") % 5).cast("int").alias("rating"), "ts", "event_id")


def sessions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows: user, JSON state, timestamp, source page."""
    return _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props").select(
        F.col("user_id").alias("user_name"), F.col("props").alias("chat_history"),
        F.col("ts").alias("cur_timestamp"), F.col("event_type").alias("source_page"), "event_id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("segment"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(
        "vec_id", F.col("embedding"), (F.col("label") / 2.0).alias("rating"))


ROLE_NAMES = ("Data Scientist", "Systems Engineer", "Software Developer", "Mechanical Engineer", "Nurse")


def role_of(key_col) -> "F.Column":
    """Role assigned to a key: one of the five fixed roles by key modulo 5."""
    k = F.col(key_col) % 5
    expr = F.when(k == 0, ROLE_NAMES[0])
    for i, r in enumerate(ROLE_NAMES[1:], start=1):
        expr = expr.when(k == i, r)
    return expr


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with a target role."""
    return _t(spark, sf_dir, "customer", "c_custkey").select(
        F.col("c_custkey").alias("user_id"), role_of("c_custkey").alias("role"))


def requirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, skill_category, skill_name, ord) search-result rows, one per part."""
    p = _t(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    size = F.col("p_size")
    return p.select(
        role_of("p_partkey").alias("role"),
        F.when(size % 4 == 0, "Essential").when(size % 4 == 1, "Preferred skills")
         .when(size % 4 == 2, "Nice to have").otherwise("Core").alias("skill_category"),
        F.when(size % 2 == 0, F.lower("p_type")).otherwise(F.col("p_brand")).alias("skill_name"),
        F.col("p_partkey").alias("ord"))
