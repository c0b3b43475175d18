"""Skill-gap jobs over whole tables.

Required skills per role are short (at most five essential and five
preferred), but the held-skill table is large and may be skewed by user.  So
the comparison is relational: each user's (bounded) required list is exploded
and left-joined to the held table on ``(user, lower(skill))``; only the
bounded per-user result lists are re-assembled.  The held side is never
collected per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ESSENTIAL_WORDS = ("essential", "required", "must")
PREFERRED_WORDS = ("preferred", "nice", "optional")


def _any_contains(c, words):
    cond = None
    for w in words:
        x = F.instr(c, w) > 0
        cond = x if cond is None else cond | x
    return cond


def role_requirements(req: DataFrame, k: int = 5) -> DataFrame:
    """Bucket (role, category, skill, ord) rows into essential / preferred, first k each.

    Unclear categories count as essential.  Top-k per (role, bucket) is a
    ``row_number`` filter, which Spark limits per map task before the shuffle.
    """
    cat = F.lower(F.coalesce(F.col("skill_category"), F.lit("")))
    bucket = (F.when(_any_contains(cat, ESSENTIAL_WORDS), "essential")
              .when(_any_contains(cat, PREFERRED_WORDS), "preferred").otherwise("essential"))
    rows = (req.filter(F.col("skill_name").isNotNull())
            .withColumn("bucket", bucket))
    w = Window.partitionBy("role", "bucket").orderBy("ord")
    return rows.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= k) \
               .select("role", "bucket", "pos", "skill_name")


def _ordered_list(cond, value="skill_name"):
    """Ordered (by pos) list of ``value`` where ``cond`` holds; bounded by the required list."""
    items = F.collect_list(F.when(cond, F.struct(F.col("pos"), F.col(value))))
    return F.transform(F.array_sort(items), lambda s: s[value])


def match_skills(users: DataFrame, requirements: DataFrame, held: DataFrame) -> DataFrame:
    """C6 (+U4, U5, A5): per user and target role, matched / missing essential and preferred.

    ``users``: (user_id, role); ``requirements``: role_requirements output;
    ``held``: (user_id, skill).  Percentages use half-even rounding to one
    decimal (Python ``round``); an empty requirement list gives 0.
    """
    need = users.join(requirements, "role")          # bounded fan-out: <= 2k rows per user
    held_keys = held.select("user_id", F.lower("skill").alias("skill_key")).distinct() \
                    .withColumn("held", F.lit(True))
    j = need.withColumn("skill_key", F.lower("skill_name")).join(held_keys, ["user_id", "skill_key"], "left")
    hit = F.col("held").isNotNull()
    ess, pref = F.col("bucket") == "essential", F.col("bucket") == "preferred"
    agg = j.groupBy("user_id", "role").agg(
        _ordered_list(ess & hit).alias("matching_essential"),
        _ordered_list(ess & ~hit).alias("missing_essential"),
        _ordered_list(pref & hit).alias("matching_preferred"),
        _ordered_list(pref & ~hit).alias("missing_preferred"),
        F.count_if(ess).alias("n_ess"), F.count_if(pref).alias("n_pref"),
        F.count_if(ess & hit).alias("m_ess"), F.count_if(pref & hit).alias("m_pref"))
    full = users.join(agg, ["user_id", "role"], "left")

    def pct(m, n):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.bround(m / n * 100.0, 1)).otherwise(F.lit(0.0))

    empty = F.array().cast("array<string>")
    return full.select(
        "user_id", "role",
        *[F.coalesce(F.col(c), empty).alias(c) for c in
          ("matching_essential", "missing_essential", "matching_preferred", "missing_preferred")],
        pct(F.col("m_ess"), F.col("n_ess")).alias("essential_pct"),
        pct(F.col("m_pref"), F.col("n_pref")).alias("preferred_pct"),
        pct(F.col("m_ess") + F.col("m_pref"), F.col("n_ess") + F.col("n_pref")).alias("overall_pct"))


def missing_skills(users: DataFrame, required: DataFrame, held: DataFrame) -> DataFrame:
    """role's required skills (ordered) that the user does not hold, case-sensitive.

    ``required``: (role, pos, skill_name).  When nothing is missing the answer
    is three role-derived names, as in the reference's query path.
    """
    need = users.join(required, "role")
    held_keys = held.select("user_id", F.col("skill").alias("skill_name")).distinct().withColumn("held", F.lit(True))
    j = need.join(held_keys, ["user_id", "skill_name"], "left")
    agg = j.groupBy("user_id", "role").agg(_ordered_list(F.col("held").isNull()).alias("missing"))
    full = users.join(agg, ["user_id", "role"], "left")
    fallback = F.array(F.concat(F.col("role"), F.lit(" Best Practices")), F.lit("Advanced Tools"), F.lit("Industry Knowledge"))
    miss = F.coalesce(F.col("missing"), F.array().cast("array<string>"))
    return full.select("user_id", "role", F.when(F.size(miss) > 0, miss).otherwise(fallback).alias("missing_skills"))


def skill_semi(pairs: DataFrame, held: DataFrame, anti: bool = False) -> DataFrame:
    """Required (user, skill) pairs the user holds (semi) or lacks (anti), case-insensitive."""
    keys = held.select("user_id", F.lower("skill").alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    p = pairs.withColumn("_k", F.lower("skill"))
    return p.join(keys, ["user_id", "_k"], "left_anti" if anti else "left_semi").drop("_k")
