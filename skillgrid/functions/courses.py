"""Column -> Column operators for course attributes.

The providers' rules are tables in ``rules``; the functions here read them into
column expressions, so the whole row stays in one codegen'd projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import _col


def regexp_substr(c, pattern: str) -> Column:
    """First match of ``pattern`` or NULL (never the empty string)."""
    return F.regexp_substr(_col(c), F.lit(pattern))


# ---- N4 has_prereq, N6 language_flag -------------------------------------
def has_prereq(c, provider: str) -> Column:
    """False for NULL and for the provider's ways to say that nothing is required."""
    c = _col(c)
    mark = {"udemy": F.trim(c), "udacity": c, "edx": F.upper(F.replace(c, F.lit("."), F.lit("")))}[provider]
    return F.coalesce(~mark.isin(*R.NO_PREREQUISITES[provider]), F.lit(False))


def language_flag(c, provider: str) -> Column:
    """``ENGLISH`` / ``OTHERS``; NULL input is ``OTHERS`` under every rule."""
    return R.decide(_col(c), ((R.ENGLISH[provider], "ENGLISH"),), "OTHERS")


# ---- N7-N9 durations --------------------------------------------------------
def duration(c, provider: str) -> Column:
    """``<number> <unit>``; without a number NULL, and for a NULL Udemy text ``unknown``."""
    c = _col(c)
    label = F.concat(regexp_substr(c, R.NUMBERS[provider]), F.lit(" "), R.decide(c, R.UNITS[provider], R.OTHER_UNIT[provider]))
    return F.when(c.isNull(), "unknown").otherwise(label) if provider == "udemy" else label


def duration_hours(c, provider: str) -> Column:
    c = _col(c)
    n = regexp_substr(c, R.NUMBERS[provider]).try_cast("double")
    return R.decide(c, [(p, n * times / over) for p, (times, over) in R.HOURS[provider]], None)


# ---- N10 rating_sentinel -----------------------------------------------
def rating_sentinel(c) -> Column:
    """Unparsable, missing or ``Not found`` -> -1.0."""
    return F.coalesce(_col(c).cast("string").try_cast("double"), F.lit(-1.0))


# ---- N11-N13 levels ---------------------------------------------------------
def level_normalize(c, provider: str) -> Column:
    return R.decide(F.lower(F.trim(_col(c))), R.LEVELS[provider], R.OTHER_LEVEL)


def level_category(c) -> Column:
    """Catalogue label -> bucket of the recommender."""
    return R.decide(F.lower(_col(c)), R.BUCKETS, R.OTHER_BUCKET)


def level_category_transition(c) -> Column:
    """Second rule set: everything that is not recognised, NULL included, is ADVANCED."""
    return R.decide(F.lower(_col(c)), R.TRANSITION_BUCKETS, R.OTHER_TRANSITION_BUCKET)


# ---- N14 / N15 skill strings -------------------------------------------
def combine_skills(a, b) -> Column:
    """``a, b`` when both exist, the one that exists otherwise, trimmed."""
    a, b = _col(a), _col(b)
    sep = F.when(a.isNotNull() & b.isNotNull(), F.lit(", ")).otherwise(F.lit(""))
    return F.trim(F.concat(F.coalesce(a, F.lit("")), sep, F.coalesce(b, F.lit(""))))


def array_skills(a, b) -> Column:
    """NULL-safe concatenation of two label arrays joined with ``", "``."""
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(_col(a), empty), F.coalesce(_col(b), empty)), ", ")
