"""Provider rules as tables, and what reads them: one ordered-rule function for Spark, one for SQL.

Each provider spells duration, language, level and prerequisites its own way.
A table row says what a text must match and what it then means; the first row
that matches decides.  The Spark columns and the DuckDB twins are both made
from these rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider level label (trimmed, lower case) -> catalogue label.
LEVELS = {
    "udemy": ((r"\Abeginner", "Beginner"), (r"\Aintermediate", "Intermediate"), (r"\Aexpert", "Advanced"), (r"\Aall", "All Levels")),
    "udacity": ((r"\Abeginner\z", "Beginner"), (r"\Aintermediate\z", "Intermediate"), (r"\Aadvanced\z", "Advanced"),
                (r"\Adiscovery\z", "All Levels"), (r"\Afluency\z", "Fluency")),
    "edx": ((r"\Abeginner\z", "Beginner"), (r"\Aintermediate\z", "Intermediate"), (r"\Aadvanced\z", "Advanced")),
}
OTHER_LEVEL = "Other"

# Catalogue label (lower case) -> bucket of the recommender, and of the transition plan.
BUCKETS = (("advanced", "ADVANCED"), (r"\A(intermediate|fluency|all levels)\z", "INTERMEDIATE"), ("beginner", "BEGINNER"))
OTHER_BUCKET = "UNKNOWN"
TRANSITION_BUCKETS = (("beginner", "BEGINNER"), ("intermediate", "INTERMEDIATE"), ("advanced", "ADVANCED"), ("(?s)all.*level", "ALL_LEVELS"))
OTHER_TRANSITION_BUCKET = "ADVANCED"

# What the number in a duration counts, and its hours as (times, divided by).
NUMBERS = {"udemy": "[0-9]+([.][0-9]+)?", "udacity": "[0-9]+", "edx": "[0-9]+"}
UNITS = {
    "udemy": (("hour", "hours"), ("min", "minutes"), ("question", "questions")),
    "udacity": ((r"(?s)\AP.*M\z", "months"), (r"(?s)\AP.*W\z", "weeks"), (r"(?s)\APT.*H\z", "hours")),  # PT30M counts as months
}
OTHER_UNIT = {"udemy": "hours", "udacity": "unknown"}
HOURS = {
    "udemy": (("total hour", (1, 1)), ("total min", (1, 60)), ("question", (1, 60))),
    "udacity": ((r"(?s)\AP.*M\z", (730, 1)), (r"(?s)\AP.*W\z", (168, 1)), (r"(?s)\APT.*H\z", (1, 1))),
    "edx": (("week", (168, 1)),),
}

# What marks an English course, and which texts say that nothing is required.
ENGLISH = {"udemy": "English", "udacity": r"\Aen\z", "edx": r"\Aen\z"}
NO_PREREQUISITES = {"udemy": ("No prerequisites required",), "udacity": ("",), "edx": ("NOT FOUND", "NONE", "")}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decide(text: Column, rules, other) -> Column:
    """The value of the first rule whose pattern is found in ``text``; ``other`` (a value or None) if there is none or no text."""
    out = F.lit(other)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def decide_sql(text: str, rules, other: str | None, value=quoted) -> str:
    rows = " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {value(v)}" for p, v in rules)
    return f"CASE {rows} ELSE {'NULL' if other is None else quoted(other)} END"


def number_sql(text: str, provider: str) -> str:
    return f"nullif(regexp_extract({text}, {quoted(NUMBERS[provider])}, 0), '')"


def level_sql(text: str, provider: str) -> str:
    return decide_sql(f"lower(trim({text}))", LEVELS[provider], OTHER_LEVEL)


def bucket_sql(text: str) -> str:
    return decide_sql(f"lower({text})", BUCKETS, OTHER_BUCKET)


def transition_bucket_sql(text: str) -> str:
    return decide_sql(f"lower({text})", TRANSITION_BUCKETS, OTHER_TRANSITION_BUCKET)


def duration_sql(text: str, provider: str) -> str:
    label = f"{number_sql(text, provider)} || ' ' || {decide_sql(text, UNITS[provider], OTHER_UNIT[provider])}"
    return f"CASE WHEN {text} IS NULL THEN 'unknown' ELSE {label} END" if provider == "udemy" else label


def hours_sql(text: str, provider: str) -> str:
    n = f"TRY_CAST({number_sql(text, provider)} AS DOUBLE)"
    return decide_sql(text, HOURS[provider], None, lambda x: f"{n} * {x[0]} / {x[1]}")


def language_sql(text: str, provider: str) -> str:
    return decide_sql(text, ((ENGLISH[provider], "ENGLISH"),), "OTHERS")


def prerequisite_mark_sql(text: str, provider: str) -> str:
    """The text in the form in which it is compared with NO_PREREQUISITES."""
    return {"udemy": f"trim({text})", "udacity": text, "edx": f"upper(replace({text}, '.', ''))"}[provider]


def has_prerequisites_sql(text: str, provider: str) -> str:
    none = ", ".join(map(quoted, NO_PREREQUISITES[provider]))
    return f"coalesce({prerequisite_mark_sql(text, provider)} NOT IN ({none}), FALSE)"
