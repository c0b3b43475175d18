"""Deterministic enrichments (E1-E6) that stand in for hosted-model calls.

The reference asks a hosted model to fill skills, prerequisites, level and
language.  Here each fill is a deterministic Spark expression; the data work
around it (backlog selection, batching, never redoing finished rows) is the
same.  All expressions are map-side: no shuffle per enrichment.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skills import extract_dictionary_skills
from ..functions.text import _col

DEFAULT_PREREQUISITES = "No prerequisites required"
PREREQ_PATTERN = r"(?i)(?:prerequisites?|requires|required)\s*:?\s+([^.\n]+)"

# Fixed keyword lists for the level vote (ours; the reference asks a model).
LEVEL_KEYWORDS = (
    ("Beginner", ("intro", "beginner", "basic", "fundamental", "foundation", "first steps")),
    ("Intermediate", ("intermediate", "practical", "applied", "hands-on")),
    ("Advanced", ("advanced", "expert", "mastery", "professional", "in-depth")),
)

# Fixed stop-word lists per language for E4 (ours; the reference asks a model).
LANGUAGE_STOPWORDS = (
    ("English", ("the", "and", "of", "to", "is", "in", "that", "it", "with", "for")),
    ("German", ("der", "die", "und", "das", "nicht", "ist", "ich", "mit", "sich", "auf")),
    ("French", ("le", "la", "les", "et", "des", "est", "une", "dans", "pour", "qui")),
    ("Spanish", ("el", "los", "las", "y", "que", "del", "por", "una", "con", "es")),
)


def course_text(title, body) -> Column:
    return F.concat(_col(title), F.lit(". "), _col(body))


def with_course_text(df: DataFrame, title: str, body: str, need=None,
                     text_col: str = "_ctext", low_col: str = "_clow") -> DataFrame:
    """Materialise ``title. body`` and its lower case once (only where ``need`` holds).

    Later enrichments reference these columns many times; keeping them as
    separate projections stops Catalyst from inlining the text expression into
    every reference (which would blow up generated code).
    """
    txt = course_text(title, body)
    if need is not None:
        txt = F.when(need, txt)
    return df.withColumn(text_col, txt).withColumn(low_col, F.lower(F.col(text_col)))


def infer_skills(text, low=None) -> Column:
    """E1 (first half): dictionary skills found in the course text, as an array."""
    return extract_dictionary_skills(text, low)


def skills_text(found) -> Column:
    """E1 (second half): array -> ``", "``-joined string; none found -> NULL."""
    found = _col(found)
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def infer_prerequisites(text) -> Column:
    """The phrase after ``prerequisite(s)`` / ``requires``; else the default phrase."""
    t = _col(text)
    phrase = F.nullif(F.trim(F.regexp_extract(t, PREREQ_PATTERN, 1)), F.lit(""))
    return F.coalesce(phrase, F.lit(DEFAULT_PREREQUISITES))


def _occurrences(low: Column, word: str) -> Column:
    return (F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)


def infer_level(low) -> Column:
    """Keyword vote over the lower-cased course text; ties go to the easier level; no hit -> Discovery."""
    low = _col(low)
    scores = []
    for label, words in LEVEL_KEYWORDS:
        s = None
        for w in words:
            s = _occurrences(low, w) if s is None else s + _occurrences(low, w)
        scores.append((label, s))
    (b_l, b), (i_l, i), (a_l, a) = scores
    return (F.when((b + i + a).isNull() | ((b + i + a) == 0), F.lit("Discovery"))
            .when((b >= i) & (b >= a), F.lit(b_l))
            .when(i >= a, F.lit(i_l))
            .otherwise(F.lit(a_l)))


def tokenize_letters(text) -> Column:
    """Lower-cased runs of letters (the token stream the language vote counts)."""
    return F.split(F.lower(_col(text)), r"[^\p{L}]+")


def language_hits(tokens) -> list[tuple[str, Column]]:
    """Per language, how many of ``tokens`` are its stop words (map-side).

    Ten-word literal lists scanned with ``array_contains`` measured faster than
    a literal map lookup per token.
    """
    tokens = _col(tokens)
    out = []
    for lang, words in LANGUAGE_STOPWORDS:
        stop = F.array(*[F.lit(w) for w in words])
        out.append((lang, F.size(F.filter(tokens, lambda t: F.array_contains(stop, t)))))
    return out


def detect_language(tokens) -> Column:
    """Language with the most stop-word hits; ties by list order; none -> NULL.

    ``tokens`` should be a materialised ``tokenize_letters`` column.
    """
    hits = language_hits(tokens)
    best = None
    for lang, h in hits:
        others = [o for l2, o in hits if l2 != lang]
        earlier = [o for l2, o in hits[: [x for x, _ in hits].index(lang)]]
        cond = h > 0
        for o in others:
            cond = cond & (h >= o)
        for o in earlier:
            cond = cond & (h > o)
        best = F.when(cond, F.lit(lang)) if best is None else best.when(cond, F.lit(lang))
    return best


def fill_backlog(df: DataFrame, key: str, target: str, source_cols, derive, done: DataFrame | None = None,
                 batch_width: int | None = None) -> DataFrame:
    """Fill ``target`` only for rows still lacking it.

    * rows with ``target`` NULL and every input present form the backlog (P3);
    * rows whose key is already in ``done`` are skipped (incremental, rerun-safe);
    * ``batch_width`` adds the restart unit ``batch_id = floor(key / width)``
      instead of issuing one job per id range.
    """
    ready = None
    for c in source_cols:
        ready = F.col(c).isNotNull() if ready is None else ready & F.col(c).isNotNull()
    backlog = df.filter(F.col(target).isNull() & ready)
    if done is not None:
        backlog = backlog.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    out = backlog.withColumn(target, derive)
    if batch_width:
        out = out.withColumn("batch_id", F.floor(F.col(key) / F.lit(batch_width)).cast("bigint"))
    return out


def variant_compare(df: DataFrame, candidates: dict, choose: str, out_col: str) -> DataFrame:
    """Compute several candidate enrichments side by side, keep one, drop the rest."""
    for name, expr in candidates.items():
        df = df.withColumn(name, expr)
    df = df.withColumn(out_col, F.col(choose))
    return df.drop(*[n for n in candidates if n != out_col])


class BacklogRun:
    """E5: id ranges of a backlog, each derived and committed once, below one folder of the shared store.

    Ranges are done in order, in jobs of growing size: ``EQUAL`` jobs of one
    range, then as many of ``GROWTH`` times the ranges, and so on, so that the
    number of jobs grows with the logarithm of the number of ranges.  A job's
    rows go to a folder of its own; then its ledger entry, which names the
    folder and its ranges, is created under the next free number.  A runner
    that finds the number taken leaves out the ranges that others have
    committed meanwhile.  A run that was broken off goes on with the first
    range in no entry, and what it left half-written is in none.  ``limit``
    ends a run after that many ranges.
    """

    EQUAL, GROWTH = 3, 4

    def __init__(self, spark, path: str, key: str, width: int):
        from ..sources.keyed import SharedFolder
        self.spark, self.path, self.key, self.width = spark, path.rstrip("/"), key, width
        self.ledger = SharedFolder(spark, f"{self.path}/ledger")

    def _entries(self) -> list[dict]:
        return [json.loads(self.ledger.read(n)) for n in self.ledger.names() if n.endswith(".json") and not n.startswith(".")]

    def committed(self) -> dict[int, str]:
        """Range number -> folder."""
        return {b: e["folder"] for e in self._entries() for b in e["ranges"]}

    def _commit(self, ranges: list[int], folder: str) -> None:
        while True:
            entries = self._entries()
            held = {b for e in entries for b in e["ranges"]}
            mine = [b for b in ranges if b not in held]
            if not mine:
                return
            if len(mine) < len(ranges):
                rest = f"ranges/{uuid.uuid4().hex}"
                self.spark.read.parquet(f"{self.path}/{folder}").filter(F.col("batch_id").isin(mine)).write.parquet(f"{self.path}/{rest}")
                ranges, folder = mine, rest
            if self.ledger.put_if_absent(f"{len(entries):012d}.json", json.dumps({"folder": folder, "ranges": ranges})):
                return

    def run(self, df: DataFrame, derive, limit: int | None = None) -> int:
        """Derive the open ranges of ``df`` in order (``derive``: rows of some ranges -> result rows with their key); returns how many were done.

        The driver sees one number per range; the ends of a job's ranges reach
        the scan.  Null keys belong to no range.
        """
        number = F.floor(F.col(self.key) / F.lit(self.width)).cast("long")
        held = self.committed()
        ranges = sorted(r.b for r in df.filter(F.col(self.key).isNotNull()).select(number.alias("b")).distinct().collect() if r.b not in held)
        ranges, done, jobs = ranges[:limit], 0, 0
        while done < len(ranges):
            some = ranges[done:done + self.GROWTH ** (jobs // self.EQUAL)]
            rows = df.filter((F.col(self.key) >= some[0] * self.width) & (F.col(self.key) < (some[-1] + 1) * self.width))
            if len(some) > 1:
                rows = rows.filter(number.isin(some))
            folder = f"ranges/{uuid.uuid4().hex}"
            derive(rows).withColumn("batch_id", number).write.parquet(f"{self.path}/{folder}")
            self._commit(some, folder)
            done, jobs = done + len(some), jobs + 1
        return len(ranges)

    def read(self) -> DataFrame | None:
        """The rows of all committed ranges; None before the first."""
        folders = [f"{self.path}/{f}" for f in sorted(set(self.committed().values()))]
        return self.spark.read.parquet(*folders) if folders else None
