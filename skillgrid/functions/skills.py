"""Column -> Column skill operators.

Skill lists are arrays of strings; everything is written with higher-order
array functions (``filter``, ``transform``, ``exists``) so a row is processed
inside one codegen'd projection, with no explode/shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, _col

# ---- Fixed values: skill dictionary, in the reference's order -------------
# Category -> skills.  ``C\+\+`` is kept as written (a regex with escaped plus
# signs, which is also the reported skill name); ``Node.js`` keeps its dot as
# a regex wildcard.
SKILL_DICTIONARY = (
    ("Programming Languages", (
        "Python", "Java", "JavaScript", "C\\+\\+", "C#", "Ruby", "PHP", "Swift", "Kotlin",
        "TypeScript", "Go", "Rust", "Scala", "Perl", "R", "MATLAB")),
    ("Web Development", (
        "HTML", "CSS", "React", "Angular", "Vue", "Node.js", "Express", "Django", "Flask",
        "Spring Boot", "ASP.NET", "jQuery", "Bootstrap", "Tailwind", "WordPress")),
    ("Databases", (
        "SQL", "MySQL", "PostgreSQL", "MongoDB", "Oracle", "SQLite", "Redis", "Cassandra",
        "DynamoDB", "Elasticsearch", "MariaDB", "Firebase")),
    ("Cloud & DevOps", (
        "AWS", "Azure", "Google Cloud", "Docker", "Kubernetes", "Jenkins", "Git", "GitHub",
        "CI/CD", "Terraform", "Ansible", "Chef", "Puppet", "Nginx", "Apache")),
    ("Data Science", (
        "Machine Learning", "Deep Learning", "NLP", "Computer Vision", "Data Analysis",
        "Pandas", "NumPy", "SciPy", "Scikit-learn", "TensorFlow", "PyTorch", "Keras",
        "Data Visualization", "Tableau", "Power BI", "Statistics")),
    ("Business Skills", (
        "Project Management", "Product Management", "Agile", "Scrum", "Leadership",
        "Communication", "Presentation", "Negotiation", "Customer Service", "Sales",
        "Marketing", "Business Analysis", "Strategic Planning")),
)

# Technology names matched case-sensitively by the section extractor.
TECH_NAMES = (
    "Python", "Java", "JavaScript", "C\\+\\+", "SQL", "HTML", "CSS", "AWS", "Azure", "Docker",
    "Kubernetes", "Git", "React", "Angular", "Vue", "Node\\.js", "PHP", "Ruby", "Swift", "Go",
    "Rust", "MongoDB", "MySQL", "PostgreSQL", "TensorFlow", "PyTorch", "Pandas", "NumPy",
)

# Substrings that disqualify a scraped skill label.
SKILL_STOPLIST = (
    "learn", "search", "popular", "business", "trending", "view", "results", "better",
    "futures", "international", "women", "day", "code", "close", "site", "banner",
)


def dictionary_entries():
    """(position, category, skill) in dictionary order."""
    out = []
    for category, skills in SKILL_DICTIONARY:
        for s in skills:
            out.append((len(out), category, s))
    return out


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def boundary_pattern(skill: str) -> str:
    r"""``\bskill\b`` spelled without look-around so Java and RE2 agree.

    ``\b`` before a word character needs a non-word (or start) before it; before
    a non-word character it needs a word character.  Likewise at the end, which
    is why ``C\+\+`` only matches when a letter follows the second plus.
    """
    first = skill.lstrip("\\")[:1]
    last = skill[-1:]
    left = r"(^|[^\p{L}\p{N}_])" if _is_word(first) else WORD
    right = r"($|[^\p{L}\p{N}_])" if _is_word(last) else WORD
    return "(?i)" + left + skill + right


def _right_boundary_lookahead(skill: str) -> str:
    return r"(?![\p{L}\p{N}_])" if _is_word(skill[-1:]) else r"(?=[\p{L}\p{N}_])"


def _is_plain_word(skill: str) -> bool:
    return all(_is_word(ch) for ch in skill)


def dictionary_regex(skills=None) -> str:
    """Dictionary skills as one case-insensitive alternation with look-around boundaries.

    Every skill starts with a word character, so one look-behind serves all;
    the right boundary sits inside each alternative so ``Java`` failing on
    ``JavaScript`` falls through to the longer alternative.  No two skills can
    match overlapping text at word boundaries, so one left-to-right pass finds
    exactly the skills the per-skill searches would.
    """
    skills = skills if skills is not None else [s for _, _, s in dictionary_entries()]
    alts = "|".join(f"(?:{s}){_right_boundary_lookahead(s)}" for s in skills)
    return r"(?i)(?<![\p{L}\p{N}_])(?:" + alts + ")"


def _canonical_key(skill: str) -> str:
    """Lower-case text a match of ``skill`` normalises to (wildcard dots kept as dots)."""
    return skill.replace("\\", "").lower()


def extract_dictionary_skills(text, low=None) -> Column:
    """Dictionary skills found in ``text``, in dictionary order, each once.

    * Skills made only of word characters (68 of 87) match exactly when a
      word token of the text equals them ignoring case: the text is split on
      non-word characters and intersected with the literal set (a hash lookup).
    * The other skills (spaces, ``+``, ``#``, ``/``, ``-``, wildcard dots) run
      as one look-around regex pass (measured cheaper than substring
      pre-checks for them).
    Matches are mapped to dictionary positions, sorted, and mapped back to names.
    """
    entries = dictionary_entries()
    t = _col(text)
    low = F.lower(t) if low is None else _col(low)
    words = [s for _, _, s in entries if _is_plain_word(s)]
    others = [s for _, _, s in entries if not _is_plain_word(s)]
    tokens = F.split(low, r"[^\p{L}\p{N}_]+")
    word_hits = F.array_intersect(tokens, F.array(*[F.lit(w.lower()) for w in words]))
    other_matches = F.regexp_extract_all(t, F.lit(dictionary_regex(others)), 0)
    wild = [(_canonical_key(s), _canonical_key(s).replace(".", "_")) for s in others if "." in s and "\\." not in s]

    def norm(m):
        lm = F.lower(m)
        expr = None
        for key, like in wild:
            expr = F.when(lm.like(like), F.lit(key)) if expr is None else expr.when(lm.like(like), F.lit(key))
        return expr.otherwise(lm) if expr is not None else lm

    pos_map = F.create_map(*[x for pos, _, s in entries for x in (F.lit(_canonical_key(s)), F.lit(pos))])
    names = F.array(*[F.lit(s) for _, _, s in entries])
    keys = F.concat(word_hits, F.transform(other_matches, norm))
    positions = F.filter(F.transform(keys, lambda k: F.element_at(pos_map, k)), lambda p: p.isNotNull())
    return F.transform(F.array_sort(F.array_distinct(positions)), lambda p: F.element_at(names, p + 1))


def skill_list_parse(c, k: int = 5) -> Column:
    """Comma list -> trimmed, non-empty, unbalanced parenthesis removed, first k."""
    parts = F.transform(F.split(_col(c), ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    parts = F.filter(parts, lambda s: s != "")

    def fix(s):
        opened = F.instr(s, "(") > 0
        closed = F.instr(s, ")") > 0
        s1 = F.when(opened & ~closed, F.replace(s, F.lit("("), F.lit(""))).otherwise(s)
        return F.when((F.instr(s1, ")") > 0) & ~(F.instr(s1, "(") > 0),
                      F.replace(s1, F.lit(")"), F.lit(""))).otherwise(s1)

    return F.slice(F.transform(parts, fix), 1, k)


def skill_token_sanitize(arr, k: int = 3) -> Column:
    """Drop quotes and semicolons, strip, keep length > 2, first k."""
    cleaned = F.transform(F.filter(_col(arr), lambda s: s.isNotNull() & (F.length(s) > 0)),
                          lambda s: F.regexp_replace(F.translate(s, "'\";", ""), r"^\s+|\s+$", ""))
    return F.slice(F.filter(cleaned, lambda s: F.length(s) > 2), 1, k)


def _has_stopword(s: Column) -> Column:
    low = F.lower(s)
    cond = None
    for w in SKILL_STOPLIST:
        c = F.instr(low, w) > 0
        cond = c if cond is None else (cond | c)
    return cond


def skill_stoplist(arr) -> Column:
    """Keep labels with none of the stop substrings, join, empty -> ``Not found``."""
    kept = F.filter(F.transform(F.filter(_col(arr), lambda s: s.isNotNull() & (s != "")),
                                lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
                    lambda s: (s != "") & ~_has_stopword(s))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(F.lit("Not found"))


def skill_stoplist_text(c) -> Column:
    """N22 for the string form: split on commas first."""
    return skill_stoplist(F.split(_col(c), ","))


# ---- N25 section extraction ---------------------------------------------
# The patterns of a skills section and of the tokens in it.
SECTION_PATTERN = r"(?i)(?:skills|technologies|competencies|proficiencies|tools)(?:[^\n.]*):([^\n]+(?:\n[^\n•*]+)*)"
TOKEN_PATTERN = r"(?:[\s,;:|•]+)([A-Za-z0-9+#/\-._& ]{2,30}?)(?:[\s,;:|•]|$)"
TECH_PATTERN = r"\b(" + "|".join(TECH_NAMES) + r")\b"


def skill_section_extract(text) -> Column:
    """Tokens of ``skills:``-style sections plus technology names, ordered unique."""
    t = _col(text)
    sections = F.regexp_extract_all(t, F.lit(SECTION_PATTERN), 1)
    tokens = F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 1)))
    tokens = F.filter(F.transform(tokens, lambda s: F.trim(s)), lambda s: F.length(s) > 2)
    tech = F.regexp_extract_all(t, F.lit(TECH_PATTERN), 1)
    return F.array_distinct(F.concat(tokens, tech))


def json_list_from_text(text) -> Column:
    """First ``[...]`` parsed as a JSON array of strings; else one item per line."""
    t = _col(text)
    inner = F.regexp_extract(t, r"(?s)\[(.*?)\]", 1)
    has = t.rlike(r"(?s)\[.*?\]")
    parsed = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>")
    lines = F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r'^["\-,]+|["\-,]+$', ""))
    lines = F.filter(lines, lambda s: (s != "") & ~s.startswith("[") & ~s.startswith("]"))
    return F.when(has, parsed).otherwise(lines)


# ---- Role rules (J8 / N27 / N28 / C5) -------------------------------------
# Ordered rules "role contains any of these words" -> payload.
DEFAULT_SKILL_RULES = (
    (("system", "systems"), ("Systems Architecture", "Technical Documentation", "Performance Optimization",
                             "Project Management", "Integration Testing")),
    (("data", "scientist", "analyst"), ("Statistical Modeling", "Data Visualization", "SQL",
                                         "Machine Learning", "Data Engineering")),
    (("software", "developer"), ("System Design", "API Development", "Testing Practices",
                                 "DevOps Skills", "Code Optimization")),
    (("engineer",), ("System Architecture", "Technical Documentation", "Performance Optimization",
                     "Security Practices", "Project Management")),
)
DEFAULT_SKILLS_ELSE = ("Technical Skills", "Project Management", "Industry Knowledge",
                       "Communication", "Problem Solving")

ROLE_KEYWORD_RULES = (
    (("data",), ("data", "sql", "analysis", "analytics", "visualization", "python", "statistics")),
    (("system", "systems"), ("system", "architecture", "engineering", "integration", "design", "documentation")),
    (("software", "developer"), ("software", "development", "code", "programming", "api", "testing")),
    (("engineer",), ("engineering", "technical", "design", "architecture", "development", "system")),
)


def _contains_any(low: Column, words) -> Column:
    cond = None
    for w in words:
        c = F.instr(low, w) > 0
        cond = c if cond is None else (cond | c)
    return cond


def rule_lookup(role, rules, default) -> Column:
    """First rule whose words occur in lower(role) wins; compiled to one CASE."""
    low = F.lower(_col(role))
    expr = None
    for words, payload in rules:
        value = F.array(*[F.lit(x) for x in payload])
        expr = F.when(_contains_any(low, words), value) if expr is None else expr.when(_contains_any(low, words), value)
    dflt = F.array(*[F.lit(x) for x in default]) if default else F.array().cast("array<string>")
    return expr.otherwise(dflt)


def role_default_skills(role) -> Column:
    """Five default skills for a role text."""
    return rule_lookup(role, DEFAULT_SKILL_RULES, DEFAULT_SKILLS_ELSE)


def role_keywords(role) -> Column:
    return rule_lookup(role, ROLE_KEYWORD_RULES, ())


def skill_partition(skills, role, k: int = 8):
    """(transferable, other) skills, first k each; no keyword set -> all other."""
    kw = role_keywords(role)

    def relevant(s):
        return F.exists(kw, lambda w: F.instr(F.lower(s), w) > 0)

    arr = _col(skills)
    return (F.slice(F.filter(arr, relevant), 1, k), F.slice(F.filter(arr, lambda s: ~relevant(s)), 1, k))


# ---- U4 / U5 / A10 -------------------------------------------------------
def skill_intersect(required, held) -> Column:
    """U4: required skills held (case-insensitive), required spelling and order kept."""
    held_low = F.transform(_col(held), lambda s: F.lower(s))
    return F.filter(_col(required), lambda s: F.array_contains(held_low, F.lower(s)))


def skill_except(required, held, case_sensitive: bool = False) -> Column:
    """Required minus held; the fallback path compares case-sensitively."""
    if case_sensitive:
        h = _col(held)
        return F.filter(_col(required), lambda s: ~F.array_contains(h, s))
    held_low = F.transform(_col(held), lambda s: F.lower(s))
    return F.filter(_col(required), lambda s: ~F.array_contains(held_low, F.lower(s)))


def ordered_unique(arr) -> Column:
    """A10: order-preserving de-duplication."""
    return F.array_distinct(_col(arr))
