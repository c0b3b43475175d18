"""Skill queries: dictionary extraction, set algebra, role rules, gap analysis, enrichment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import skills as S
from ..operators import enrich as E
from ..operators import skillgap as G
from ..operators.textmodel import TextClassifier
from . import fixtures as X
from .fixture_sql import (HELD, REQUIREMENTS, USER_ROLES, infer_level_sql, infer_prereq_sql, infer_skills_sql, q,
                          with_courses)
from ..session import scratch_path
from .registry import register


def _dict_sql(plain: bool) -> str:
    rows = ", ".join(f"({pos}, {q(cat)}, {q(skill)}, {q(skill.lower() if plain else S.boundary_pattern(skill))})"
                     for pos, cat, skill in S.dictionary_entries() if S._is_plain_word(skill) == plain)
    return f"(pos, category, skill, test) AS (VALUES {rows})"


@register("skill_dictionary_extract", f"""
WITH plain{_dict_sql(True)}, odd{_dict_sql(False)},
words AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM documents)
SELECT doc_id, pos, skill, category FROM words JOIN plain ON w = test
UNION ALL SELECT d.doc_id, pos, skill, category FROM documents d JOIN odd ON regexp_matches(d.text, test)""")
def skill_dictionary_extract(spark, sf_dir):
    """Every dictionary skill found in every document (word boundaries, any case), with category."""
    d = X._t(spark, sf_dir, "documents", "doc_id", "text")
    entries = S.dictionary_entries()
    pos_of = F.create_map(*[x for pos, _, s in entries for x in (F.lit(s), F.lit(pos))])
    cat_of = F.create_map(*[x for _, c, s in entries for x in (F.lit(s), F.lit(c))])
    found = d.select("doc_id", F.explode(S.extract_dictionary_skills("text")).alias("skill"))
    return found.select("doc_id", F.element_at(pos_of, F.col("skill")).alias("pos"), "skill",
                        F.element_at(cat_of, F.col("skill")).alias("category"))


def _section_sql() -> str:
    plain = [t for t in S.TECH_NAMES if "\\" not in t]
    plain_list = "[" + ", ".join(q(t) for t in plain) + "]"
    tech = (f"list_filter(list_transform(runs, lambda r, j: CASE "
            f"WHEN list_contains({plain_list}, r) THEN r "
            f"WHEN r = 'Node' AND runs[j + 1] = '.' AND runs[j + 2] = 'js' THEN 'Node.js' "
            f"WHEN r = 'C' AND runs[j + 1] = '++' AND regexp_matches(coalesce(runs[j + 2], ''), '^[\\p{{L}}\\p{{N}}_]') THEN 'C++' END), "
            f"lambda x: x IS NOT NULL)")
    tokens = (f"list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, {q(S.SECTION_PATTERN)}, 1), "
              f"lambda sec: regexp_extract_all(sec, {q(S.TOKEN_PATTERN)}, 1))), lambda t: trim(t)), lambda t: length(t) > 2)")
    return f"""
WITH r AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS runs FROM documents),
a AS (SELECT doc_id, list_concat({tokens}, {tech}) AS l FROM r)
SELECT doc_id, to_json(list_filter(l, lambda x, i: list_position(l, x) = i)) AS skills FROM a"""


@register("skill_section_extract", _section_sql())
def skill_section_extract(spark, sf_dir):
    """``skills:``-section tokens plus technology names per document (ordered, unique)."""
    d = X._t(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.to_json(S.skill_section_extract("text")).alias("skills"))


@register("json_list_from_text", r"""
WITH t AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'assistant' THEN 'Here is the list: ' || CAST(to_json(string_split(text, '. ')) AS VARCHAR) || chr(10) || 'Done.'
              ELSE text END AS reply
  FROM conversations
)
SELECT conv_id, turn, to_json(CASE
  WHEN regexp_matches(reply, '(?s)\[.*?\]') THEN
       CASE WHEN json_valid('[' || regexp_extract(reply, '(?s)\[(.*?)\]', 1) || ']')
            THEN from_json('[' || regexp_extract(reply, '(?s)\[(.*?)\]', 1) || ']', '["VARCHAR"]') END
  ELSE list_filter(list_transform(string_split(reply, chr(10)),
                     lambda l: trim(regexp_replace(l, '^\s+|\s+$', '', 'g'), '"-,')),
                   lambda l: l <> '' AND NOT starts_with(l, '[') AND NOT starts_with(l, ']'))
  END) AS items
FROM t""")
def json_list_from_text(spark, sf_dir):
    """Every conversation reply read as a skill list (first JSON array if present, else one item per line).

    Assistant replies embed their sentences as a JSON list, user turns stay
    plain text, so both branches run over the whole table.
    """
    c = X._t(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    reply = F.when(F.col("role") == "assistant",
                   F.concat(F.lit("Here is the list: "), F.to_json(F.split("text", r"\. ")), F.lit("\nDone.")))\
        .otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.to_json(S.json_list_from_text(reply)).alias("items"))


def _rules_sql(role: str, rules, default) -> str:
    parts = []
    for words, payload in rules:
        cond = " OR ".join(f"contains(lower({role}), {q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN [{', '.join(q(x) for x in payload)}]")
    dflt = f"[{', '.join(q(x) for x in default)}]" if default else "CAST([] AS VARCHAR[])"
    return "CASE " + " ".join(parts) + f" ELSE {dflt} END"


@register("role_default_skills", "WITH " + USER_ROLES + f"""
SELECT user_id, role, to_json({_rules_sql('role', S.DEFAULT_SKILL_RULES, S.DEFAULT_SKILLS_ELSE)}) AS default_skills
FROM user_roles""")
def role_default_skills(spark, sf_dir):
    """Five default skills per user's target role by ordered substring rules."""
    u = X.user_roles(spark, sf_dir)
    return u.select("user_id", "role", F.to_json(S.role_default_skills("role")).alias("default_skills"))


from .q_scalar import JOB_POSTINGS_SQL  # noqa: E402


@register("skill_partition", "WITH " + JOB_POSTINGS_SQL + f"""
, x AS (
  SELECT id, CASE id % 5 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Systems Engineer' WHEN 2 THEN 'Software Developer'
                         WHEN 3 THEN 'Mechanical Engineer' ELSE 'Nurse' END AS role,
         list_concat(coalesce(hard_skill_labels, []), list_transform(coalesce(soft_skill_labels, []), lambda s: lower(s) || ' design')) AS skills
  FROM job_postings
), k AS (SELECT id, role, skills, {_rules_sql('role', S.ROLE_KEYWORD_RULES, ())} AS kw FROM x)
SELECT id, role,
  to_json(list_filter(skills, lambda s: len(list_filter(kw, lambda w: contains(lower(s), w))) > 0)[1:8]) AS transferable,
  to_json(list_filter(skills, lambda s: len(list_filter(kw, lambda w: contains(lower(s), w))) = 0)[1:8]) AS other
FROM k""")
def skill_partition(spark, sf_dir):
    """A posting's skills split into role-relevant (transferable) and other, 8 each."""
    jp = X.job_postings(spark, sf_dir)
    skills = F.concat(F.coalesce("hard_skill_labels", F.array().cast("array<string>")),
                      F.transform(F.coalesce("soft_skill_labels", F.array().cast("array<string>")),
                                  lambda s: F.concat(F.lower(s), F.lit(" design"))))
    x = jp.select("id", X.role_of("id").alias("role"), skills.alias("skills"))
    tr, other = S.skill_partition(F.col("skills"), F.col("role"), 8)
    return x.select("id", "role", F.to_json(tr).alias("transferable"), F.to_json(other).alias("other"))


COURSE_SETS_SQL = """
, sets AS (
  SELECT id, list_concat(string_split(skills, ', '), ['SQL', 'Python']) AS req,
         list_filter(string_split(upper(course_name), ' '), lambda w: length(w) <= 6) AS held
  FROM courses WHERE skills IS NOT NULL
)"""


def _course_sets(spark, sf_dir):
    c = X.courses(spark, sf_dir).filter(F.col("skills").isNotNull())
    req = F.concat(F.split("skills", ", "), F.array(F.lit("SQL"), F.lit("Python")))
    held = F.filter(F.split(F.upper("course_name"), " "), lambda w: F.length(w) <= 6)
    return c.select("id", req.alias("req"), held.alias("held"))


@register("skill_intersect", with_courses() + COURSE_SETS_SQL + """
SELECT id, to_json(list_filter(req, lambda s: list_contains(list_transform(held, lambda h: lower(h)), lower(s)))) AS matched FROM sets""")
def skill_intersect(spark, sf_dir):
    """U4: required skills held, compared in lower case, required spelling and order kept."""
    return _course_sets(spark, sf_dir).select("id", F.to_json(S.skill_intersect("req", "held")).alias("matched"))


@register("skill_except", with_courses() + COURSE_SETS_SQL + """
SELECT id, to_json(list_filter(req, lambda s: NOT list_contains(list_transform(held, lambda h: lower(h)), lower(s)))) AS missing,
       to_json(list_filter(req, lambda s: NOT list_contains(held, s))) AS missing_case_sensitive FROM sets""")
def skill_except(spark, sf_dir):
    """Required minus held; case-insensitive and the fallback's case-sensitive form."""
    s = _course_sets(spark, sf_dir)
    return s.select("id", F.to_json(S.skill_except("req", "held")).alias("missing"),
                    F.to_json(S.skill_except("req", "held", case_sensitive=True)).alias("missing_case_sensitive"))


@register("ordered_unique", with_courses() + """
SELECT id, to_json(list_filter(arr, lambda x, i: list_position(arr, x) = i)) AS skills
FROM (SELECT id, list_concat(string_split(skills, ', '), string_split(lower(skills), ', '), string_split(skills, ', ')) AS arr
      FROM courses WHERE skills IS NOT NULL)""")
def ordered_unique(spark, sf_dir):
    """A10: order-preserving unique of a skill list."""
    c = X.courses(spark, sf_dir).filter(F.col("skills").isNotNull())
    arr = F.concat(F.split("skills", ", "), F.split(F.lower("skills"), ", "), F.split("skills", ", "))
    return c.select("id", F.to_json(S.ordered_unique(arr)).alias("skills"))


@register("role_requirements", "WITH " + REQUIREMENTS + """
SELECT role, bucket, pos, skill_name FROM rr""")
def role_requirements(spark, sf_dir):
    """Essential / preferred buckets per role, first five of each."""
    return G.role_requirements(X.requirement_rows(spark, sf_dir))


MATCH_SQL = "WITH " + ",".join([USER_ROLES, HELD, REQUIREMENTS]) + """
, need AS (SELECT u.user_id, u.role, r.bucket, r.pos, r.skill_name FROM user_roles u JOIN rr r ON r.role = u.role)
, hk AS (SELECT DISTINCT user_id, lower(skill) AS skill_key FROM held)
, j AS (SELECT n.*, hk.skill_key IS NOT NULL AS hit FROM need n LEFT JOIN hk ON hk.user_id = n.user_id AND hk.skill_key = lower(n.skill_name))
, agg AS (
  SELECT user_id, role,
    list(skill_name ORDER BY pos) FILTER (WHERE bucket = 'essential' AND hit) AS me,
    list(skill_name ORDER BY pos) FILTER (WHERE bucket = 'essential' AND NOT hit) AS xe,
    list(skill_name ORDER BY pos) FILTER (WHERE bucket = 'preferred' AND hit) AS mp,
    list(skill_name ORDER BY pos) FILTER (WHERE bucket = 'preferred' AND NOT hit) AS xp,
    count(*) FILTER (WHERE bucket = 'essential') AS n_ess, count(*) FILTER (WHERE bucket = 'preferred') AS n_pref,
    count(*) FILTER (WHERE bucket = 'essential' AND hit) AS m_ess, count(*) FILTER (WHERE bucket = 'preferred' AND hit) AS m_pref
  FROM j GROUP BY user_id, role
)
SELECT u.user_id, u.role,
  to_json(coalesce(me, CAST([] AS VARCHAR[]))) AS matching_essential, to_json(coalesce(xe, CAST([] AS VARCHAR[]))) AS missing_essential,
  to_json(coalesce(mp, CAST([] AS VARCHAR[]))) AS matching_preferred, to_json(coalesce(xp, CAST([] AS VARCHAR[]))) AS missing_preferred,
  CASE WHEN coalesce(n_ess, 0) > 0 THEN round_even(CAST(m_ess AS DOUBLE) / n_ess * 100.0, 1) ELSE 0.0 END AS essential_pct,
  CASE WHEN coalesce(n_pref, 0) > 0 THEN round_even(CAST(m_pref AS DOUBLE) / n_pref * 100.0, 1) ELSE 0.0 END AS preferred_pct,
  CASE WHEN coalesce(n_ess + n_pref, 0) > 0 THEN round_even(CAST(m_ess + m_pref AS DOUBLE) / (n_ess + n_pref) * 100.0, 1) ELSE 0.0 END AS overall_pct
FROM user_roles u LEFT JOIN agg a ON a.user_id = u.user_id AND a.role = u.role"""


def _match(spark, sf_dir):
    users = X.user_roles(spark, sf_dir)
    req = G.role_requirements(X.requirement_rows(spark, sf_dir))
    out = G.match_skills(users, req, X.held_skills(spark, sf_dir))
    return out.select("user_id", "role", *[F.to_json(c).alias(c) for c in
                                           ("matching_essential", "missing_essential", "matching_preferred", "missing_preferred")],
                      "essential_pct", "preferred_pct", "overall_pct")


@register("match_skills", MATCH_SQL)
def match_skills(spark, sf_dir):
    """C6 (U4 + U5 + A5): matched / missing essential and preferred skills and match percentages per user."""
    return _match(spark, sf_dir)


@register("match_percentages", "SELECT user_id, essential_pct, preferred_pct, overall_pct FROM (" + MATCH_SQL + ")")
def match_percentages(spark, sf_dir):
    """A5: essential / preferred / overall match percent, half-even to one decimal, empty -> 0."""
    return _match(spark, sf_dir).select("user_id", "essential_pct", "preferred_pct", "overall_pct")


REQ_PAIRS_SQL = "WITH " + ",".join([USER_ROLES, HELD, REQUIREMENTS]) + """
, pairs AS (SELECT u.user_id, r.skill_name AS skill FROM user_roles u JOIN rr r ON r.role = u.role)
, hk AS (SELECT DISTINCT user_id, lower(skill) AS k FROM held)"""


def _req_pairs(spark, sf_dir):
    req = G.role_requirements(X.requirement_rows(spark, sf_dir))
    return X.user_roles(spark, sf_dir).join(req, "role").select("user_id", F.col("skill_name").alias("skill"))


@register("skill_semi", REQ_PAIRS_SQL + """
SELECT p.user_id, p.skill FROM pairs p WHERE EXISTS (SELECT 1 FROM hk WHERE hk.user_id = p.user_id AND hk.k = lower(p.skill))""")
def skill_semi(spark, sf_dir):
    """J9 (semi): required (user, skill) pairs the user holds."""
    return G.skill_semi(_req_pairs(spark, sf_dir), X.held_skills(spark, sf_dir))


@register("skill_anti", REQ_PAIRS_SQL + """
SELECT p.user_id, p.skill FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM hk WHERE hk.user_id = p.user_id AND hk.k = lower(p.skill))""")
def skill_anti(spark, sf_dir):
    """J9 (anti): required (user, skill) pairs the user lacks."""
    return G.skill_semi(_req_pairs(spark, sf_dir), X.held_skills(spark, sf_dir), anti=True)


@register("missing_skills", "WITH " + ",".join([USER_ROLES, HELD, REQUIREMENTS]) + """
, need AS (SELECT u.user_id, u.role, r.pos + CASE WHEN r.bucket = 'essential' THEN 0 ELSE 100 END AS pos, r.skill_name
           FROM user_roles u JOIN rr r ON r.role = u.role)
, j AS (SELECT n.*, h.skill IS NULL AS miss FROM need n LEFT JOIN held h ON h.user_id = n.user_id AND h.skill = n.skill_name)
, agg AS (SELECT user_id, role, list(skill_name ORDER BY pos) FILTER (WHERE miss) AS m FROM j GROUP BY user_id, role)
SELECT u.user_id, u.role,
  to_json(CASE WHEN len(coalesce(m, CAST([] AS VARCHAR[]))) > 0 THEN m
               ELSE [u.role || ' Best Practices', 'Advanced Tools', 'Industry Knowledge'] END) AS missing_skills
FROM user_roles u LEFT JOIN agg a ON a.user_id = u.user_id AND a.role = u.role""")
def missing_skills(spark, sf_dir):
    """role's required skills the user lacks (case-sensitive); none missing -> role-derived names."""
    rr = G.role_requirements(X.requirement_rows(spark, sf_dir))
    req = rr.select("role", (F.col("pos") + F.when(F.col("bucket") == "essential", 0).otherwise(100)).alias("pos"),
                                    "skill_name")
    out = G.missing_skills(X.user_roles(spark, sf_dir), req, X.held_skills(spark, sf_dir))
    return out.select("user_id", "role", F.to_json("missing_skills").alias("missing_skills"))


# ---- enrichment (E1-E6) ----------------------------------------------------

@register("enrich_skills", with_courses() + f"""
SELECT id, {infer_skills_sql('course_name', 'description')} AS skills
FROM courses WHERE skills IS NULL AND description IS NOT NULL""")
def enrich_skills(spark, sf_dir):
    """E1 (+P3): skills derived from title + text for rows whose skills are missing."""
    c = X.courses(spark, sf_dir).filter(F.col("skills").isNull() & F.col("description").isNotNull())
    c = E.with_course_text(c, "course_name", "description")
    return c.select("id", E.skills_text(E.infer_skills("_ctext", "_clow")).alias("skills"))


@register("enrich_prereqs", with_courses() + f"""
SELECT id, {infer_prereq_sql('course_name', 'description')} AS prerequisites
FROM courses WHERE (prerequisites IS NULL OR trim(prerequisites) = '') AND description IS NOT NULL""")
def enrich_prereqs(spark, sf_dir):
    """Prerequisites phrase from the text, else the default phrase, where missing."""
    c = X.courses(spark, sf_dir)
    c = c.filter((F.col("prerequisites").isNull() | (F.trim("prerequisites") == "")) & F.col("description").isNotNull())
    c = E.with_course_text(c, "course_name", "description")
    return c.select("id", E.infer_prerequisites("_ctext").alias("prerequisites"))


@register("enrich_level", with_courses() + f"""
SELECT id, {infer_level_sql('course_name', 'description')} AS level FROM courses WHERE trim(level_raw) = ''""")
def enrich_level(spark, sf_dir):
    """Level keyword vote where the label is blank (a NULL label stays unfilled)."""
    c = E.with_course_text(X.courses(spark, sf_dir).filter(F.trim("level_raw") == ""), "course_name", "description")
    return c.select("id", E.infer_level("_clow").alias("level"))


def _lang_sql() -> str:
    hits = []
    for lang, words in E.LANGUAGE_STOPWORDS:
        lst = "[" + ", ".join(q(w) for w in words) + "]"
        hits.append((lang, f"len(list_filter(tok, lambda t: list_contains({lst}, t)))"))
    whens = []
    for i, (lang, h) in enumerate(hits):
        conds = [f"{h} > 0"] + [f"{h} >= {o}" for j, (_, o) in enumerate(hits) if j != i] + \
                [f"{h} > {o}" for j, (_, o) in enumerate(hits) if j < i]
        whens.append(f"WHEN {' AND '.join(conds)} THEN {q(lang)}")
    return "CASE " + " ".join(whens) + " END"


@register("detect_language", f"""
SELECT doc_id, lang, {_lang_sql()} AS detected
FROM (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS tok FROM documents)""")
def detect_language(spark, sf_dir):
    """Language of every document by stop-word hits (map-side, no shuffle)."""
    d = X._t(spark, sf_dir, "documents", "doc_id", "lang", "text").withColumn("tok", E.tokenize_letters("text"))
    return d.select("doc_id", "lang", E.detect_language("tok").alias("detected"))


@register("detect_language_fitted")
def detect_language_fitted(spark, sf_dir):
    """E4 by letter trigrams: naive Bayes fitted on up to 20,000 labelled documents, every document scored."""
    d = X._t(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return TextClassifier().fit(d, "text", "lang").score(d, "text", "detected").select("doc_id", "lang", "detected")


@register("enrich_level_fitted")
def enrich_level_fitted(spark, sf_dir):
    """E3 by words: naive Bayes fitted on up to 20,000 courses with a level, blank levels filled from the whole text."""
    c = E.with_course_text(X.courses(spark, sf_dir), "course_name", "description")
    named = c.filter(F.trim("level_raw") != "")
    model = TextClassifier(unit="words", n=1).fit(named, "_ctext", "level_raw")
    return model.score(c.filter(F.trim("level_raw") == "").select("id", "_ctext"), "_ctext", "level").select("id", "level")


@register("batched_backlog", with_courses() + f"""
SELECT id, CAST(floor(id / 100) AS BIGINT) AS batch_id, {infer_prereq_sql('course_name', 'description')} AS prerequisites
FROM courses
WHERE prerequisites IS NULL AND description IS NOT NULL
  AND id NOT IN (SELECT id FROM courses WHERE level_raw = 'All Levels')""")
def batched_backlog(spark, sf_dir):
    """E5 (+P5): fill the prerequisites backlog in id batches, skipping rows already in the target."""
    c = X.courses(spark, sf_dir)
    done = c.filter(F.col("level_raw") == "All Levels").select("id")
    c2 = E.with_course_text(c, "course_name", "description")
    out = E.fill_backlog(c2, "id", "prerequisites", ["description"], E.infer_prerequisites("_ctext"), done=done,
                         batch_width=100)
    return out.select("id", "batch_id", "prerequisites")


@register("backlog_ranges", with_courses() + f"""
SELECT id, CAST(floor(id / 250) AS BIGINT) AS batch_id, {infer_prereq_sql('course_name', 'description')} AS prerequisites
FROM courses WHERE prerequisites IS NULL AND description IS NOT NULL""")
def backlog_ranges(spark, sf_dir):
    """E5: the backlog in id ranges with a ledger; the first run ends after one range, the second goes on behind it."""
    c = X.courses(spark, sf_dir)
    run = E.BacklogRun(spark, scratch_path(spark, f"io/backlog-{uuid.uuid4().hex[:12]}"), "id", 250)

    def derive(rows):
        filled = E.fill_backlog(E.with_course_text(rows, "course_name", "description"), "id", "prerequisites", ["description"],
                                E.infer_prerequisites("_ctext"), batch_width=250)
        return filled.select("id", "prerequisites")

    run.run(c, derive, limit=1)
    run.run(c, derive)
    return run.read().select("id", "batch_id", "prerequisites")


@register("variant_compare", with_courses() + f"""
SELECT id, {infer_skills_sql('course_name', 'description')} AS skills FROM courses""")
def variant_compare(spark, sf_dir):
    """Two candidate skill enrichments side by side; the dictionary one is kept, the other dropped."""
    c = E.with_course_text(X.courses(spark, sf_dir), "course_name", "description")
    c = c.withColumn("_found", E.infer_skills("_ctext", "_clow"))
    cands = {"skills_dict": E.skills_text("_found"),
             "skills_sections": F.array_join(S.skill_section_extract("_ctext"), ", ")}
    return E.variant_compare(c, cands, "skills_dict", "skills").select("id", "skills")
