"""Recommendation queries: per-user course lists, backfill, transition plans, fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as R
from ..operators import windows as W
from . import fixtures as X
from .fixture_sql import USER_ROLES, q, with_catalog
from ..functions.rules import bucket_sql, transition_bucket_sql
from .q_relational import RATINGS_SQL, latest_ratings
from .registry import catalog, catalog_postings, register

TOK = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}]+'), lambda t: t <> '')"


def _template_sql(template: str, **parts) -> str:
    """SQL string expression for a query template with column placeholders."""
    import re
    out = []
    pieces = re.split(r"(\{\w+\})", template)
    for p in pieces:
        if p.startswith("{") and p.endswith("}"):
            out.append(parts[p[1:-1]])
        elif p:
            out.append(q(p))
    return " || ".join(out)


def _search_sql(queries_cte: str, n: int, p: str = "", where: str = "TRUE") -> str:
    """Brute-force TF-IDF of every query text against the catalogue (oracle side).

    ``queries_cte`` defines ``{p}queries(qid, qtext)``; the result is ``{p}hits(qid, id, score, rank)``.
    """
    return f""",
{queries_cte},
{p}qt AS (SELECT DISTINCT qid, unnest({TOK.format(x='qtext')}) AS term FROM {p}queries),
{p}docs AS (SELECT id, {TOK.format(x="concat_ws(' ', course_name, description, skills)")} AS tok FROM catalog WHERE {where}),
{p}nd AS (SELECT count(*) AS n FROM {p}docs),
{p}post AS (SELECT id, len(tok) AS doc_len, unnest(tok) AS term FROM {p}docs),
{p}tf AS (SELECT term, id, count(*) / any_value(doc_len) AS tf FROM {p}post WHERE term IN (SELECT term FROM {p}qt) GROUP BY term, id),
{p}w AS (SELECT term, ln((SELECT n FROM {p}nd) / count(*)) AS idf FROM {p}tf GROUP BY term),
{p}wp AS (SELECT term, id, tf * idf AS w FROM {p}tf JOIN {p}w USING (term) WHERE idf > 0),
{p}scored AS (
  SELECT qid, id, sum(w) AS score FROM {p}wp JOIN {p}qt USING (term) GROUP BY qid, id
  UNION ALL SELECT qid, id, 0.0 FROM (SELECT DISTINCT qid FROM {p}queries), (SELECT id FROM {p}docs)
),
{p}best AS (SELECT qid, id, max(score) AS score FROM {p}scored GROUP BY qid, id),
{p}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM {p}best)
         WHERE rank <= {n})"""


RECOMMEND_QUERIES = f"""
queries AS (
  SELECT u.user_id AS qid, {_template_sql(R.RECOMMEND_TEMPLATE, role='u.role', ratings=f"coalesce(rt.ratings, {q(R.DEFAULT_RATINGS)})")} AS qtext
  FROM user_roles u LEFT JOIN (
    SELECT user_id, string_agg(skill || ' (' || CAST(rating AS VARCHAR) || ')', ', ' ORDER BY skill, rating) AS ratings
    FROM latest GROUP BY user_id) rt ON rt.user_id = u.user_id
)"""

def _c1_sql(where: str = "TRUE") -> str:
    return with_catalog(USER_ROLES, RATINGS_SQL.strip()) + _search_sql(RECOMMEND_QUERIES, 20, where=where) + f""",
tagged AS (SELECT h.qid AS user_id, h.id, h.rank, c.course_name, c.level, c.platform, {bucket_sql('c.level')} AS level_category
           FROM hits h JOIN catalog c ON c.id = h.id),
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, level_category ORDER BY course_name, id) AS rn FROM tagged
         WHERE level_category IN ('BEGINNER', 'INTERMEDIATE', 'ADVANCED')) WHERE rn <= 2)"""


C1_BASE = _c1_sql()
# Binding of the gap queries: the first search does not see the advanced courses.
GAP_SQL = f"({bucket_sql('level')}) <> 'ADVANCED'"
C1_GAP = _c1_sql(GAP_SQL)


def _gap_recs(spark, sf_dir, **more):
    from ..functions.courses import level_category
    seen = catalog(spark, sf_dir).filter(level_category("level") != "ADVANCED")
    rt = R.ratings_text(latest_ratings(spark, sf_dir))
    return R.recommend_alike(X.user_roles(spark, sf_dir), rt, seen, **more)


def _recs(spark, sf_dir, **more):
    """(Alike, recommendations, searched): C1 of the stand-ins of users that are alike."""
    users = X.user_roles(spark, sf_dir)
    rt = R.ratings_text(latest_ratings(spark, sf_dir))
    return R.recommend_alike(users, rt, catalog(spark, sf_dir), postings=catalog_postings(spark, sf_dir), **more)


@register("recommend_courses", C1_BASE + "\nSELECT user_id, level_category, rn, id, course_name FROM recs")
def recommend_courses(spark, sf_dir):
    """C1 (+N12, W1, T3): every user's search (limit 20) -> level buckets -> two courses per bucket."""
    alike, recs, _ = _recs(spark, sf_dir, write=False)          # read once, so nothing is written between
    rows = alike.of(recs.select("user_id", "level_category", "rn", "id", "course_name"), write=False)
    return W.order_by_level(rows, "level_category", "rn", key="user_id")


@register("text_search_users", C1_BASE + "\nSELECT user_id, rank, id FROM tagged")
def text_search_users(spark, sf_dir):
    """V4 as used by C1: top 20 catalogue courses for every user's query text."""
    alike, _, tagged = _recs(spark, sf_dir)
    return alike.of(tagged.select("user_id", "rank", "id"))


@register("missing_levels", C1_BASE + """,
dims AS (SELECT user_id, unnest(['BEGINNER', 'INTERMEDIATE', 'ADVANCED']) AS level_category FROM user_roles)
SELECT user_id, level_category FROM dims
WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.user_id = dims.user_id AND r.level_category = dims.level_category)""")
def missing_levels(spark, sf_dir):
    """Levels with no recommended course, per user."""
    alike, recs, _ = _recs(spark, sf_dir)
    return alike.of(R.missing_levels(recs, alike.parts["users"]))


@register("level_counts_per_user", C1_BASE + "\nSELECT user_id, level_category, count(*) AS n FROM tagged GROUP BY 1, 2")
def level_counts_per_user(spark, sf_dir):
    """A3 (per user): searched courses per level bucket."""
    alike, _, tagged = _recs(spark, sf_dir)
    return alike.of(tagged.groupBy("user_id", "level_category").agg(F.count(F.lit(1)).alias("n")))


def _adv_sql(base: str) -> str:
    return base + _search_sql(f"""
adv_queries AS (SELECT DISTINCT role AS qid, {_template_sql(R.ADVANCED_TEMPLATE, role='role')} AS qtext FROM user_roles)""", 4, "adv_") + """,
high AS (SELECT user_id FROM latest GROUP BY user_id HAVING count(*) FILTER (WHERE rating >= 3) > 0),
need AS (SELECT u.user_id, u.role FROM user_roles u
         WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.user_id = u.user_id AND r.level_category = 'ADVANCED')
           AND u.user_id IN (SELECT user_id FROM high)),
adv AS (SELECT * FROM (
          SELECT h.qid AS role, c.id, c.course_name, c.level, c.platform,
                 row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) AS rn
          FROM adv_hits h JOIN catalog c ON c.id = h.id WHERE lower(c.level) LIKE '%advanced%') WHERE rn <= 2),
combined AS (
  SELECT r.user_id, u.role, r.id, r.course_name, r.level, r.platform, r.level_category, r.rn
  FROM recs r JOIN user_roles u ON u.user_id = r.user_id
  UNION ALL
  SELECT n.user_id, n.role, a.id, a.course_name, a.level, a.platform, 'ADVANCED', a.rn FROM need n JOIN adv a ON a.role = n.role
)"""


ADV_SQL, ADV_GAP_SQL = _adv_sql(C1_BASE), _adv_sql(C1_GAP)


def _with_backfill(spark, sf_dir, search):
    lr = latest_ratings(spark, sf_dir)
    high = lr.groupBy("user_id").agg(F.count_if(F.col("rating") >= 3).alias("high_rated"))
    # which users have a high rating is all that C2 asks for
    rated = high.filter(F.col("high_rated") > 0).select("user_id", F.lit(1).alias("high_rated"))
    alike, recs, _ = search(spark, sf_dir, rated=rated)
    users = alike.parts["users"]
    return alike.of(R.advanced_backfill(recs.join(users, "user_id"), users, alike.parts["rated"], catalog(spark, sf_dir),
                                        postings=catalog_postings(spark, sf_dir)))


@register("advanced_backfill", ADV_SQL + "\nSELECT * FROM combined")
def advanced_backfill(spark, sf_dir):
    """C2 + U2: users lacking ADVANCED with a rating >= 3 get up to two advanced courses appended."""
    return _with_backfill(spark, sf_dir, _recs)


@register("missing_levels_gap", C1_GAP + """,
dims AS (SELECT user_id, unnest(['BEGINNER', 'INTERMEDIATE', 'ADVANCED']) AS level_category FROM user_roles)
SELECT user_id, level_category FROM dims
WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.user_id = dims.user_id AND r.level_category = dims.level_category)""")
def missing_levels_gap(spark, sf_dir):
    """A6 where the first search lacks courses of some levels."""
    alike, recs, _ = _gap_recs(spark, sf_dir)
    return alike.of(R.missing_levels(recs, alike.parts["users"]))


@register("advanced_backfill_gap", ADV_GAP_SQL + "\nSELECT * FROM combined")
def advanced_backfill_gap(spark, sf_dir):
    """C2 + U2 where the first search lacks advanced courses: rows are appended."""
    return _with_backfill(spark, sf_dir, _gap_recs)


def _missing(spark, sf_dir):
    from ..operators import skillgap as G
    rr = G.role_requirements(X.requirement_rows(spark, sf_dir))
    req = rr.select("role", (F.col("pos") + F.when(F.col("bucket") == "essential", 0).otherwise(100)).alias("pos"),
                                    "skill_name")
    return G.missing_skills(X.user_roles(spark, sf_dir), req, X.held_skills(spark, sf_dir))


def _transition(spark, sf_dir, null_rule: bool = False):
    """(Alike, courses): C3 of the stand-ins of users that are alike."""
    return R.transition_alike(X.user_roles(spark, sf_dir), _missing(spark, sf_dir), catalog(spark, sf_dir),
                              postings=catalog_postings(spark, sf_dir), null_rule=null_rule)


@register("transition_null_rule", None)
def transition_null_rule(spark, sf_dir):
    """C3 + C5 with the NULL rule: an unreadable ALL_LEVELS course puts the fallback courses in the list's place."""
    alike, courses = _transition(spark, sf_dir, null_rule=True)
    return alike.of(courses.select("user_id", "rank", "id", "level_category"))


@register("transition_courses", None)
def transition_courses(spark, sf_dir):
    """C3 (+N13, N21): search with missing skills (limit 6), ALL_LEVELS spread per user; missing texts read as empty."""
    alike, courses = _transition(spark, sf_dir)
    return alike.of(courses.select("user_id", "rank", "id", "level_category"))


@register("need_order", None)
def need_order(spark, sf_dir):
    """Least / most populated level per user after spreading."""
    alike, courses = _transition(spark, sf_dir)
    return alike.of(R.need_order(courses))


@register("plan_rebalance")
def plan_rebalance(spark, sf_dir):
    """C4: empty levels filled from neighbours, two per level with month windows."""
    alike, courses = _transition(spark, sf_dir)
    return alike.of(R.plan_rebalance(courses).select("user_id", "level_category", "slot", "months", "id"))


@register("plan_table")
def plan_table(spark, sf_dir):
    """The data behind the rendered plan, skills as a list."""
    alike, courses = _transition(spark, sf_dir)
    p = R.plan_table(R.plan_rebalance(courses))
    return alike.of(p.select("user_id", "level_category", "slot", "months", "course_name", "platform",
                             F.to_json("skill_list").alias("skills")))


@register("fallback_courses", None)
def fallback_courses(spark, sf_dir):
    """C5 (+J8): two literal courses per role class for users whose transition search finds nothing that can be folded."""
    users = X.user_roles(spark, sf_dir)
    alike, found = R.transition_found(users, _missing(spark, sf_dir), catalog(spark, sf_dir), postings=catalog_postings(spark, sf_dir))
    lonely = R.fallback_courses(alike.parts["users"], R.transition_served(found))
    return alike.of(lonely.select("user_id", "role", "slot", "course_name"))


@register("skill_levels_profile", "WITH " + RATINGS_SQL.strip() + """
SELECT user_id, skill, rating, CASE WHEN rating <= 2 THEN 'Prioritize' WHEN rating = 3 THEN 'Focus area' END AS priority FROM latest""")
def skill_levels_profile(spark, sf_dir):
    """C9 + N29: latest rating per user and skill with its priority tag."""
    return R.skill_levels_profile(latest_ratings(spark, sf_dir))


@register("rating_validate", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS raw,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 1 AND 5, FALSE) AS valid FROM events""")
def rating_validate(spark, sf_dir):
    """Integer 1..5 accepted, anything else rejected."""
    e = X._t(spark, sf_dir, "events", "event_id", "props")
    raw = F.get_json_object("props", "$.k").try_cast("int")
    return e.select("event_id", raw.alias("raw"), F.coalesce(raw.between(1, 5), F.lit(False)).alias("valid"))


@register("format_ratings", "WITH " + RATINGS_SQL.strip() + """
SELECT user_id, string_agg(skill || ' (' || CAST(rating AS VARCHAR) || ')', ', ' ORDER BY skill, rating) AS ratings
FROM latest GROUP BY user_id""")
def format_ratings(spark, sf_dir):
    """Ratings map -> ``skill (n), skill (n)``."""
    return R.ratings_text(latest_ratings(spark, sf_dir))


@register("role_to_catalog", with_catalog(USER_ROLES) + f""",
lp AS (SELECT o_custkey AS user_id, o_orderpriority AS role FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
rr AS (SELECT role, id, course_name FROM (
         SELECT lp2.role, c.id, c.course_name, row_number() OVER (PARTITION BY lp2.role ORDER BY c.course_name, c.id) AS rn
         FROM (SELECT DISTINCT o_orderpriority AS role FROM orders) lp2
         JOIN catalog c ON ({bucket_sql('c.level')}) =
              CASE WHEN lp2.role LIKE '1%' OR lp2.role LIKE '2%' THEN 'ADVANCED' WHEN lp2.role LIKE '3%' THEN 'INTERMEDIATE' ELSE 'BEGINNER' END)
       WHERE rn <= 2)
SELECT lp.user_id, lp.role, rr.id, rr.course_name FROM lp JOIN rr ON rr.role = lp.role""")
def role_to_catalog(spark, sf_dir):
    """Each user's latest role (W3) joined to that role's two recommended courses."""
    from ..functions.courses import level_category
    lp = X.learning_paths(spark, sf_dir)
    latest = W.latest_per_key(lp, ["user_id"], "created_at", "path_id").select("user_id", F.col("target_role").alias("role"))
    cat = catalog(spark, sf_dir).select("id", "course_name", level_category("level").alias("lc"))
    per_level = W.top_k_per_group(cat, ["lc"], [F.col("course_name").asc_nulls_last(), F.col("id").asc()], 2)    # at most two rows a level
    want = (F.when(F.col("role").like("1%") | F.col("role").like("2%"), "ADVANCED")
            .when(F.col("role").like("3%"), "INTERMEDIATE").otherwise("BEGINNER"))
    recs = latest.select("role").distinct().withColumn("lc", want).join(per_level, "lc").select("role", "id", "course_name")
    return R.role_to_catalog(latest, recs).select("user_id", "role", "id", "course_name")


# ---- SQL twins of the order-dependent folds (C3, A7) --------------------------------
def _any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def _fix_sql(prev: str, lvl: str) -> str:
    own = {"BEGINNER": "b", "INTERMEDIATE": "i", "ADVANCED": "a"}[lvl]
    mx = "CASE WHEN s.b >= s.i AND s.b >= s.a THEN 'BEGINNER' WHEN s.i >= s.a THEN 'INTERMEDIATE' ELSE 'ADVANCED' END"
    cond = f"(s.{own} = 0 AND len(s.cats) > 0 AND greatest(s.b, s.i, s.a) > 1)"

    def cnt(name, col):
        return (f"s.{col} + CASE WHEN {cond} AND '{name}' = '{lvl}' THEN 1 ELSE 0 END"
                f" - CASE WHEN {cond} AND ({mx}) = '{name}' THEN 1 ELSE 0 END")

    return (f"SELECT user_id, has_all, items, {{'cats': CASE WHEN {cond} THEN list_transform(s.cats, lambda c, j: "
            f"CASE WHEN j = list_position(s.cats, {mx}) THEN '{lvl}' ELSE c END) ELSE s.cats END, "
            f"'b': {cnt('BEGINNER', 'b')}, 'i': {cnt('INTERMEDIATE', 'i')}, 'a': {cnt('ADVANCED', 'a')}}} AS s FROM {prev}")


def _fallback_sql() -> str:
    """name, skills, url, platform and cat of a role's two fallback courses, by ``role`` and ``slot``."""
    def field(i: int) -> str:
        out = []
        for slot in (1, 2):
            for words, courses in R.FALLBACK_RULES:
                out.append(f"WHEN slot = {slot} AND {_any_sql('lower(role)', words)} THEN {q(courses[slot - 1][i])}")
            out.append(f"WHEN slot = {slot} THEN replace({q(R.FALLBACK_GENERIC[slot - 1][i])}, '{{role}}', role)")
        return "CASE " + " ".join(out) + " END"
    return ", ".join(f"{field(i)} AS {name}" for i, name in ((0, "name"), (2, "skills"), (3, "url"), (5, "platform"), (6, "cat")))


def _transition_sql(null_rule: bool = False) -> str:
    from .fixture_sql import HELD, REQUIREMENTS
    sanitize = ("list_filter(list_transform(list_filter(m, lambda s: s IS NOT NULL AND length(s) > 0), "
                "lambda s: regexp_replace(translate(s, '''\";', ''), '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 2)[1:3]")
    focus = f"CASE WHEN len({sanitize}) > 0 THEN ' Focus on courses that teach ' || array_to_string({sanitize}, ', ') || '.' ELSE '' END"
    queries = f"""
tr_queries AS (
  SELECT u.user_id AS qid,
         'Show me the best courses for ' || translate(u.role, '''";', '') || ' including beginner to advanced levels.' || {focus} AS qtext
  FROM user_roles u LEFT JOIN miss ms ON ms.user_id = u.user_id
)"""
    b_words, a_words = R.BEGINNER_INDICATORS, R.ADVANCED_INDICATORS
    least = ("CASE WHEN acc.b <= acc.i AND acc.b <= acc.a THEN 'BEGINNER' WHEN acc.i <= acc.a THEN 'INTERMEDIATE' "
             "ELSE 'ADVANCED' END")
    target = (f"CASE WHEN {_any_sql('lower(coalesce(x.name, ' + q('') + '))', b_words)} THEN 'BEGINNER' "
              f"WHEN {_any_sql('lower(coalesce(x.name, ' + q('') + '))', a_words)} THEN 'ADVANCED' ELSE {least} END")
    step = ("lambda acc, x: {'cats': list_append(acc.cats, CASE WHEN x.cat = 'ALL_LEVELS' THEN " + target +
            " ELSE x.cat END), " + ", ".join(
                f"'{c}': acc.{c} + CASE WHEN x.cat = 'ALL_LEVELS' AND ({target}) = '{lvl}' THEN 1 ELSE 0 END"
                for c, lvl in (("b", "BEGINNER"), ("i", "INTERMEDIATE"), ("a", "ADVANCED"))) + "}")
    cnt = lambda lvl: f"len(list_filter(items, lambda y: y.cat = '{lvl}'))"
    return with_catalog(USER_ROLES, HELD, REQUIREMENTS) + f""",
need AS (SELECT u.user_id, u.role, r.pos + CASE WHEN r.bucket = 'essential' THEN 0 ELSE 100 END AS pos, r.skill_name
         FROM user_roles u JOIN rr r ON r.role = u.role),
mj AS (SELECT n.*, h.skill IS NULL AS missing FROM need n LEFT JOIN held h ON h.user_id = n.user_id AND h.skill = n.skill_name),
magg AS (SELECT user_id, role, list(skill_name ORDER BY pos) FILTER (WHERE missing) AS m0 FROM mj GROUP BY user_id, role),
miss AS (SELECT u.user_id, CASE WHEN len(coalesce(m0, CAST([] AS VARCHAR[]))) > 0 THEN m0
                                ELSE [u.role || ' Best Practices', 'Advanced Tools', 'Industry Knowledge'] END AS m
         FROM user_roles u LEFT JOIN magg g ON g.user_id = u.user_id)""" + _search_sql(queries, 6, "tr_") + f""",
found AS (
  SELECT h.qid AS user_id, h.rank, c.id, c.course_name AS name, {transition_bucket_sql('c.level')} AS cat, c.platform, c.skills, c.description
  FROM tr_hits h JOIN catalog c ON c.id = h.id WHERE c.course_name IS NOT NULL AND c.url IS NOT NULL
),
per AS (SELECT user_id, list({{'rank': rank, 'id': id, 'name': name, 'cat': cat, 'platform': platform, 'skills': skills}} ORDER BY rank) AS items
        FROM found WHERE user_id NOT IN (SELECT user_id FROM found WHERE {null_rule} AND cat = 'ALL_LEVELS' AND (skills IS NULL OR description IS NULL))
        GROUP BY user_id),
fb AS (SELECT user_id, role, slot, {_fallback_sql()} FROM user_roles u, (SELECT unnest([1, 2]) AS slot) s
       WHERE user_id NOT IN (SELECT user_id FROM per)),
f0 AS (
  SELECT user_id, items, list_contains(list_transform(items, lambda y: y.cat), 'ALL_LEVELS') AS has_all,
         list_reduce(items, {step},
                     {{'cats': CAST([] AS VARCHAR[]), 'b': {cnt('BEGINNER')}, 'i': {cnt('INTERMEDIATE')}, 'a': {cnt('ADVANCED')}}}) AS s
  FROM per
),
f1 AS ({_fix_sql('f0', 'BEGINNER')}),
f2 AS ({_fix_sql('f1', 'INTERMEDIATE')}),
f3 AS ({_fix_sql('f2', 'ADVANCED')}),
spread AS (
  SELECT user_id, unnest(items) AS it,
         unnest(CASE WHEN has_all THEN s.cats ELSE list_transform(items, lambda y: y.cat) END) AS level_category
  FROM f3
  UNION ALL
  SELECT user_id, {{'rank': CAST(slot AS BIGINT), 'id': sha256(url), 'name': name, 'cat': cat, 'platform': platform, 'skills': skills}}, cat FROM fb
)"""


TRANSITION_SQL = _transition_sql()


from .registry import ORACLE as _ORACLE, _json_text  # noqa: E402

NULL_RULE_SQL = _transition_sql(null_rule=True)
for _name, _sql in (("transition_courses", TRANSITION_SQL), ("transition_null_rule", NULL_RULE_SQL)):
    _ORACLE[_name] = _json_text(_sql + "\nSELECT user_id, CAST(it.rank AS INTEGER) AS rank, it.id AS id, level_category FROM spread")
_ORACLE["need_order"] = _json_text(TRANSITION_SQL + """,
cnts AS (SELECT user_id, count(*) FILTER (WHERE level_category = 'BEGINNER') AS b,
                count(*) FILTER (WHERE level_category = 'INTERMEDIATE') AS i,
                count(*) FILTER (WHERE level_category = 'ADVANCED') AS a FROM spread GROUP BY user_id)
SELECT user_id,
  CASE WHEN b <= i AND b <= a THEN 'BEGINNER' WHEN i <= a THEN 'INTERMEDIATE' ELSE 'ADVANCED' END AS least_level,
  CASE WHEN b >= i AND b >= a THEN 'BEGINNER' WHEN i >= a THEN 'INTERMEDIATE' ELSE 'ADVANCED' END AS most_level
FROM cnts""")


def _rebalance_sql() -> str:
    named = _any_sql("lower(coalesce(x.name, ''))", R.REBALANCE_BEGINNER_WORDS)
    rest = "list_filter(src, lambda x: NOT list_contains(list_transform(picks, lambda p: p.id), x.id))"
    return TRANSITION_SQL + f""",
p0 AS (
  SELECT user_id, list_filter(items, lambda x: x.cat = 'BEGINNER') AS b, list_filter(items, lambda x: x.cat = 'INTERMEDIATE') AS i,
         list_filter(items, lambda x: x.cat = 'ADVANCED') AS a
  FROM (SELECT user_id, list({{'rank': it.rank, 'id': it.id, 'name': it.name, 'cat': level_category, 'platform': it.platform, 'skills': it.skills}} ORDER BY it.rank) AS items
        FROM spread GROUP BY user_id)
),
p1 AS (SELECT *, len(b) = 0 AND (len(i) > 0 OR len(a) > 0) AS c1, CASE WHEN len(i) > 0 THEN i ELSE a END AS src FROM p0),
p1b AS (SELECT *, list_concat(list_filter(src, lambda x: {named}), list_filter(src, lambda x: NOT {named}))[1:2] AS picks FROM p1),
p1c AS (SELECT user_id, CASE WHEN c1 THEN picks ELSE b END AS b, CASE WHEN c1 AND len(i) > 0 THEN {rest} ELSE i END AS i,
               CASE WHEN c1 AND len(i) = 0 THEN {rest} ELSE a END AS a FROM p1b),
p2 AS (SELECT *, len(b) > 2 AS useb, CASE WHEN len(b) > 2 THEN b ELSE a END AS src FROM p1c),
p2b AS (SELECT user_id, CASE WHEN c2 AND useb THEN src[3:] ELSE b END AS b, CASE WHEN c2 THEN src[1:2] ELSE i END AS i,
               CASE WHEN c2 AND NOT useb THEN src[3:] ELSE a END AS a
        FROM (SELECT *, len(i) = 0 AND (len(b) > 0 OR len(a) > 0) AND len(src) > 0 AS c2 FROM p2)),
p3 AS (SELECT *, len(i) > 2 AS usei, CASE WHEN len(i) > 2 THEN i ELSE b END AS src FROM p2b),
p3b AS (
  SELECT user_id,
         CASE WHEN c3 AND NOT usei THEN src[1:len(src) - k] ELSE b END AS b,
         CASE WHEN c3 AND usei THEN src[1:len(src) - k] ELSE i END AS i,
         CASE WHEN c3 THEN list_reverse(src[len(src) - k + 1:len(src)]) ELSE a END AS a
  FROM (SELECT *, len(a) = 0 AND (len(b) > 0 OR len(i) > 0) AND len(src) > 0 AS c3, least(len(src), 2) AS k FROM p3)
),
plan AS (
  SELECT user_id, lvl AS level_category, CAST(u.slot AS INTEGER) AS slot, months, u.c.id AS id,
         u.c.name AS course_name, u.c.platform AS platform, u.c.skills AS skills FROM (
    SELECT user_id, 'BEGINNER' AS lvl, '1-2' AS months, unnest(list_transform(b[1:2], lambda x, j: {{'slot': j, 'c': x}})) AS u FROM p3b
    UNION ALL
    SELECT user_id, 'INTERMEDIATE', '3-4', unnest(list_transform(i[1:2], lambda x, j: {{'slot': j, 'c': x}})) FROM p3b
    UNION ALL
    SELECT user_id, 'ADVANCED', '5-6', unnest(list_transform(a[1:2], lambda x, j: {{'slot': j, 'c': x}})) FROM p3b)
)"""


REBALANCE_SQL = _rebalance_sql()
_ORACLE["plan_rebalance"] = _json_text(REBALANCE_SQL + "\nSELECT user_id, level_category, slot, months, id FROM plan")
_ORACLE["plan_table"] = _json_text(REBALANCE_SQL + """
SELECT user_id, level_category, slot, months, course_name, platform, to_json(string_split(skills, ', ')) AS skills FROM plan""")
_ORACLE["fallback_courses"] = _json_text(NULL_RULE_SQL + "\nSELECT user_id, role, CAST(slot AS INTEGER) AS slot, name AS course_name FROM fb")
