"""Recommendation jobs for every user in one pass.

Search with a shared query template
-----------------------------------
Every user's query is one fixed template plus a few user-specific words
(role, rated skills, missing skills).  Scoring each user against the whole
posting lists of the template words would touch every (user, course) pair.
The TF-IDF score splits exactly:

    score(u, d) = base(d) + extra(u, d)

``base`` sums the template's terms (one value per course, computed once) and
``extra`` sums only the user's own terms that are not in the template (an
equi-join of those few terms with their postings).  A course with no extra
match scores ``base(d)``, so it can only reach a user's top n if it is in the
global top n by ``base``; that bounded list (n rows) is attached to every
user by exploding one array literal -- linear in users, no cross join.

Order-dependent folds (C3 spreading, C4 rebalancing) run per user as array
expressions (``aggregate``, ``filter``, ``slice``) over lists bounded by the
search limit, so no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.courses import level_category, level_category_transition
from ..sources.materialize import stored
from .search import NOISE, document_postings, tokens

LEVELS = ("BEGINNER", "INTERMEDIATE", "ADVANCED")

# ---- Fixed values: query texts of the reference's searches ----------------
RECOMMEND_TEMPLATE = (
    "I am targeting a career as a {role}. My self-assessed skill ratings are: {ratings}. Rating scale: "
    "1 = No experience, 2 = Basic knowledge, 3 = Intermediate, 4 = Advanced, 5 = Expert. All my skills are "
    "rated 4 or 5, indicating a strong foundation. Please recommend advanced-level, expert-level, or specialized "
    "courses. Include degree-level, Nanodegree, or professional certificate programs if available. Focus on "
    "deepening expertise, advanced projects, and real-world applications.")
DEFAULT_RATINGS = "Python (4), SQL (4), Machine Learning (4), Data Visualization (4), Cloud Computing (4)"
ADVANCED_TEMPLATE = ("I need ADVANCED level courses for {role}. ONLY return courses that are explicitly labeled as "
                     "ADVANCED level. Focus only on advanced courses.")
TRANSITION_TEMPLATE = "Show me the best courses for {role} including beginner to advanced levels.{focus}"
TRANSITION_FOCUS = " Focus on courses that teach {skills}."

# Name words that move an ALL_LEVELS course (C3) and pick beginner courses (C4).
BEGINNER_INDICATORS = ("intro", "beginning", "basic", "fundamental", "foundation", "start")
ADVANCED_INDICATORS = ("advanced", "expert", "mastery", "professional", "master")
REBALANCE_BEGINNER_WORDS = ("intro", "beginner", "fundamental", "basic")

# Literal fallback courses per role class (C5), first matching rule wins.
FALLBACK_RULES = (
    (("data", "scientist", "analyst"), (
        ("Data Science Fundamentals", "Learn the key concepts and tools for data science and machine learning",
         "Python, Statistics, Data Visualization, Machine Learning",
         "https://www.coursera.org/specializations/data-science-fundamentals", "Beginner", "Coursera", "BEGINNER"),
        ("Advanced Machine Learning", "Master advanced machine learning techniques and algorithms",
         "Deep Learning, Statistical Models, Feature Engineering",
         "https://www.coursera.org/specializations/advanced-machine-learning", "Advanced", "Coursera", "ADVANCED"))),
    (("system", "systems"), (
        ("Systems Design and Architecture", "Learn essential concepts in designing and implementing complex systems",
         "Architecture Patterns, System Integration, Documentation",
         "https://www.udemy.com/course/system-design-architecture", "Intermediate", "Udemy", "INTERMEDIATE"),
        ("Systems Engineering Fundamentals", "Master the principles of systems engineering and project management",
         "Requirements Analysis, System Testing, Project Management",
         "https://www.edx.org/learn/systems-engineering", "Beginner", "edX", "BEGINNER"))),
    (("software", "developer", "engineer"), (
        ("Software Engineering Principles", "Master essential software engineering concepts and practices",
         "Software Design, Testing, CI/CD, Version Control",
         "https://www.udemy.com/course/software-engineering-principles", "Beginner to Intermediate", "Udemy", "BEGINNER"),
        ("Advanced Software Architecture", "Learn advanced principles of software architecture and design patterns",
         "Design Patterns, System Architecture, Scalability",
         "https://www.coursera.org/learn/software-architecture", "Advanced", "Coursera", "ADVANCED"))),
)
FALLBACK_GENERIC = (
    ("Essential Skills for {role}", "Develop the core competencies needed for a successful career as a {role}",
     "Technical Skills, Communication, Problem Solving", "https://www.coursera.org/professional-certificates",
     "Beginner", "Coursera", "BEGINNER"),
    ("Advanced {role} Masterclass", "Take your {role} skills to the next level with industry best practices",
     "Advanced Techniques, Industry Knowledge, Specialization", "https://www.udemy.com/courses/professional-development",
     "Advanced", "Udemy", "ADVANCED"),
)


def search_text(catalog: DataFrame) -> DataFrame:
    """The searchable text of a course: name, description and skills."""
    return catalog.withColumn("_search", F.concat_ws(" ", "course_name", "description", "skills"))


def catalog_postings(docs: DataFrame, key: str = "id", text: str = "_search") -> DataFrame:
    """V6 for the catalogue: (term, key, doc_len, cnt) postings of every course (materialise once)."""
    return document_postings(docs, key, text)


def shared_search(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, extra_text: str,
                  shared_text: str, n: int, postings: DataFrame | None = None) -> DataFrame:
    """Top-n TF-IDF per query where query = ``shared_text`` words + the query's own words.

    Returns (qkey, key, score, rank).  Exact; see the module docstring and ``searched_sets``.
    """
    q_sets, per_set = searched_sets(docs, key, text, queries, [qkey], extra_text, shared_text, n, postings)
    return q_sets.join(per_set, "_set").select(qkey, key, "score", "rank")


def searched_sets(docs: DataFrame, key: str, text: str, queries: DataFrame, qcols, extra_text: str,
                  shared_text: str, n: int, postings: DataFrame | None = None, write: bool = True):
    """((qcols..., _set) of every query, (_set, key, score, rank)), both written once (the second if ``write``).

    Queries with the same set of own words have the same answer, so the search
    runs once per distinct word set (keyed by the sorted set itself, exact).
    ``postings`` (from ``catalog_postings``, usually a materialised table) saves
    re-tokenising the documents; without it they are built here.
    What is bounded by the sets (vocabulary, weights, candidates) is written
    before it meets the postings: the joins are planned by its size, and the
    postings stay where they are while it is small.
    """
    spark = docs.sparkSession
    shared = sorted({t for t in _py_tokens(shared_text)})
    shared_arr = F.array(*[F.lit(t) for t in shared]).cast("array<string>")
    # written once: the sets are asked for by the vocabulary, the search and the final join
    q_sets = stored(queries.select(*qcols, F.to_json(F.array_sort(F.array_except(tokens(extra_text), shared_arr))).alias("_set")), "word-sets")
    sets = stored(q_sets.select("_set").distinct(), "sets")
    shared_df = spark.createDataFrame([(t,) for t in shared], "term string")
    own = sets.withColumn("_words", F.from_json("_set", "array<string>"))
    qt = stored(own.select("_set", F.size("_words").alias("_k"), F.explode("_words").alias("term")), "set-words")
    vocab = stored(qt.select("term").union(shared_df).distinct(), "words")
    if postings is None:
        postings = catalog_postings(docs, key, text)
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    # One pass over the postings: weights, base and extra all read the stored lists of the query vocabulary.
    post = stored(postings.join(vocab, "term", "left_semi").select("term", key, (F.col("cnt") / F.col("doc_len")).alias("tf")), "vocabulary")
    weights = stored(post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                     .select("term", F.log(F.lit(n_docs).cast("double") / F.col("df")).alias("idf"))
                     .filter(F.col("idf") > 0), "weights")
    wpost = post.join(weights, "term").select("term", key, (F.col("tf") * F.col("idf")).alias("w"))
    base = (wpost.filter(F.col("term").isin(*shared))
            .groupBy(key).agg(F.sum("w").alias("base")))
    all_docs = stored(docs.select(key).join(base, key, "left").fillna(0.0, ["base"]), "base")
    top_base = (all_docs.orderBy(F.round("base", 9).desc(), F.col(key).asc()).limit(n)
                .agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("base").alias("b"))).alias("top")))
    own_lists = wpost.join(qt.groupBy("term").agg(F.max("_k").alias("_most")), "term")
    found = reaching(own_lists, all_docs, qt, top_base, key, n).select("_set", key)
    fallback = (sets.withColumn("_top", top_base.select("top").scalar())
                .select("_set", F.explode("_top").alias("c")).select("_set", F.col("c.k").alias(key)))
    cands = stored(found.unionByName(fallback).distinct(), "set-candidates")
    extra = (cands.join(qt.select("_set", "term"), "_set").join(wpost, ["term", key])
             .groupBy("_set", key).agg(F.sum("w").alias("extra")))
    scored = (cands.join(extra, ["_set", key], "left").join(all_docs, key)
              .withColumn("score", F.col("base") + F.coalesce("extra", F.lit(0.0))))
    w = Window.partitionBy("_set").orderBy(F.round("score", 9).desc(), F.col(key).asc())
    per_set = scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n) \
                    .select("_set", key, "score", "rank")
    return q_sets, stored(per_set, "set-results") if write else per_set


class Alike:
    """Users whose rows are equal in every part, represented by one stand-in each.

    The jobs below use ``user_id`` only to keep users apart, so what holds for a
    stand-in holds for all its members.  ``parts`` has each part's rows under
    the stand-in's ``user_id`` and as often as a member has them; ``of`` gives
    the rows found for stand-ins to the members.  Rows without a user_id stay
    together and keep none.
    """

    def __init__(self, **parts: DataFrame):
        rows = None
        for name, part in parts.items():
            own = [c for c in part.columns if c != "user_id"]
            r = part.select("user_id", F.lit(name).alias("part"), F.to_json(F.struct(*own)).alias("row"))
            rows = r if rows is None else rows.unionByName(r)
        counted = rows.groupBy("user_id", "part", "row").agg(F.count(F.lit(1)).alias("n"))
        items = F.array_sort(F.collect_list(F.struct("part", "row", "n")))
        per_user = counted.groupBy("user_id").agg(F.to_json(items).alias("_items"))
        like = F.when(F.col("user_id").isNotNull(), F.sha2("_items", 256))
        self.members = stored(per_user.select("user_id", like.alias("_like"), "_items"), "alike-members")
        every = (stored(self.members.select("_like", "_items").distinct(), "alike-rows")
                 .select(F.col("_like").alias("user_id"), F.explode(F.from_json("_items", "array<struct<part:string,row:string,n:bigint>>")).alias("_i"))
                 .select("user_id", "_i.part", "_i.row", F.explode(F.sequence(F.lit(1), F.col("_i.n"))).alias("_copy")))
        self.parts = {}
        for name, part in parts.items():
            own = [f for f in part.schema.fields if f.name != "user_id"]
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
            read = every.filter(F.col("part") == name).select("user_id", F.from_json("row", schema).alias("_r"))
            self.parts[name] = read.select("user_id", *[F.col(f"_r.{f.name}").alias(f.name) for f in own])

    def of(self, rows: DataFrame, write: bool = True) -> DataFrame:
        """``rows`` of stand-ins -> the rows of all members.

        ``rows`` are written first, so that the join is planned by their size; without ``write`` (user_id, stand-in)
        may be shuffled.
        """
        rows = stored(rows, "alike-results") if write else rows
        members = self.members.select(F.col("user_id").alias("_member"), "_like")
        return (members.join(rows, F.col("_like").eqNullSafe(F.col("user_id")))
                .select(*[F.col("_member").alias(c) if c == "user_id" else F.col(c) for c in rows.columns]))


def reaching(own_lists: DataFrame, bases: DataFrame, qt: DataFrame, top_base: DataFrame, key: str, n: int) -> DataFrame:
    """(_set, key, term): postings of own words that can lift their course into a set's best n.

    The n-th best base is a lower bound of every set's n-th best score.  A course
    that lies ``gap`` below it needs as much from the set's k own words, so one
    of them must weigh at least gap / k; other postings are not read.  Lists are
    cut by the largest k that asks for a word before they meet the sets.
    """
    top = F.col("_top")
    least = F.when(F.size(top) == n, F.array_min(F.transform(top, lambda c: c["b"]))).otherwise(F.lit(0.0))
    lists = (own_lists.join(bases, key).withColumn("_top", top_base.select("top").scalar())
             .withColumn("_gap", least - F.col("base") - NOISE).filter(F.col("w") * F.col("_most") >= F.col("_gap")))
    return (lists.select("term", key, "w", "_gap").join(qt, "term").filter(F.col("w") * F.col("_k") >= F.col("_gap"))
            .select("_set", key, "term"))


def _py_tokens(text: str):
    import re
    return [t for t in re.split(r"[^\w]+|[\d_]+", text.lower()) if t]


def ratings_text(latest_ratings: DataFrame) -> DataFrame:
    """Per user ``skill (n), skill (n)`` in skill order (N34 over the ratings rows)."""
    items = F.array_sort(F.collect_list(F.struct("skill", "rating")))
    return latest_ratings.groupBy("user_id").agg(
        F.array_join(F.transform(items, lambda s: F.concat(s["skill"], F.lit(" ("), s["rating"].cast("string"), F.lit(")"))),
                     ", ").alias("ratings"))


def recommend_courses(users: DataFrame, ratings: DataFrame, catalog: DataFrame, n: int = 20, per_level: int = 2,
                      postings: DataFrame | None = None):
    """Search (limit 20) -> level bucket (N12) -> two per bucket by name.

    ``users``: (user_id, role); ``ratings``: output of ``ratings_text``.
    Returns (recommendations, searched) where ``searched`` is the top-n list.
    """
    alike, recs, tagged = recommend_alike(users, ratings, catalog, n, per_level, postings)
    return alike.of(recs), alike.of(tagged)


def recommend_alike(users: DataFrame, ratings: DataFrame, catalog: DataFrame, n: int = 20, per_level: int = 2,
                    postings: DataFrame | None = None, write: bool = True, **more: DataFrame):
    """C1 once for users that are alike: (Alike, recommendations, searched), both of stand-ins.

    Parts: ``users``, ``asked`` (their word sets) and ``more`` (user_id, ...).
    """
    q = users.join(ratings, "user_id", "left").withColumn(
        "qtext", F.concat_ws(" ", F.col("role"), F.coalesce("ratings", F.lit(DEFAULT_RATINGS))))
    shared = RECOMMEND_TEMPLATE.format(role="", ratings="")
    q_sets, per_set = searched_sets(search_text(catalog), "id", "_search", q, ["user_id"], "qtext", shared, n, postings, write)
    alike = Alike(users=users, asked=q_sets, **more)
    found = per_set.join(catalog.select("id", "course_name", "level", "platform", "skills", "url", "description"), "id")
    tagged = (alike.parts["asked"].join(found, "_set").drop("_set").withColumn("level_category", level_category("level")))
    w = Window.partitionBy("user_id", "level_category").orderBy(F.col("course_name").asc_nulls_last(), F.col("id"))
    recs = (tagged.filter(F.col("level_category").isin(*LEVELS))
            .withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= per_level))
    return alike, recs, tagged


def missing_levels(recs: DataFrame, users: DataFrame) -> DataFrame:
    """(user, level) for each of BEGINNER/INTERMEDIATE/ADVANCED with no course."""
    dims = users.select("user_id", F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level_category"))
    return dims.join(recs.select("user_id", "level_category").distinct(), ["user_id", "level_category"], "left_anti")


def advanced_backfill(recs: DataFrame, users: DataFrame, high_rated: DataFrame, catalog: DataFrame,
                      limit: int = 4, keep: int = 2, postings: DataFrame | None = None) -> DataFrame:
    """C2 + U2: for users lacking ADVANCED with some rating >= 3, append up to two advanced courses.

    The backfill search depends only on the role, so it runs once per distinct
    role and is joined to the users who need it.
    """
    need = (missing_levels(recs, users).filter(F.col("level_category") == "ADVANCED").select("user_id")
            .join(high_rated.filter(F.col("high_rated") > 0).select("user_id"), "user_id", "left_semi")
            .join(users, "user_id"))
    roles = users.select("role").distinct().withColumn("qtext", F.col("role"))
    shared = ADVANCED_TEMPLATE.format(role="")
    hits = shared_search(search_text(catalog), "id", "_search", roles, "role", "qtext", shared, limit, postings)
    adv = (hits.join(catalog.select("id", "course_name", "level", "platform", "skills", "url", "description"), "id")
           .filter(F.lower("level").like("%advanced%")))
    w = Window.partitionBy("role").orderBy("rank")
    adv = adv.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= keep) \
             .withColumn("level_category", F.lit("ADVANCED"))
    extra = need.join(adv, "role")
    cols = ["user_id", "role", "id", "course_name", "level", "platform", "level_category", "rn"]
    return recs.select(*cols).unionByName(extra.select(*cols))


# ---- C3 transition courses: search (limit 6) + sequential spreading fold ----

def _contains_any(s: Column, words) -> Column:
    cond = None
    for w in words:
        c = F.instr(s, w) > 0
        cond = c if cond is None else cond | c
    return cond


def spread_all_levels(courses: DataFrame) -> DataFrame:
    """C3 fold, JVM-side: per user, ALL_LEVELS courses take a level by name words or by need.

    A user's courses (at most the search limit) are folded in rank order with
    ``aggregate``; the accumulator carries the assigned levels and the three
    level counts.  Then each empty level takes the first course of the fullest
    level when that level holds more than one.  Only users with at least one
    ALL_LEVELS course are changed.
    """
    item = F.struct("rank", "id", "course_name", "level", "platform", "skills", "level_category")
    per_user = courses.groupBy("user_id", "role").agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.col("items")

    def cnt(lvl):
        return F.size(F.filter(items, lambda x: x["level_category"] == lvl))

    init = F.struct(F.array().cast("array<string>").alias("cats"), cnt("BEGINNER").alias("b"),
                    cnt("INTERMEDIATE").alias("i"), cnt("ADVANCED").alias("a"))

    def step(acc, x):
        b, i, a = acc["b"], acc["i"], acc["a"]
        name = F.lower(F.coalesce(x["course_name"], F.lit("")))
        least = F.when((b <= i) & (b <= a), "BEGINNER").when(i <= a, "INTERMEDIATE").otherwise("ADVANCED")
        target = (F.when(_contains_any(name, BEGINNER_INDICATORS), "BEGINNER")
                  .when(_contains_any(name, ADVANCED_INDICATORS), "ADVANCED").otherwise(least))
        is_all = x["level_category"] == "ALL_LEVELS"
        cat = F.when(is_all, target).otherwise(x["level_category"])
        inc = lambda lvl: F.when(is_all & (target == lvl), 1).otherwise(0)
        return F.struct(F.concat(acc["cats"], F.array(cat)).alias("cats"), (b + inc("BEGINNER")).alias("b"),
                        (i + inc("INTERMEDIATE")).alias("i"), (a + inc("ADVANCED")).alias("a"))

    folded = per_user.withColumn("_acc", F.aggregate(items, init, step))
    acc = F.col("_acc")
    for lvl in LEVELS:
        b, i, a = acc["b"], acc["i"], acc["a"]
        mx = F.when((b >= i) & (b >= a), "BEGINNER").when(i >= a, "INTERMEDIATE").otherwise("ADVANCED")
        mx_n = F.greatest(b, i, a)
        own = {"BEGINNER": b, "INTERMEDIATE": i, "ADVANCED": a}[lvl]
        cond = (own == 0) & (F.size(acc["cats"]) > 0) & (mx_n > 1)
        pos = F.array_position(acc["cats"], mx)
        cats = F.transform(acc["cats"], lambda c, j: F.when(j + 1 == pos, F.lit(lvl)).otherwise(c))

        def bump(name, cur):
            return cur + F.when(F.lit(name) == F.lit(lvl), 1).otherwise(0) - F.when(mx == F.lit(name), 1).otherwise(0)

        moved = F.struct(cats.alias("cats"), bump("BEGINNER", b).alias("b"), bump("INTERMEDIATE", i).alias("i"),
                         bump("ADVANCED", a).alias("a"))
        folded = folded.withColumn("_acc", F.when(cond, moved).otherwise(acc))
    has_all = F.exists(items, lambda x: x["level_category"] == "ALL_LEVELS")
    final = F.when(has_all, F.col("_acc")["cats"]).otherwise(F.transform(items, lambda x: x["level_category"]))
    out = folded.select("user_id", "role", F.posexplode(F.arrays_zip(items.alias("it"), final.alias("cat"))).alias("p", "z"))
    return out.select("user_id", "role", *[F.col("z.it")[c].alias(c) for c in
                                           ("id", "course_name", "level", "platform", "skills")],
                      F.col("z.it")["rank"].alias("rank"), F.col("z.cat").alias("level_category"))


def transition_courses(users: DataFrame, missing: DataFrame, catalog: DataFrame, n: int = 6,
                       postings: DataFrame | None = None, null_rule: bool = True) -> DataFrame:
    """C3 + C5: per user search (limit 6) with up to three sanitised missing skills, N13 buckets, spreading fold.

    A user whose search finds nothing, or finds an ALL_LEVELS course without
    skills or description (the fold cannot read it), gets the role's fallback
    courses instead of the whole list.  Without ``null_rule`` missing texts are
    read as empty, and only an empty search falls back.
    """
    alike, courses = transition_alike(users, missing, catalog, n, postings, null_rule)
    return alike.of(courses)


def transition_alike(users: DataFrame, missing: DataFrame, catalog: DataFrame, n: int = 6,
                     postings: DataFrame | None = None, null_rule: bool = True):
    """``transition_courses`` once for users that are alike: (Alike, courses of stand-ins, written once)."""
    alike, found = transition_found(users, missing, catalog, n, postings)
    served = transition_served(found, null_rule)
    good = found.join(served, "user_id", "left_semi").drop("described")
    fallback = fallback_courses(alike.parts["users"], served).select(
        "user_id", "role", F.sha2("url", 256).alias("id"), "course_name", "level", "platform", "skills", F.col("slot").cast("int").alias("rank"), "level_category")
    return alike, stored(spread_all_levels(good).unionByName(fallback), "transition-courses")


def transition_served(found: DataFrame, null_rule: bool = True) -> DataFrame:
    """(user_id): users whose search result C3 can fold."""
    if not null_rule:
        return found.select("user_id").distinct()
    no_text = ~F.col("described") if "described" in found.columns else F.col("description").isNull()
    unread = (F.col("level_category") == "ALL_LEVELS") & (F.col("skills").isNull() | no_text)
    return found.groupBy("user_id").agg(F.bool_or(unread).alias("_failed")).filter(~F.col("_failed")).select("user_id")


def transition_found(users: DataFrame, missing: DataFrame, catalog: DataFrame, n: int = 6,
                     postings: DataFrame | None = None):
    """The search behind C3: (Alike, at most n named courses with a URL per stand-in, with their level bucket, written once).

    Of the description only goes on whether there is one (``described``).
    """
    from ..functions.skills import skill_token_sanitize
    q = (users.join(missing, ["user_id", "role"], "left")
         .withColumn("_sk", skill_token_sanitize(F.coalesce("missing_skills", F.array().cast("array<string>")), 3))
         .withColumn("_focus", F.when(F.size("_sk") > 0, F.concat(F.lit(TRANSITION_FOCUS.split("{")[0]), F.array_join("_sk", ", "))))
         .withColumn("qtext", F.concat_ws(" ", F.translate("role", "'\";", ""), "_focus")))
    # the focus sentence is the user's own text: without a usable skill the query does not hold it
    shared = TRANSITION_TEMPLATE.format(role="", focus="")
    q_sets, per_set = searched_sets(search_text(catalog), "id", "_search", q, ["user_id"], "qtext", shared, n, postings)
    alike = Alike(users=users, asked=q_sets)
    described = F.col("description").isNotNull().alias("described")
    courses = (per_set.join(catalog.select("id", "course_name", "level", "platform", "skills", "url", described), "id")
               .filter(F.col("course_name").isNotNull() & F.col("url").isNotNull()))
    found = (alike.parts["asked"].join(courses, "_set").join(alike.parts["users"], "user_id")
             .withColumn("level_category", level_category_transition("level"))
             .select("user_id", "role", "id", "course_name", "level", "platform", "skills", "described",
                     F.col("rank").cast("int").alias("rank"), "level_category"))
    return alike, stored(found, "transition-found")


def need_order(courses: DataFrame) -> DataFrame:
    """Least and most populated level per user; ties go to declaration order."""
    ordinal = F.when(F.col("level_category") == "BEGINNER", 0).when(F.col("level_category") == "INTERMEDIATE", 1).otherwise(2)
    users = courses.select("user_id").distinct()
    dims = users.select("user_id", F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level_category"))
    counts = courses.groupBy("user_id", "level_category").agg(F.count(F.lit(1)).alias("n"))
    full = dims.join(counts, ["user_id", "level_category"], "left").fillna(0, ["n"]).withColumn("ord", ordinal)
    return full.groupBy("user_id").agg(
        F.min_by("level_category", F.struct("n", "ord")).alias("least_level"),
        F.max_by("level_category", F.struct("n", (-F.col("ord")).alias("neg_ord"))).alias("most_level"))


# ---- C4 / C10 plan rebalancing and plan table ----------------------------------
MONTHS = {"BEGINNER": "1-2", "INTERMEDIATE": "3-4", "ADVANCED": "5-6"}


def plan_rebalance(courses: DataFrame) -> DataFrame:
    """C4: fill empty levels from neighbours, then first two per level with month windows.

    The three moves are array expressions over each user's (search-bounded)
    course list, so the whole plan stays in the JVM.
    """
    big = 1 << 20
    item = F.struct("rank", "id", "course_name", "platform", "level", "skills", "level_category")
    per = courses.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.col("items")

    def lvl(name):
        return F.filter(items, lambda x: x["level_category"] == name)

    b0, i0, a0 = lvl("BEGINNER"), lvl("INTERMEDIATE"), lvl("ADVANCED")
    per = per.select("user_id", b0.alias("b"), i0.alias("i"), a0.alias("a"))
    b, i, a = F.col("b"), F.col("i"), F.col("a")
    # 1. empty beginner level takes up to two from intermediate (else advanced), beginner-named first
    c1 = (F.size(b) == 0) & ((F.size(i) > 0) | (F.size(a) > 0))
    src = F.when(F.size(i) > 0, i).otherwise(a)
    named = lambda x: _contains_any(F.lower(F.coalesce(x["course_name"], F.lit(""))), REBALANCE_BEGINNER_WORDS)
    picks = F.slice(F.concat(F.filter(src, named), F.filter(src, lambda x: ~named(x))), 1, 2)
    rest = F.filter(src, lambda x: ~F.array_contains(F.transform(picks, lambda p: p["id"]), x["id"]))
    per = per.select("user_id", F.when(c1, picks).otherwise(b).alias("b"),
                     F.when(c1 & (F.size(i) > 0), rest).otherwise(i).alias("i"),
                     F.when(c1 & (F.size(i) == 0), rest).otherwise(a).alias("a"))
    # 2. empty intermediate takes the first two of beginner (if it has more than two) else of advanced
    useb = F.size(b) > 2
    src = F.when(useb, b).otherwise(a)
    c2 = (F.size(i) == 0) & ((F.size(b) > 0) | (F.size(a) > 0)) & (F.size(src) > 0)
    per = per.select("user_id", F.when(c2 & useb, F.slice(src, 3, big)).otherwise(b).alias("b"),
                     F.when(c2, F.slice(src, 1, 2)).otherwise(i).alias("i"),
                     F.when(c2 & ~useb, F.slice(src, 3, big)).otherwise(a).alias("a"))
    # 3. empty advanced takes the last two of intermediate (if it has more than two) else of beginner
    usei = F.size(i) > 2
    src = F.when(usei, i).otherwise(b)
    c3 = (F.size(a) == 0) & ((F.size(b) > 0) | (F.size(i) > 0)) & (F.size(src) > 0)
    k = F.least(F.size(src), F.lit(2))
    moved = F.reverse(F.slice(src, F.size(src) - k + 1, k))
    rest = F.slice(src, 1, F.size(src) - k)
    per = per.select("user_id", F.when(c3 & ~usei, rest).otherwise(b).alias("b"),
                     F.when(c3 & usei, rest).otherwise(i).alias("i"), F.when(c3, moved).otherwise(a).alias("a"))
    def slot_of(name):
        def make(x, j):
            return F.struct(F.lit(name).alias("level_category"), (j + 1).alias("slot"),
                            F.lit(MONTHS[name]).alias("months"), x.alias("c"))
        return make

    slots = F.concat(*[F.transform(F.slice(F.col(c), 1, 2), slot_of(name))
                       for c, name in (("b", "BEGINNER"), ("i", "INTERMEDIATE"), ("a", "ADVANCED"))])
    out = per.select("user_id", F.explode(slots).alias("s"))
    return out.select("user_id", "s.level_category", F.col("s.slot").cast("int").alias("slot"), "s.months",
                      *[F.col(f"s.c.{c}").alias(c) for c in ("id", "course_name", "platform", "level", "skills")])


def plan_table(plan: DataFrame) -> DataFrame:
    """One row per user x level x slot with the skills split into a list."""
    return plan.withColumn("skill_list", F.split("skills", ", "))


def fallback_courses(users: DataFrame, found: DataFrame) -> DataFrame:
    """C5 (+J8): two literal courses per role class for users whose search returned nothing."""
    lonely = users.join(found.select("user_id").distinct(), "user_id", "left_anti")
    low = F.lower("role")
    rows = []
    for words, courses in FALLBACK_RULES:
        rows.append((words, courses))

    def pick(field: int, slot: int) -> Column:
        expr = None
        for words, courses in rows:
            cond = None
            for w in words:
                c = F.instr(low, w) > 0
                cond = c if cond is None else cond | c
            val = F.lit(courses[slot][field])
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        generic = FALLBACK_GENERIC[slot][field]
        if "{role}" in generic:
            pre, post = generic.split("{role}", 1)
            g = F.concat(F.lit(pre), F.col("role"), F.lit(post.replace("{role}", "")))
            if "{role}" in post:
                a, b = post.split("{role}", 1)
                g = F.concat(F.lit(pre), F.col("role"), F.lit(a), F.col("role"), F.lit(b))
        else:
            g = F.lit(generic)
        return expr.otherwise(g)

    names = ["course_name", "description", "skills", "url", "level", "platform", "level_category"]
    slots = F.array(*[F.struct(*[pick(f, s).alias(names[f]) for f in range(7)]) for s in (0, 1)])
    return lonely.select("user_id", "role", F.posexplode(slots).alias("slot", "c")).select(
        "user_id", "role", (F.col("slot") + 1).alias("slot"), *[F.col(f"c.{n}").alias(n) for n in names])


def skill_levels_profile(latest_ratings: DataFrame) -> DataFrame:
    """C9 + N29: one row per user and skill with its priority tag."""
    r = F.col("rating")
    tag = F.when(r <= 2, "Prioritize").when(r == 3, "Focus area")
    return latest_ratings.select("user_id", "skill", "rating", tag.alias("priority"))


def role_to_catalog(latest_roles: DataFrame, role_recs: DataFrame) -> DataFrame:
    """users' latest roles joined to per-role recommendations (bounded by roles x k)."""
    return latest_roles.join(role_recs, "role")

