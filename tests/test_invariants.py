"""Order-dependent operators: fold equivalence, rebalance invariants, exact shared-template search."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from skillgrid.operators import recommend as R
from skillgrid.operators import search as SR
from skillgrid.operators import windows as W

TRANSITION_SCHEMA = ("user_id long, role string, id string, course_name string, level string, platform string, "
                     "skills string, rank int, level_category string")


def _courses(spark, users=400, seed=3):
    rnd = random.Random(seed)
    cats = ["BEGINNER", "INTERMEDIATE", "ADVANCED", "ALL_LEVELS"]
    names = ["Intro to x", "Advanced y", "Plain z", "Master q", "Basic w", "Other"]
    rows = []
    for u in range(users):
        for r in range(1, rnd.randint(1, 6) + 1):
            rows.append((u, "role", f"id{u}_{r}", rnd.choice(names), "lvl", "p", "a, b", r, rnd.choice(cats)))
    return spark.createDataFrame(rows, TRANSITION_SCHEMA)


LEVELS = ["BEGINNER", "INTERMEDIATE", "ADVANCED"]


def _has_word(name, words):
    low = (name or "").lower()
    return any(w in low for w in words)


def reference_spread(rows):
    """Sequential statement of the C3 rules over one user's rows (sorted by rank)."""
    cats = [r["level_category"] for r in rows]
    if "ALL_LEVELS" not in cats:
        return cats
    tally = {lv: cats.count(lv) for lv in LEVELS}
    for k, r in enumerate(rows):
        if cats[k] != "ALL_LEVELS":
            continue
        if _has_word(r["course_name"], R.BEGINNER_INDICATORS):
            pick = "BEGINNER"
        elif _has_word(r["course_name"], R.ADVANCED_INDICATORS):
            pick = "ADVANCED"
        else:
            pick = min(LEVELS, key=lambda lv: tally[lv])        # first least-populated level
        cats[k] = pick
        tally[pick] += 1
    for lv in LEVELS:
        fullest = max(LEVELS, key=lambda x: tally[x])           # first most-populated level
        if tally[lv] == 0 and cats and tally[fullest] > 1:
            cats[cats.index(fullest)] = lv
            tally[lv] += 1
            tally[fullest] -= 1
    return cats


def reference_plan(rows):
    """Sequential statement of the C4 moves over one user's rows (sorted by rank)."""
    by = {lv: [r for r in rows if r["level_category"] == lv] for lv in LEVELS}
    b, i, a = by["BEGINNER"], by["INTERMEDIATE"], by["ADVANCED"]
    if not b and (i or a):
        pool = i if i else a
        ranked = [r for r in pool if _has_word(r["course_name"], R.REBALANCE_BEGINNER_WORDS)] + \
                 [r for r in pool if not _has_word(r["course_name"], R.REBALANCE_BEGINNER_WORDS)]
        b = ranked[:2]
        left = [r for r in pool if r not in b]
        if i:
            i = left
        else:
            a = left
    if not i and (b or a):
        if len(b) > 2:
            i, b = b[:2], b[2:]
        elif a:
            i, a = a[:2], a[2:]
    if not a and (b or i):
        if len(i) > 2:
            a, i = i[-2:][::-1], i[:-2]
        elif b:
            k = min(len(b), 2)
            a, b = b[len(b) - k:][::-1], b[:len(b) - k]
    months = {"BEGINNER": "1-2", "INTERMEDIATE": "3-4", "ADVANCED": "5-6"}
    return [(lv, n + 1, months[lv], r["id"]) for lv, lst in zip(LEVELS, (b, i, a)) for n, r in enumerate(lst[:2])]


def _per_user(df):
    users = defaultdict(list)
    for r in df.collect():
        users[r["user_id"]].append(r.asDict())
    return {u: sorted(rs, key=lambda r: r["rank"]) for u, rs in users.items()}


def test_spread_fold_matches_sequential_rules(spark):
    df = _courses(spark)
    jvm = R.spread_all_levels(df)
    got = {(r.user_id, r.id): r.level_category for r in jvm.collect()}
    for u, rows in _per_user(df).items():
        for r, cat in zip(rows, reference_spread(rows)):
            assert got[(u, r["id"])] == cat
    # the row set is unchanged and no ALL_LEVELS remains for users that had one
    assert jvm.count() == df.count()
    assert jvm.filter(F.col("level_category") == "ALL_LEVELS").count() == 0


def test_rebalance_invariants(spark):
    spread = R.spread_all_levels(_courses(spark))
    plan = R.plan_rebalance(spread)
    per = plan.groupBy("user_id", "level_category").agg(F.count(F.lit(1)).alias("n"))
    assert per.filter(F.col("n") > 2).count() == 0                      # at most two per level
    months = {r.level_category: r.months for r in plan.select("level_category", "months").distinct().collect()}
    assert months == {"BEGINNER": "1-2", "INTERMEDIATE": "3-4", "ADVANCED": "5-6"}
    # users with >= 3 courses whose levels are not all equal end up with beginner courses
    ids = plan.select("id").distinct().join(spread.select("id"), "id", "left_anti")
    assert ids.count() == 0                                             # no invented courses


def test_shared_search_equals_brute_force(spark):
    docs = spark.createDataFrame([
        (1, "python data course for beginners"), (2, "advanced data engineering with spark"),
        (3, "nursing basics and care"), (4, "the software developer path"), (5, "data data data"),
        (6, "spark streaming and python")], "id long, text string")
    queries = spark.createDataFrame([(10, "data spark"), (11, "nursing"), (12, "python"), (13, "zzz")],
                                    "qid long, extra string")
    shared = "best courses for beginners"
    fast = R.shared_search(docs, "id", "text", queries, "qid", "extra", shared, 3)
    brute = SR.search_topn(docs, "id", "text",
                           queries.withColumn("q", F.concat_ws(" ", F.lit(shared), "extra")), "qid", "q", 6)
    # every positively scored document ranks identically (the brute force lists only those)
    b = {(r.qid, r.rank): (r.id, round(r.score, 9)) for r in brute.filter("rank <= 3").collect()}
    f = {(r.qid, r.rank): (r.id, round(r.score, 9)) for r in fast.filter("score > 0").collect()}
    assert f == b and len(f) > 0


def test_sequential_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") * 7919 % 5000).cast("string").alias("name"))
    out = W.sequential_ids(df.repartition(7), ["name", "id"], "U", "seq").collect()
    seq = sorted(out, key=lambda r: int(r.seq[1:]))
    assert [int(r.seq[1:]) for r in seq] == list(range(1, 5001))
    assert [r.name for r in seq] == sorted(r.name for r in out)


def test_rebalance_jvm_matches_sequential_rules(spark):
    df = R.spread_all_levels(_courses(spark, users=600, seed=5))
    got = sorted((r.user_id, r.level_category, r.slot, r.months, r.id) for r in R.plan_rebalance(df).collect())
    want = sorted((u, *t) for u, rows in _per_user(df).items() for t in reference_plan(rows))
    assert got == want


def test_advanced_backfill_branch(spark):
    """A user with no ADVANCED course and a rating >= 3 gets advanced courses appended; others do not."""
    cat_rows = [(f"b{k:02d}", f"Course {k}", "expert professional courses", "Beginner", "Udemy", None, f"u/{k}")
                for k in range(24)]
    cat_rows.append(("adv", "Deep Course", "advanced " + "zzz " * 200, "Advanced", "edX", None, "u/adv"))
    catalog = spark.createDataFrame(cat_rows, "id string, course_name string, description string, level string, "
                                              "platform string, skills string, url string")
    users = spark.createDataFrame([(1, "Nurse"), (2, "Nurse")], "user_id long, role string")
    ratings = spark.createDataFrame([(1, "skill_1 (4)"), (2, "skill_1 (1)")], "user_id long, ratings string")
    high = spark.createDataFrame([(1, 1), (2, 0)], "user_id long, high_rated long")
    recs, _ = R.recommend_courses(users, ratings, catalog)
    assert recs.filter(F.col("level_category") == "ADVANCED").count() == 0
    out = R.advanced_backfill(recs.join(users, "user_id"), users, high, catalog)
    added = {(r.user_id, r.id) for r in out.filter(F.col("level_category") == "ADVANCED").collect()}
    assert added == {(1, "adv")}
    assert out.filter(F.col("user_id") == 2).count() == recs.filter(F.col("user_id") == 2).count()


def test_backlog_goes_on_behind_the_last_committed_range(spark):
    import uuid

    from skillgrid.operators.enrich import BacklogRun
    from skillgrid.session import scratch_path
    df = spark.createDataFrame([(i, f"t{i}") for i in range(-5, 95)] + [(None, "x")], "id long, t string")
    path = scratch_path(spark, f"backlog-{uuid.uuid4().hex}")
    seen = []

    def derive(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        if len(seen) == 4:
            raise RuntimeError("killed")
        return rows.selectExpr("id", "upper(t) AS u")
    run = BacklogRun(spark, path, "id", 20)
    assert run.read() is None and run.run(df, derive, limit=2) == 2
    try:
        run.run(df, derive)
        raise AssertionError("the fourth range fails")
    except RuntimeError:
        pass
    assert sorted(run.committed()) == [-1, 0, 1]
    BacklogRun(spark, path, "id", 20).run(df, derive)                     # a new runner needs nothing but the folder
    assert seen[3] == seen[4] and len(seen) == 7                         # the broken range is done again, no other
    got = sorted((r.id, r.u, r.batch_id) for r in run.read().collect())
    assert got == [(i, f"T{i}", i // 20) for i in range(-5, 95)]
