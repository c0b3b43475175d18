"""Postings counted within rows, and jobs that run once for users that are alike."""
from collections import Counter

from pyspark.sql import functions as F

from skillgrid.operators import recommend as R
from skillgrid.operators import search as S


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_unique_keys_are_not_shuffled(spark):
    docs = spark.createDataFrame([(f"k{i}", "b a b c" * (i % 3)) for i in range(30)], "id string, _search string")
    out = R.catalog_postings(docs)
    assert "Exchange" not in _plan(out)
    assert sorted(tuple(r) for r in out.filter("id = 'k1'").collect()) == [("a", "k1", 4, 1), ("b", "k1", 4, 2), ("c", "k1", 4, 1)]


def test_rows_with_a_shared_or_no_key_are_one_document(spark):
    rows = [("x", "a a b"), ("x", "a c c"), ("x", "a"), (None, "a b"), (None, "b a"), ("y", "q"), ("z", None), ("w", "12 ,")]
    got = R.catalog_postings(spark.createDataFrame(rows, "id string, _search string")).collect()
    want = Counter()
    for k, text in rows:
        words = [w for w in (text or "").split() if w.isalpha()]
        for w in words:
            want[w, k, len(words)] += 1
    assert Counter({(r.term, r.id, r.doc_len): r.cnt for r in got}) == want and len(got) == len(want)
    index = S.build_index(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()
    assert all(r.tf == r.cnt / r.doc_len for r in index) and len(index) == len(want)


def _catalog(spark):
    rows = [(f"c{i:02d}", f"Course {i}", f"data word{'abcdefghij'[i % 10]} " * 3, None if i % 3 else "s", lv, "edX", f"u{i}")
            for i, lv in enumerate(["Beginner", "Intermediate", "Advanced", "All Levels"] * 10)]
    return spark.createDataFrame(rows, "id string, course_name string, description string, skills string, level string, platform string, url string")


def test_courses_are_found_once_for_users_that_are_alike(spark):
    users = spark.range(300).select(F.col("id").alias("user_id"), F.when(F.col("id") % 2 == 0, "Nurse").otherwise("Data Analyst").alias("role"))
    missing = users.select("user_id", "role", F.array(F.lit("worda")).alias("missing_skills"))
    alike, courses = R.transition_alike(users, missing, _catalog(spark), null_rule=False)
    assert courses.select("user_id").distinct().count() == 2 and courses.count() <= 12
    every = alike.of(courses)
    assert every.groupBy("user_id").count().filter("count = 6").count() == 300
    # users apart from each other get what the stand-ins got
    few = R.transition_courses(users.filter("user_id < 2"), missing, _catalog(spark), null_rule=False)
    cols = ["user_id", "rank", "id", "level_category"]
    assert sorted(few.select(*cols).collect()) == sorted(every.filter("user_id < 2").select(*cols).collect())


def test_repeated_and_missing_user_ids_keep_their_rows(spark):
    users = spark.createDataFrame([(1, "Nurse"), (1, "Nurse"), (2, "Nurse"), (None, "Nurse"), (None, "Nurse"), (3, None)], "user_id long, role string")
    asked = users.select("user_id", F.lit("[]").alias("_set"))
    alike = R.Alike(users=users, asked=asked)
    assert alike.members.count() == 4
    assert Counter(map(tuple, alike.of(alike.parts["users"]).collect())) == Counter(map(tuple, users.collect()))
    ratings = spark.createDataFrame([(2, "worda (4)")], "user_id long, ratings string")
    recs, tagged = R.recommend_courses(users, ratings, _catalog(spark))
    n = {r.user_id: r["count"] for r in tagged.groupBy("user_id").count().collect()}
    assert n == {1: 40, 2: 20, 3: 20, None: 40}
    assert recs.filter("rn > 2").count() == 0 and recs.filter("user_id is null").count() > 0
