"""Quirks of the reference's column rules, on tiny inline frames."""

from pyspark.sql import functions as F

from skillgrid.functions import courses as C
from skillgrid.functions import skills as S
from skillgrid.functions import text as T
from skillgrid.operators import enrich as E


def rows(spark, values, schema="x string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_udacity_duration_order_pt30m_is_months(spark):
    df = rows(spark, ["PT30M", "P3M", "P4W", "PT5H", "X", None])
    out = df.select(C.duration("x", "udacity").alias("d"), C.duration_hours("x", "udacity").alias("h")).collect()
    assert [r.d for r in out] == ["30 months", "3 months", "4 weeks", "5 hours", None, None]
    assert [r.h for r in out] == [30 * 730.0, 3 * 730.0, 4 * 168.0, 5.0, None, None]


def test_udemy_duration_literal_dot_and_units(spark):
    df = rows(spark, ["1.5 total hours", "30 total mins", "12 questions", "3x5 total hours", None])
    out = df.select(C.duration("x", "udemy").alias("d"), C.duration_hours("x", "udemy").alias("h")).collect()
    assert [r.d for r in out] == ["1.5 hours", "30 minutes", "12 questions", "3 hours", "unknown"]
    assert [r.h for r in out] == [1.5, 0.5, 0.2, 3.0, None]


def test_split_rejoin_keeps_spaces(spark):
    assert rows(spark, ["a, b"]).select(T.split_rejoin("x", ",").alias("y")).first().y == "a,  b"


def test_blank_vs_null_level_category(spark):
    df = rows(spark, ["Advanced", "fluency", "All Levels", "beginner level", "", None, "Intermediate Level"])
    cats = [r.c for r in df.select(C.level_category("x").alias("c")).collect()]
    assert cats == ["ADVANCED", "INTERMEDIATE", "INTERMEDIATE", "BEGINNER", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    trans = [r.c for r in df.select(C.level_category_transition("x").alias("c")).collect()]
    assert trans == ["ADVANCED", "ADVANCED", "ALL_LEVELS", "BEGINNER", "ADVANCED", "ADVANCED", "INTERMEDIATE"]


def test_rating_sentinel_and_prereq_markers(spark):
    df = rows(spark, ["4.5", "Not found", "N/A", None, " 3 "])
    assert [r.r for r in df.select(C.rating_sentinel("x").alias("r")).collect()] == [4.5, -1.0, -1.0, -1.0, 3.0]
    df2 = rows(spark, ["None.", "not found", "", None, "Python"])
    assert [r.p for r in df2.select(T.prereq_clean("x").alias("p")).collect()] == [None, None, None, None, "Python"]
    assert [r.h for r in df2.select(C.has_prereq("x", "edx").alias("h")).collect()] == [False, False, False, False, True]


def test_dictionary_quirks(spark):
    texts = ["I write C++ daily and C++11", "node-js and Node.js", "R and Go are languages", "Java, not JavaScripts",
             "éGo", "Machine Learning with Python"]
    got = [r.s for r in rows(spark, texts).select(S.extract_dictionary_skills("x").alias("s")).collect()]
    assert got[0] == ["C\\+\\+"]                      # only before a word character
    assert got[1] == ["Node.js"]                       # the dot is a wildcard
    assert got[2] == ["Go", "R"]                        # dictionary order
    assert got[3] == ["Java"]                           # JavaScript not present as a whole word
    assert got[4] == []                                 # Unicode word boundary
    assert got[5] == ["Python", "Machine Learning"]


def test_skill_list_parse_and_sanitize(spark):
    df = rows(spark, [" Python , (SQL, Stats), , Data (Viz), A, B, C"])
    assert df.select(S.skill_list_parse("x").alias("s")).first().s == ["Python", "SQL", "Stats", "Data (Viz)", "A"]
    arr = spark.createDataFrame([(["'ab'", 'x"yz;', "  ", None, "good"],)], "a array<string>")
    assert arr.select(S.skill_token_sanitize("a").alias("s")).first().s == ["xyz", "good"]


def test_stoplist(spark):
    df = rows(spark, ["Learn Python, SQL, Popular things, Data Day, Statistics"])
    assert df.select(S.skill_stoplist_text("x").alias("s")).first().s == "SQL, Statistics"
    assert rows(spark, ["learn"]).select(S.skill_stoplist_text("x").alias("s")).first().s == "Not found"


def test_pii_scrub(spark):
    df = rows(spark, ["Mail me: a.b@c.com or (123) 456-7890. Café résumé!"])
    assert df.select(T.pii_scrub("x").alias("s")).first().s == "Mail me: or . Caf rsum!"


def test_json_list_from_text(spark):
    df = rows(spark, ['Here: ["Python", "SQL"] done', '- Python\n"SQL",\n\n[x'])
    out = [r.s for r in df.select(S.json_list_from_text("x").alias("s")).collect()]
    assert out[0] == ["Python", "SQL"]
    assert out[1] == [" Python", "SQL"]


def test_set_algebra_case_rules(spark):
    df = spark.createDataFrame([(["SQL", "Python", "Go"], ["sql", "GO"])], "req array<string>, held array<string>")
    r = df.select(S.skill_intersect("req", "held").alias("i"), S.skill_except("req", "held").alias("e"),
                  S.skill_except("req", "held", case_sensitive=True).alias("c")).first()
    assert r.i == ["SQL", "Go"] and r.e == ["Python"] and r.c == ["SQL", "Python", "Go"]


def test_role_rules_order(spark):
    df = rows(spark, ["Systems Data Analyst", "Data Engineer", "Nurse"])
    out = [r.s[0] for r in df.select(S.role_default_skills("x").alias("s")).collect()]
    assert out == ["Systems Architecture", "Statistical Modeling", "Technical Skills"]


def test_language_detection(spark):
    df = rows(spark, ["the cat and the dog is in the house", "der Hund und die Katze", "", None])
    d = df.withColumn("t", E.tokenize_letters("x")).select(E.detect_language("t").alias("l"))
    assert [r.l for r in d.collect()] == ["English", "German", None, None]


def test_half_even_percentages(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3)], "m int, n int")
    out = [r.p for r in df.select(F.bround(F.col("m") / F.col("n") * 100.0, 1).alias("p")).collect()]
    assert out == [12.5, 33.3, 66.7]


def test_dictionary_matches_python_re_on_random_texts(spark):
    """Randomised texts dense with skills and tricky separators versus Python's ``re`` with ``\\b``."""
    import random
    import re

    rnd = random.Random(42)
    skills = [s for _, _, s in S.dictionary_entries()]
    plain = [s.replace("\\", "") for s in skills]
    seps = [" ", ", ", ".", "+", "#", "-", "/", "é", "_", "1", "\n", "(", ")", "", "  "]
    texts = []
    for _ in range(3000):
        parts = []
        for _ in range(rnd.randint(1, 8)):
            w = rnd.choice(plain + ["node-js", "ASPxNET", "gO", "r", "Javas", "C++x", "c#y", "data  analysis"])
            w = "".join(ch.upper() if rnd.random() < 0.3 else ch for ch in w)
            parts.append(w + rnd.choice(seps))
        texts.append("".join(parts))
    expected = [[s for s in skills if re.search(r"\b" + s + r"\b", t, re.IGNORECASE)] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r.i: r.s for r in df.select("i", S.extract_dictionary_skills("x").alias("s")).collect()}
    bad = [(texts[i], expected[i], got[i]) for i in range(len(texts)) if expected[i] != got[i]]
    assert not bad, bad[:5]


def test_section_extract_matches_python_re(spark):
    """N25 versus Python's ``re`` with the same fixed patterns (sections, tokens, case-sensitive tech names)."""
    import re

    texts = [
        "Summary\nSkills: Python, SQL; Docker | Kubernetes\n  more tools here\n• bullet\nWorked with React and Node.js daily.",
        "TECHNOLOGIES used: Go, Rust , C++ and PyTorch.\nAlso java (lower case) and Java.",
        "tools:a,bb,ccc\nNothing else. Experience with AWS, Azure and Git.",
        "No sections at all, just MongoDB and MySQL and PostgreSQL and pandas.",
        "",
    ]

    def expected(t):
        out = []
        for section in re.findall(S.SECTION_PATTERN, t):
            out.extend(s.strip() for s in re.findall(S.TOKEN_PATTERN, section) if len(s.strip()) > 2)
        out.extend(re.findall(S.TECH_PATTERN, t))
        seen = []
        for s in out:
            if s not in seen:
                seen.append(s)
        return seen

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r.i: r.s for r in df.select("i", S.skill_section_extract("x").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(t), (t, got[i], expected(t))


def test_insert_if_absent_rejects_existing_and_repeats(spark):
    from skillgrid.operators.joins import insert_if_absent
    existing = spark.createDataFrame([("ann",)], "username string")
    batch = spark.createDataFrame([("ann", 1), ("bob", 2), ("bob", 3), ("cy", 4)], "username string, user_id int")
    acc, rej = insert_if_absent(existing, batch, "username")
    assert sorted((r.username, r.user_id) for r in acc.collect()) == [("bob", 2), ("cy", 4)]
    assert sorted((r.username, r.user_id) for r in rej.collect()) == [("ann", 1), ("bob", 3)]


def test_section_extract_sql_twin_matches_spark(spark):
    """The DuckDB twin of N25 (word/non-word runs instead of \\b) equals Spark on section-rich texts."""
    import json

    import duckdb
    import pandas as pd

    import __spark_entry__ as E
    texts = [
        "Skills: Python, SQL; Docker | Kubernetes\n  more tools\n• bullet\nReact and Node.js, C++x and C++ daily.",
        "TECHNOLOGIES used: Go, Rust , C++ and PyTorch.\nAlso java and Java, JavaScript, Python,Java.",
        "tools:a,bb,ccc\nAWS, Azure and Git. éGo Goé Go!",
        "",
    ]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(range(len(texts))), "text": texts}))
    duck = {r[0]: json.loads(r[1]) for r in con.execute(E.oracle_sql()["skill_section_extract"]).fetchall()}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", S.skill_section_extract("text").alias("s")).collect()}
    assert duck == got
