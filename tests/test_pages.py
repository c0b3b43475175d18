"""JSON-LD and HTML extraction on an inline frame of six pages (the driver's pages carry no JSON-LD)."""

import json

from skillgrid.operators import pages as P


def _page(ld):
    return ('<html><head><meta property="og:url" content="https://x.org/c/1"/>'
            f'<script type="application/ld+json">{ld}</script></head>'
            '<body><h1 class="t">Title <b>X</b></h1><p>Desc</p></body></html>')


def frame(spark):
    graph = json.dumps({"@graph": [{"@type": "Org"}, {
        "name": "Deep", "description": "D", "educationalLevel": "beginner", "coursePrerequisites": ["A", "B"],
        "hasCourseInstance": [{"courseWorkload": "P3M"}], "inLanguage": "en", "about": ["x", "y"],
        "aggregateRating": {"ratingValue": 4.5}}]})
    obj = json.dumps({"name": "Obj", "coursePrerequisites": "Python", "about": "SQL", "timeRequired": "5",
                      "provider": [{"@type": "Org", "name": "no"}, {"@type": "CollegeOrUniversity", "name": "MIT"}],
                      "educationalLevel": "INTERMEDIATE"})
    skills = json.dumps({"skills": ["Data Day", "Python"], "timeRequired": "PT13H",
                         "hasCourseInstance": [{"courseSchedule": {"repeatCount": 7}}],
                         "about": [{"skill": "Learn X"}, {"skill": "Spark"}]})
    floaty = json.dumps({"timeRequired": 5.0, "hasCourseInstance": [{"courseSchedule": {"repeatCount": 9}}]})
    inty = json.dumps({"timeRequired": 3, "coursePrerequisites": ["Not found"], "inLanguage": "fr"})
    rows = [(1, "u", _page(graph)), (2, "u", _page(obj)), (3, "u", _page("{bad json")),
            (4, "u", "<html><h1>Only</h1></html>"), (5, "u", _page(skills)), (6, "u", ""),
            (7, "u", _page(floaty)), (8, "u", _page(inty))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_jsonld_course(spark):
    out = {r.page_id: r for r in P.jsonld_course(frame(spark)).collect()}
    assert (out[1].course_name, out[1].level, out[1].prerequisites, out[1].duration, out[1].skills, out[1].rating) == \
        ("Deep", "beginner", "A, B", "P3M", "x, y", "4.5")
    assert (out[2].course_name, out[2].prerequisites, out[2].skills, out[2].description) == ("Obj", "Python", "SQL", "N/A")
    assert out[3].course_name is None and out[3].url == "https://x.org/c/1"
    assert out[4].url == "N/A" and out[6].course_name is None


def test_jsonld_course_edx(spark):
    out = {r.page_id: r for r in P.jsonld_course_edx(frame(spark)).collect()}
    assert (out[2].institution, out[2].level, out[2].duration, out[2].prerequisites) == ("MIT", "Intermediate", "5 weeks", "P")
    assert (out[5].duration, out[5].associated_skills, out[5].grow_these_skills) == ("Not found", "Spark", "Python")
    assert out[1].institution == "Not found" and out[3].level == "Not found"
    assert out[7].duration == "9 weeks"            # a float is neither str nor int: repeat-count branch
    assert (out[8].duration, out[8].prerequisites, out[8].language) == ("3 weeks", "Not found", "fr")


def test_html_fallbacks_and_quality(spark):
    f = frame(spark)
    out = {r.page_id: r for r in P.html_fallbacks(f).collect()}
    assert out[1].course_name == "Title X" and out[1].description == "Desc" and out[6].course_name == "Not found"
    assert sorted(r.page_id for r in P.page_text_quality(f).collect()) == [1, 2, 3, 4, 5, 7, 8]


def test_links_absolute_and_distinct(spark):
    html = '<a href="/a?x=1">a</a><a href="/a">a</a><a href="https://o.org/b">b</a>'
    df = spark.createDataFrame([(1, "https://h.com/p?q", html)], "page_id long, url string, html string")
    assert sorted(r.link for r in P.extract_links(df).collect()) == ["https://h.com/a", "https://o.org/b"]


def test_jsonld_course_sql_twin_on_inline_pages(spark):
    """The DuckDB twin of H3 gives the same rows as Spark on the inline JSON-LD pages."""
    import duckdb

    import __spark_entry__ as E
    f = frame(spark)
    con = duckdb.connect()
    pdf = f.toPandas()
    con.register("pages", pdf)
    rel = con.execute(E.oracle_sql()["jsonld_course"])
    cols = [d[0] for d in rel.description]
    duck = sorted(tuple(str(v) for v in r) for r in rel.fetchall())
    got = P.jsonld_course(f).select(*cols)
    sp = sorted(tuple(str(v) for v in r) for r in got.collect())
    assert duck == sp


def test_jsonld_course_edx_sql_twin_on_inline_pages(spark):
    """The DuckDB twin of H4 gives the same rows as Spark on the inline JSON-LD pages."""
    import duckdb

    import __spark_entry__ as E
    f = frame(spark)
    con = duckdb.connect()
    con.register("pages", f.toPandas())
    rel = con.execute(E.oracle_sql()["jsonld_course_edx"])
    cols = [d[0] for d in rel.description]
    duck = sorted(tuple(str(v) for v in r) for r in rel.fetchall())
    sp = sorted(tuple(str(v) for v in r) for r in P.jsonld_course_edx(f).select(*cols).collect())
    assert duck == sp
