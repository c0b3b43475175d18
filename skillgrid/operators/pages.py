"""Page extraction over a stored ``pages`` table.

The crawl itself is not rebuilt; what the crawler did with each fetched page
is: links, ``og:url``, the JSON-LD course record and HTML fallbacks.  The
JSON-LD block is parsed into a VARIANT once per page and every field is a
``try_variant_get`` path, so a malformed block yields NULL fields instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skills import skill_stoplist
from ..functions.text import url_strip_query

HREF = r'href="([^"]*)"'
OG_URL = r'<meta[^>]*property="og:url"[^>]*content="([^"]*)"'
JSONLD = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
H1 = r"(?s)<h1[^>]*>(.*?)</h1>"
FIRST_P = r"(?s)<p[^>]*>(.*?)</p>"
LOCALE = r'(?s)<div[^>]*class="[^"]*clp-lead__locale[^"]*"[^>]*>(.*?)</div>'
TAGS = r"<[^>]+>"


def host_of(url) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, r"^(https?://[^/]+)", 1)


def extract_links(pages: DataFrame, markers=("",)) -> DataFrame:
    """H1 + N18 + N19 + A9: distinct absolute links per page whose href contains a marker."""
    hrefs = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href"))
    cond = None
    for m in markers:
        c = F.instr("href", m) > 0 if m else F.lit(True)
        cond = c if cond is None else cond | c
    links = hrefs.filter(cond).select(
        "page_id", url_strip_query(url_prefix_col(F.col("href"), host_of("url"))).alias("link"))
    return links.dropDuplicates(["page_id", "link"])


def url_prefix_col(href: Column, host: Column) -> Column:
    """N18 with a per-row host: relative paths get the page's host."""
    return F.when(href.startswith("/"), F.concat(host, href)).otherwise(href)


def meta_url(html, missing: str = "N/A") -> Column:
    """H2: ``og:url`` content, else the provider's missing marker."""
    h = F.col(html) if isinstance(html, str) else html
    return F.coalesce(F.nullif(F.regexp_extract(h, OG_URL, 1), F.lit("")), F.lit(missing))


def jsonld(html) -> Column:
    """The first JSON-LD block parsed as VARIANT (NULL when absent or malformed)."""
    h = F.col(html) if isinstance(html, str) else html
    body = F.nullif(F.trim(F.regexp_extract(h, JSONLD, 1)), F.lit(""))
    return F.try_parse_json(body)


def _vs(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def jsonld_course(pages: DataFrame) -> DataFrame:
    """H3: course record from JSON-LD (second ``@graph`` element when there are >= 2, else the object)."""
    v = F.col("_ld")
    graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
    course = F.when(_is_object(v) & (F.size(graph) > 1), graph[1]).when(_is_object(v), v)
    df = pages.withColumn("_ld", jsonld("html")).withColumn("_c", course)
    c = F.col("_c")
    na = F.lit("N/A")

    def listy(path):
        as_list = F.try_variant_get(c, path, "array<string>")
        as_str = _vs(c, path)
        absent = F.try_variant_get(c, path, "variant").isNull()
        return (F.when(absent, F.lit("")).when(as_list.isNotNull(), F.array_join(as_list, ", "))
                .otherwise(F.coalesce(F.nullif(as_str, F.lit("")), na)))

    inst = F.try_variant_get(c, "$.hasCourseInstance", "array<variant>")
    dur = F.when(F.size(inst) > 0, F.coalesce(_vs(inst[0], "$.courseWorkload"), na)).otherwise(na)
    fields = {
        "course_name": F.coalesce(_vs(c, "$.name"), na),
        "description": F.coalesce(_vs(c, "$.description"), na),
        "level": F.coalesce(_vs(c, "$.educationalLevel"), na),
        "prerequisites": listy("$.coursePrerequisites"),
        "duration": dur,
        "language": F.coalesce(_vs(c, "$.inLanguage"), na),
        "skills": listy("$.about"),
        "rating": F.coalesce(_vs(c, "$.aggregateRating.ratingValue"), na),
    }
    return df.select("page_id", meta_url("html", "N/A").alias("url"),
                     *[F.when(c.isNotNull(), e).alias(k) for k, e in fields.items()])


def _capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def jsonld_course_edx(pages: DataFrame) -> DataFrame:
    """H4: edX rules over the JSON-LD object (provider, level, duration, skills, prerequisites)."""
    df = pages.withColumn("_ld", jsonld("html"))
    v = F.col("_ld")
    nf = F.lit("Not found")
    providers = F.try_variant_get(v, "$.provider", "array<variant>")
    college = F.filter(providers, lambda p: _vs(p, "$['@type']") == "CollegeOrUniversity")
    institution = (F.when(F.size(providers) > 0, F.coalesce(_vs(college[0], "$.name"), nf))
                   .otherwise(F.coalesce(_vs(v, "$.provider.name"), nf)))
    lvl = _vs(v, "$.educationalLevel")
    level = F.when(F.coalesce(lvl, F.lit("")) != "", _capitalize(lvl)).otherwise(nf)
    tr = _vs(v, "$.timeRequired")
    tr_kind = F.schema_of_variant(F.try_variant_get(v, "$.timeRequired", "variant"))
    # A string or an integer (a JSON boolean counts as one) takes the first branch; a
    # float or an object falls through to the repeat-count search, as in the reference.
    tr_ok = tr.isNotNull() & tr_kind.isin("STRING", "BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN")
    repeat = F.filter(F.transform(F.try_variant_get(v, "$.hasCourseInstance", "array<variant>"),
                                  lambda i: _vs(i, "$.courseSchedule.repeatCount")),
                      lambda r: r.rlike("^[0-9]+$"))
    duration = (F.when(tr_ok & tr.contains("PT"), nf)
                .when(tr_ok & tr.rlike("^[0-9]+$"), F.concat(tr, F.lit(" weeks")))
                .when(tr_ok, nf)
                .when(F.size(repeat) > 0, F.concat(repeat[0], F.lit(" weeks")))
                .otherwise(nf))
    about = F.try_variant_get(v, "$.about", "array<variant>")
    about_skills = F.filter(F.transform(about, lambda a: F.trim(_vs(a, "$.skill"))), lambda s: s.isNotNull() & (s != ""))
    assoc = F.when(about.isNotNull(), skill_stoplist(about_skills)).otherwise(nf)
    grow_list = F.coalesce(F.try_variant_get(v, "$.skills", "array<string>"), F.try_variant_get(v, "$.teaches", "array<string>"))
    grow_str = F.coalesce(_vs(v, "$.skills"), _vs(v, "$.teaches"))
    grow = (F.when(grow_list.isNotNull(), skill_stoplist(grow_list))
            .when(grow_str.isNotNull(), skill_stoplist(F.split(grow_str, ",")))
            .otherwise(nf))
    pre = F.try_variant_get(v, "$.coursePrerequisites", "array<string>")
    pre_s = _vs(v, "$.coursePrerequisites")
    # A plain string is indexed like a list in the reference: its first character.
    first = F.when(pre.isNotNull(), pre[0]).otherwise(F.substring(pre_s, 1, 1))
    prereq = F.when((F.coalesce(F.size(pre), F.length(pre_s)) > 0) & (first != "Not found"), first).otherwise(nf)
    rating = F.coalesce(_vs(v, "$.aggregateRating.ratingValue"), nf)
    language = F.coalesce(_vs(v, "$.inLanguage"), _vs(v, "$.availableLanguage"), nf)
    ok = v.isNotNull()
    return df.select(
        "page_id", meta_url("html", "Not found").alias("url"),
        *[F.when(ok, e).otherwise(nf).alias(k) for k, e in {
            "institution": institution, "level": level, "duration": duration, "rating": rating,
            "associated_skills": assoc, "grow_these_skills": grow, "prerequisites": prereq, "language": language,
        }.items()],
        F.lit("$199.2").alias("price"))  # fixed value: every such course has this price


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, TAGS, ""), r"\s+", " "))


def html_fallbacks(pages: DataFrame) -> DataFrame:
    """H5: first ``h1`` text, first paragraph text and locale text (tags stripped)."""
    h = F.col("html")
    return pages.select(
        "page_id",
        F.coalesce(F.nullif(strip_tags(F.regexp_extract(h, H1, 1)), F.lit("")), F.lit("Not found")).alias("course_name"),
        F.coalesce(F.nullif(strip_tags(F.regexp_extract(h, FIRST_P, 1)), F.lit("")), F.lit("Not found")).alias("description"),
        F.coalesce(F.nullif(strip_tags(F.regexp_extract(h, LOCALE, 1)), F.lit("")), F.lit("N/A")).alias("course_language"))


def page_text_quality(pages: DataFrame) -> DataFrame:
    """H6: keep pages that have content and some metadata (an ``h1`` or a JSON-LD block)."""
    h = F.col("html")
    has_content = h.isNotNull() & (F.length(F.trim(h)) > 0)
    has_meta = h.rlike(r"(?s)<h1[^>]*>.*?</h1>") | h.rlike(r'application/ld\+json')
    return pages.filter(has_content & has_meta)
