"""Source/sink, semi-structured and keyed-store queries.

Each query first lands files derived from the driver's tables in a fresh
folder under the shared checkpoint directory (the stand-in for the provider
drops), then runs the library's reader over them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json as JS
from ..sources import files as FS
from ..sources.keyed import KeyedTable
from ..sources.materialize import materialize
from ..session import scratch_path
from . import fixtures as X
from .fixture_sql import COURSES, RAW_PROVIDERS, with_catalog, with_courses
from .registry import catalog, register


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


LANG_NAME = ("CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' "
             "WHEN 'es' THEN 'Español' END")


def _lang_name(c):
    return (F.when(c == "en", "English").when(c == "de", "Deutsch").when(c == "fr", "Français")
            .when(c == "es", "Español"))


@register("csv_union", with_courses() + f"""
SELECT CAST(id AS INTEGER) AS id, course_name, rating_raw AS rating, NULL AS description, NULL AS language FROM courses WHERE platform = 'Udemy'
UNION ALL SELECT CAST(id AS INTEGER), course_name, NULL, description, NULL FROM courses WHERE platform = 'Udacity'
UNION ALL SELECT CAST(id AS INTEGER), course_name, NULL, NULL, {LANG_NAME} FROM courses WHERE platform = 'edX'""")
def csv_union(spark, sf_dir, source_col=None):
    """S1 + S2 + S4 + U3: provider CSVs (one latin-1, with ``Unnamed: 0`` index columns) read and unioned by name."""
    c = X.courses(spark, sf_dir)
    d = _fresh(spark, "csv")
    udemy = c.filter(F.col("platform") == "Udemy").select(F.col("id").alias("Unnamed: 0"), "id", "course_name",
                                                          F.col("rating_raw").alias("rating"))
    udacity = c.filter(F.col("platform") == "Udacity").select("id", "course_name", "description")
    edx = c.filter(F.col("platform") == "edX").select(F.col("id").alias("Unnamed: 0"), "id", "course_name",
                                                      _lang_name(F.col("lang")).alias("language"))
    for name, df, enc in (("udemy", udemy, "UTF-8"), ("udacity", udacity, "UTF-8"), ("edx", edx, "ISO-8859-1")):
        (df.write.mode("overwrite").option("header", True).option("encoding", enc)
         .option("quote", '"').option("escape", '"').csv(f"{d}/{name}"))
    # descriptions hold line ends inside quotes
    out = FS.read_csv_folder(spark, [f"{d}/{name}" for name in ("udemy", "udacity", "edx")], source_col=source_col, multi_line=True)
    cols = [F.col("id").cast("int").alias("id"), "course_name", F.col("rating").cast("string").alias("rating"),
            "description", "language"]
    return out.select(*cols, *([source_col] if source_col else []))


@register("csv_gzip_sink", with_catalog() + "\nSELECT id, course_name, platform FROM catalog")
def csv_gzip_sink(spark, sf_dir):
    """S3: the catalogue written as gzip CSV and read back."""
    d = _fresh(spark, "gz")
    FS.write_csv(catalog(spark, sf_dir).select("id", "course_name", "platform"), d, gzip=True)
    return spark.read.option("header", True).option("escape", '"').csv(d)


def _udacity_json_drop(spark, sf_dir):
    """JSON array files of Udacity records (100 per file), one truncated file, one single-object file."""
    c = X.udacity_raw(X.courses(spark, sf_dir))
    rec = F.struct(*[F.col(f"`{k}`").alias(k) for k in ("URL", "Course Name", "Description", "Level", "Prerequisites",
                                                         "Duration", "Language", "Skills", "Rating")])
    ordered = F.array_sort(F.collect_list(F.struct(F.col("doc_id"), rec.alias("r"))))
    text = (c.withColumn("batch", F.floor(F.col("doc_id") / 100)).groupBy("batch")
            .agg(F.to_json(F.transform(ordered, lambda e: e["r"])).alias("value")))
    text = text.select("batch", F.when(F.col("batch") == 0, F.substring("value", 1, 50)).otherwise(F.col("value")).alias("value"))
    d = _fresh(spark, "json")
    text.write.partitionBy("batch").text(d)
    return d


@register("json_variant_load", with_courses() + """
SELECT 'https://www.udacity.com' || url_path AS url, course_name FROM courses WHERE platform = 'Udacity' AND id >= 100""")
def json_variant_load(spark, sf_dir):
    """JSON array files loaded into one VARIANT column, one row per element; the malformed file is skipped."""
    d = _udacity_json_drop(spark, sf_dir)
    raw = FS.read_json_variant(spark, d)
    return raw.select(F.try_variant_get("raw_content", "$.URL", "string").alias("url"),
                      F.try_variant_get("raw_content", '$["Course Name"]', "string").alias("course_name"))


@register("json_fixed_append", "WITH " + COURSES + "," + RAW_PROVIDERS + """
SELECT url AS "URL", cname AS "Course Name", descr AS "Description", lvl AS "Level", pre AS "Prerequisites",
       dur AS "Duration", language AS "Language", skills AS "Skills", rating AS "Rating" FROM udacity_raw WHERE doc_id >= 100
UNION ALL
SELECT 'https://www.edx.org' || url_path, course_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM courses WHERE platform = 'edX'""")
def json_fixed_append(spark, sf_dir):
    """Records mapped to the nine landing columns (absent -> NULL) and appended to the landing table."""
    d = _udacity_json_drop(spark, sf_dir)
    landing = FS.project_landing(FS.read_json_variant(spark, d))
    # A later drop holding a single object counts as a one-element list.
    single = X.courses(spark, sf_dir).filter(F.col("platform") == "edX").select(
        F.to_json(F.struct(F.concat(F.lit("https://www.edx.org"), "url_path").alias("URL"),
                           F.col("course_name").alias("Course Name"))).alias("value"))
    d2 = _fresh(spark, "json1")
    single.write.text(d2)
    more = FS.project_landing(spark.read.text(d2).select(F.try_parse_json("value").alias("raw_content")))
    return landing.unionByName(more)


@register("json_append_sink", with_courses() + "\nSELECT id, course_name, platform FROM courses")
def json_append_sink(spark, sf_dir):
    """Two batches appended to one JSON dataset and read back."""
    c = X.courses(spark, sf_dir).select("id", "course_name", "platform")
    d = _fresh(spark, "jsonl")
    FS.append_json(c.filter(F.col("platform") == "Udemy"), d)
    FS.append_json(c.filter(F.col("platform") != "Udemy"), d)
    return spark.read.schema("id long, course_name string, platform string").json(d)


@register("state_key_store", """
SELECT DISTINCT regexp_replace(url, '\\?.*', '') AS url FROM pages""")
def state_key_store(spark, sf_dir):
    """Processed-key set in a keyed table with a commit log; each batch adds the keys that are not there."""
    keys = X._t(spark, sf_dir, "pages", "page_id", "url").select(F.regexp_replace("url", r"\?.*", "").alias("url"))
    table = KeyedTable(spark, _fresh(spark, "keys"), "url string", "url")
    table.insert_new(keys.filter(F.col("url") < "m"))
    table.insert_new(keys)
    return table.read()


@register("scan_limit", with_courses() + "\nSELECT id, course_name FROM courses ORDER BY id LIMIT 100")
def scan_limit(spark, sf_dir):
    """Projected sample of 100 rows, ordered by key."""
    return FS.scan_limit(X.courses(spark, sf_dir), ["id", "course_name"], "id", 100)


RATINGS_LATEST = """
WITH ratings AS (
  SELECT user_id, 'skill_' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS skill,
         CAST(1 + event_id % 5 AS INTEGER) AS rating, ts, event_id
  FROM events WHERE event_type = 'view'
), latest AS (
  SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY user_id, skill ORDER BY ts DESC, event_id DESC) = 1
)"""


@register("append_nested", RATINGS_LATEST + """
SELECT user_id, count(*) AS n_skills, CAST(sum(rating) AS BIGINT) AS rating_sum FROM latest GROUP BY user_id""")
def append_nested(spark, sf_dir):
    """Learning-path rows with SKILL_RATINGS as JSON text parsed to map<string,int> and appended."""
    from .q_relational import latest_ratings
    lr = latest_ratings(spark, sf_dir)
    rows = lr.groupBy("user_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("skill", "rating"))))).alias("skill_ratings"))
    out = FS.append_nested(None, rows, {"skill_ratings": "map<string,int>"})
    vals = F.map_values("skill_ratings")
    return out.select("user_id", F.size(vals).cast("long").alias("n_skills"),
                      F.aggregate(vals, F.lit(0).cast("long"), lambda a, x: a + x).alias("rating_sum"))


@register("incremental_table", with_courses() + """
SELECT id, course_name, CASE WHEN level_raw = 'All Levels' THEN 'first run' ELSE 'second run' END AS run FROM courses""")
def incremental_table(spark, sf_dir):
    """S11 incremental (+J2): two runs of a model; the second adds the keys that the first did not hold."""
    c = X.courses(spark, sf_dir).select("id", "course_name", "level_raw")
    name = f"incremental-{uuid.uuid4().hex}"
    materialize(c.filter(F.col("level_raw") == "All Levels").select("id", "course_name", F.lit("first run").alias("run")), name, "incremental", "id")
    return materialize(c.select("id", "course_name", F.lit("second run").alias("run")), name, "incremental", "id")


@register("keyed_upsert", with_courses() + """
SELECT id, CASE WHEN p_size % 3 = 0 THEN 'new ' || level_raw ELSE level_raw END AS level, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS step
FROM courses JOIN part ON p_partkey = id WHERE p_size % 5 <> 1""")
def keyed_upsert(spark, sf_dir):
    """M1 + M2 stored: two updates a key in one batch (the later step wins), then deletes; only touched buckets are written."""
    p = X._t(spark, sf_dir, "part", "p_partkey", "p_size").withColumnRenamed("p_partkey", "id")
    c = X.courses(spark, sf_dir).select("id", F.col("level_raw").alias("level"), F.lit(0).alias("step")).join(p, "id")
    table = KeyedTable(spark, _fresh(spark, "levels"), "id long, level string, step int", "id")
    table.insert_new(c)
    later = c.filter(F.col("p_size") % 3 == 0)
    table.upsert(later.withColumn("step", F.lit(1)).unionByName(
        later.select("id", F.concat(F.lit("new "), "level").alias("level"), F.lit(2).alias("step"), "p_size")), order=["step"])
    table.delete(c.filter(F.col("p_size") % 5 == 1))
    return table.read()


@register("materialize", with_catalog() + "\nSELECT platform, count(*) AS n FROM catalog GROUP BY platform")
def materialize_model(spark, sf_dir):
    """The catalogue as a view, a table (parquet in the shared folder) and a checkpoint."""
    cat = catalog(spark, sf_dir)
    view = materialize(cat.select("platform"), "catalog_platforms", "view")
    table = materialize(spark.table("catalog_platforms"), f"catalog_platforms@{sf_dir}", "table")
    counted = materialize(table.groupBy("platform").agg(F.count(F.lit(1)).alias("n")), "catalog_platform_counts",
                          "checkpoint")
    del view
    return counted


@register("lateral_flatten", """
SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part, l_returnflag AS flag FROM lineitem""")
def lateral_flatten(spark, sf_dir):
    """Search-response-like JSON per order, unnested twice (object entries, then array elements)."""
    li = X._t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    docs = li.groupBy("l_orderkey").agg(F.to_json(F.struct(
        F.col("l_orderkey").alias("order"),
        F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                                F.col("l_returnflag").alias("flag"))).alias("results"))).alias("response"))
    flat = JS.lateral_flatten(docs, "response", "results", {"line": "int", "part": "bigint", "flag": "string"})
    return flat.select(F.element_at("entries", F.lit("order")).cast("bigint").alias("order_key"), "line", "part", "flag")


@register("variant_project", with_courses() + """
SELECT id, 'https://www.udacity.com' || url_path AS url, course_name, iso_duration AS duration FROM courses WHERE platform = 'Udacity'""")
def variant_project(spark, sf_dir):
    """Typed path access out of a dynamic column, including keys with spaces."""
    rec = X.udacity_raw(X.courses(spark, sf_dir))
    v = rec.select(F.col("doc_id").alias("id"), F.parse_json(F.to_json(F.struct(
        "URL", "`Course Name`", "Duration"))).alias("raw_content"))
    return v.select("id", F.try_variant_get("raw_content", "$.URL", "string").alias("url"),
                    F.try_variant_get("raw_content", '$["Course Name"]', "string").alias("course_name"),
                    F.try_variant_get("raw_content", "$.Duration", "string").alias("duration"))


@register("json_roundtrip", "SELECT event_id, CAST(json(props) AS VARCHAR) AS props_json, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_roundtrip(spark, sf_dir):
    """JSON text parsed to an object and serialised back."""
    e = X._t(spark, sf_dir, "events", "event_id", "props")
    m = JS.parse_object(F.col("props"), "map<string,int>")
    return e.select("event_id", F.to_json(m).alias("props_json"), F.element_at(m, F.lit("k")).alias("k"))


@register("session_preview", r"""
WITH sessions AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(floor(turn / 5) AS BIGINT) AS session,
         CAST(to_json(list({'role': role, 'content': text} ORDER BY turn)) AS VARCHAR) AS chat_history
  FROM conversations GROUP BY conv_id, floor(turn / 5)
  UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR), props FROM events
), j AS (
  SELECT session, CASE WHEN json_valid(chat_history) THEN json(chat_history) END AS v FROM sessions
), k AS (
  SELECT session, v, json_type(v) AS kind,
         list_filter(json_keys(v), lambda key: json_type(v, '$."' || key || '"') = 'VARCHAR'
                     AND length(json_extract_string(v, '$."' || key || '"')) > 10) AS str_keys
  FROM j
)
SELECT session, CASE
  WHEN kind = 'ARRAY' AND json_array_length(v) > 0 THEN
       coalesce(substr(json_extract_string(v, '$[#-1].content'), 1, 80) || '...', '(preview error: ''content'')')
  WHEN kind = 'OBJECT' AND json_type(v, '$.ct_messages') = 'ARRAY' AND json_array_length(v, '$.ct_messages') > 0 THEN
       coalesce(substr(json_extract_string(v, '$.ct_messages[#-1].content'), 1, 80) || '...', '(preview error: ''content'')')
  WHEN kind = 'OBJECT' AND json_type(v, '$.lp_messages') = 'ARRAY' AND json_array_length(v, '$.lp_messages') > 0 THEN
       coalesce(substr(json_extract_string(v, '$.lp_messages[#-1].content'), 1, 80) || '...', '(preview error: ''content'')')
  WHEN kind = 'OBJECT' AND len(str_keys) > 0 THEN substr(json_extract_string(v, '$."' || str_keys[1] || '"'), 1, 80) || '...'
  WHEN kind = 'OBJECT' THEN 'Session: ' || coalesce(json_extract_string(v, '$.current_page'), 'Unknown') || ' ('
       || CAST(len(json_keys(v)) AS VARCHAR) || ' values)'
  ELSE '(empty or invalid chat data)' END AS preview
FROM k""")
def session_preview(spark, sf_dir):
    """Preview of every stored session (conversation lists and state objects)."""
    conv = X._t(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    # A conversation is stored as sessions of five turns each (bounded groups by construction).
    chunk = F.floor(F.col("turn") / 5)
    lists = conv.groupBy("conv_id", chunk.alias("chunk")).agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
        lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content")))).alias("chat_history"))
    ev = X.sessions_from_events(spark, sf_dir).select(F.col("event_id").alias("conv_id"), "chat_history")
    sessions = lists.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("chunk").cast("string"))
                            .alias("session"), "chat_history") \
        .unionByName(ev.select(F.concat(F.lit("e"), F.col("conv_id").cast("string")).alias("session"), "chat_history"))
    return sessions.select("session", JS.session_preview("chat_history").alias("preview"))
