"""JSON and VARIANT helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW_LEN = 80


def parse_object(text: Column, schema: str) -> Column:
    """JSON text -> typed object (NULL when malformed)."""
    return F.from_json(text, schema)


def lateral_flatten(df: DataFrame, col: str, array_key: str, fields: dict) -> DataFrame:
    """Object -> its entries -> elements of the array entry, each element's fields as columns.

    First level: the document's entries (``from_json`` to ``map<string,variant>``,
    exploded); second level: the elements of the ``array_key`` entry
    (``posexplode``).  Scalar entries of the object are carried along as a map.
    """
    obj = df.select(F.from_json(col, "map<string,variant>").alias("_o"))
    entries = obj.select("_o", F.explode("_o").alias("k", "k_val"))
    arrays = entries.filter(F.col("k") == array_key).select(
        "_o", F.posexplode(F.try_variant_get("k_val", "$", "array<variant>")).alias("pos", "elem"))
    scalars = F.map_filter("_o", lambda k, v: k != array_key)
    return arrays.select(
        F.transform_values(scalars, lambda k, v: F.try_variant_get(v, "$", "string")).alias("entries"), "pos",
        *[F.try_variant_get("elem", f"$.{f}", t).alias(f) for f, t in fields.items()])


def session_preview(text) -> Column:
    """Preview (<= 80 characters + ``...``) of a stored session JSON.

    list -> last message's content; object -> last ``ct_messages`` content,
    else last ``lp_messages`` content, else the first string value longer than
    10 characters (key order), else ``Session: <current_page> (<n> values)``;
    malformed or other JSON -> the empty marker.
    """
    t = F.col(text) if isinstance(text, str) else text
    v = F.try_parse_json(t)
    kind = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<variant>")
    obj = F.from_json(t, "map<string,variant>")

    def last_content(a: Column) -> Column:
        return F.try_variant_get(F.element_at(a, -1), "$.content", "string")

    def cut(s: Column) -> Column:
        return F.concat(F.substring(s, 1, PREVIEW_LEN), F.lit("..."))

    ct = F.try_variant_get(v, "$.ct_messages", "array<variant>")
    lp = F.try_variant_get(v, "$.lp_messages", "array<variant>")
    strings = F.filter(F.map_entries(obj), lambda e: F.schema_of_variant(e["value"]).startswith("STRING")
                       & (F.length(F.try_variant_get(e["value"], "$", "string")) > 10))
    first_str = F.try_variant_get(strings[0]["value"], "$", "string")
    page = F.coalesce(F.try_variant_get(v, "$.current_page", "string"), F.lit("Unknown"))
    fallback = F.concat(F.lit("Session: "), page, F.lit(" ("), F.size(F.map_keys(obj)).cast("string"), F.lit(" values)"))
    err = F.lit("(preview error: 'content')")
    return (F.when(kind.startswith("ARRAY") & (F.size(arr) > 0),
                   F.when(last_content(arr).isNotNull(), cut(last_content(arr))).otherwise(err))
            .when(kind.startswith("OBJECT") & (F.size(ct) > 0),
                  F.when(last_content(ct).isNotNull(), cut(last_content(ct))).otherwise(err))
            .when(kind.startswith("OBJECT") & (F.size(lp) > 0),
                  F.when(last_content(lp).isNotNull(), cut(last_content(lp))).otherwise(err))
            .when(kind.startswith("OBJECT") & (F.size(strings) > 0), cut(first_str))
            .when(kind.startswith("OBJECT"), fallback)
            .otherwise(F.lit("(empty or invalid chat data)")))
