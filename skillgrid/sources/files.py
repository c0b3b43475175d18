"""File sources and sinks.

CSV and JSON are the only formats the reference lands.  Readers here are
plain ``spark.read`` calls; the work the reference did file by file in pandas
(encoding fallback, ``Unnamed`` column drop, union by name) is expressed as
Spark jobs over all files at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII")

# The nine string columns of the crawler's landing table.
LANDING_COLUMNS = ("URL", "Course Name", "Description", "Level", "Prerequisites", "Duration",
                   "Language", "Skills", "Rating")


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """File names under ``path`` (metadata only, through the Hadoop filesystem)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().toString()
        base = st.getPath().getName()
        if st.isFile() and not base.startswith(("_", ".")) and base.endswith(suffix):
            out.append(name)
    return sorted(out)


def csv_layouts(spark: SparkSession, paths) -> DataFrame:
    """Per file its encoding (the first of UTF-8 / ISO-8859-1 / ASCII that decodes it) and its header line.

    Lines are read as raw bytes and judged in parallel, one row per file comes
    out of a partial aggregate.  A file is UTF-8 when every line is valid
    UTF-8; ISO-8859-1 decodes any byte sequence, so it is the answer otherwise
    (the ASCII branch of the reference can never be reached).  The header is
    the line at the file's first byte.
    """
    lines = (spark.read.text(paths)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("n"), "value"))
    per_file = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
                                         F.min_by(F.col("value").cast("binary"), F.struct("block", "n")).alias("header"))
    encoding = F.when(F.col("utf8"), ENCODINGS[0]).otherwise(ENCODINGS[1])
    header = F.when(F.col("utf8"), F.decode("header", ENCODINGS[0])).otherwise(F.decode("header", ENCODINGS[1]))
    return per_file.select("file", encoding.alias("encoding"), header.alias("header"))


def detect_encodings(spark: SparkSession, paths) -> DataFrame:
    """File, encoding."""
    return csv_layouts(spark, paths).select("file", "encoding")


def read_csv_folder(spark: SparkSession, paths, drop_prefix: str = "Unnamed", source_col: str | None = None,
                    multi_line: bool = False) -> DataFrame:
    """S1 + S2 + S4 + U3: the CSV files of one or more folders, header and types inferred, ``Unnamed*``
    columns dropped, stacked with union-by-name (missing columns -> NULL).

    Files with one layout (encoding and header line) are read by one scan, so
    the plan grows with the layouts; a layout's list of files is what Spark's
    own file index holds anyway.  ``multi_line`` is for files whose quoted
    fields hold line ends; without it large files are split among tasks.
    """
    layouts = csv_layouts(spark, paths).groupBy("encoding", "header").agg(F.array_sort(F.collect_list("file")).alias("files"))
    frames = []
    for row in layouts.orderBy(F.col("files")[0]).collect():          # the first file's spelling names the columns
        df = (spark.read.option("header", True).option("inferSchema", True).option("encoding", row.encoding)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(row.files))
        keep = [F.col(f"`{c}`") for c in df.columns if not c.startswith(drop_prefix)]
        if source_col:
            keep.append(F.col("_metadata.file_path").alias(source_col))
        frames.append(df.select(*keep))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """S3: CSV (optionally gzip) sink with a header."""
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


def read_json_variant(spark: SparkSession, path: str, column: str = "raw_content") -> DataFrame:
    """JSON array files into one VARIANT column, one row per array element; bad files skipped.

    Each file is read as text, parsed with ``try_parse_json`` (malformed ->
    NULL, dropped), and an outer array is exploded to its elements; a single
    object is kept as one row.
    """
    docs = spark.read.option("wholetext", True).text(path)
    v = docs.select(F.try_parse_json("value").alias("v")).filter(F.col("v").isNotNull())
    is_array = F.schema_of_variant("v").startswith("ARRAY")
    elems = F.when(is_array, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return v.select(F.explode(elems).alias(column))


def project_landing(raw: DataFrame, column: str = "raw_content") -> DataFrame:
    """S6 + P1: variant records -> the nine fixed string columns (absent key -> NULL)."""
    v = F.col(column)
    return raw.select(*[F.try_variant_get(v, f'$["{c}"]', "string").alias(c) for c in LANDING_COLUMNS])


def append_json(df: DataFrame, path: str) -> None:
    """Append records to a JSON dataset folder (no read-modify-write of old files)."""
    df.write.mode("append").json(path)


def scan_limit(df: DataFrame, cols, key: str, n: int = 100) -> DataFrame:
    """Projected scan with a deterministic LIMIT (ordered by key)."""
    return df.select(*cols).orderBy(key).limit(n)


def append_nested(target: DataFrame | None, rows: DataFrame, json_cols: dict) -> DataFrame:
    """Rows whose JSON-text columns are parsed to typed arrays/maps, appended to ``target``."""
    parsed = rows
    for c, schema in json_cols.items():
        parsed = parsed.withColumn(c, F.from_json(F.col(c), schema))
    return parsed if target is None else target.unionByName(parsed, allowMissingColumns=True)
