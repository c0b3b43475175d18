"""Keyed state as table versions.

Parquet has no in-place UPDATE/DELETE/MERGE, so every keyed change produces
the next version of the table as a DataFrame (anti-join + union, or a left
join + coalesce).  Writers overwrite a versioned location; readers read the
latest complete version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_by_key(target: DataFrame, updates: DataFrame, keys) -> DataFrame:
    """M1: rows of ``updates`` replace matching keys of ``target``; new keys are added.

    ``updates`` must hold one row per key (the incremental model's
    ``unique_key``); the target keeps every key that was not updated.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    kept = target.join(updates.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def delete_by_key(df: DataFrame, deletes: DataFrame, keys) -> DataFrame:
    """M2: drop rows whose (exact) key tuple appears in ``deletes``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(deletes.select(*keys).distinct(), keys, "left_anti")


def update_by_key(df: DataFrame, updates: DataFrame, key: str, col: str) -> DataFrame:
    """M3: set ``col`` for the keys present in ``updates`` (one value per key)."""
    upd = updates.select(key, F.col(col).alias("_new")).dropDuplicates([key])
    return df.join(upd, key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")


def append_rows(df: DataFrame, new_rows: DataFrame) -> DataFrame:
    """M4: append rows (schema matched by name)."""
    return df.unionByName(new_rows, allowMissingColumns=True)


def write_version(df: DataFrame, base_path: str, version: int) -> str:
    """A single writer overwrites ``base/v=<n>``; readers take the highest complete version."""
    path = f"{base_path.rstrip('/')}/v={version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_latest(spark, base_path: str, schema=None) -> DataFrame | None:
    """Load the newest written version (``_SUCCESS`` present) or None when empty."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base_path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    versions = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v="))
    for v in reversed(versions):
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base_path.rstrip('/')}/{v}/_SUCCESS")):
            reader = spark.read.schema(schema) if schema is not None else spark.read
            return reader.parquet(f"{base_path.rstrip('/')}/{v}")
    return None
