"""Join operators.

Keyed updates become joins to a new table version (parquet has no in-place
MERGE); anti and semi joins run on keys asserted non-null so ``left_anti``
matches the null-aware ``NOT IN`` of the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def merge_update(target: DataFrame, source: DataFrame, key: str, set_col: str, value_col: str) -> DataFrame:
    """``MERGE ... WHEN MATCHED THEN UPDATE SET set_col = source.value_col``.

    The source is first reduced to one row per key (a duplicate title would
    make the warehouse MERGE ambiguous; here the smallest value wins, which is
    deterministic).  Unmatched target rows keep their value.
    """
    src = (source.filter(F.col(key).isNotNull())
           .groupBy(key).agg(F.min(value_col).alias("_new")))
    j = target.join(src, key, "left")
    return j.withColumn(set_col, F.coalesce(F.col("_new"), F.col(set_col))).drop("_new")


def incremental_new_only(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key is not yet in ``target`` (NOT IN, keys non-null)."""
    keys = target.select(key).filter(F.col(key).isNotNull()).distinct()
    return source.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")


def skip_processed(links: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    """Links not in the processed-key store."""
    return incremental_new_only(links, processed, key)


def insert_if_absent(existing: DataFrame, new_rows: DataFrame, key: str, order=None):
    """(accepted, rejected) new rows; a key already present, or repeated in the batch, is rejected.

    Within one batch the first row per key under ``order`` (default: the row's
    other columns) is accepted and later repeats are rejected.  The first row
    is a ``min`` over a struct (partial aggregation, so a hot key is combined
    map-side); the rejected rows are the batch minus the accepted ones
    (``exceptAll``, NULL-safe and duplicate-aware).
    """
    present = existing.select(key).filter(F.col(key).isNotNull()).distinct()
    others = [c for c in new_rows.columns if c != key]
    order = order or others
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in others])
    reps = new_rows.groupBy(key).agg(F.min(packed).alias("_r")).join(present, key, "left_anti")
    accepted = reps.select(key, *[F.col("_r")[c].alias(c) for c in others]).select(*new_rows.columns)
    rejected = new_rows.exceptAll(accepted)
    return accepted, rejected


def chained_models(df: DataFrame, name: str, predicate) -> DataFrame:
    """A model that selects from another model (a view) and filters it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name).filter(predicate)


def attach_default(keys: DataFrame, found: DataFrame, key: str, col: str, default) -> DataFrame:
    """W3 tail: left join + coalesce to a default when a key has no row."""
    return keys.join(found, key, "left").withColumn(col, F.coalesce(F.col(col), F.lit(default)))
