"""Window, sort and top-k operators.

Top-k per group is written as ``row_number() <= k`` so Spark inserts a
partial ``WindowGroupLimit`` before the exchange: every map task keeps at most
k rows per group, which bounds the shuffle even when one group holds a third
of the table.  Global ordinals (W2) avoid a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.materialize import stored

LEVEL_ORDER = ("BEGINNER", "INTERMEDIATE", "ADVANCED")


def top_k_per_group(df: DataFrame, keys, order, k: int, rank_col: str = "rn") -> DataFrame:
    """Keep the first ``k`` rows per ``keys`` under a total ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).filter(F.col(rank_col) <= k)


def top2_per_level(df: DataFrame, level_col: str = "level_category", name_col: str = "course_name",
                   id_col: str = "id", extra_keys=(), k: int = 2) -> DataFrame:
    """Two courses per level bucket by name (NULL names last), UNKNOWN dropped."""
    kept = df.filter(F.col(level_col).isin(*LEVEL_ORDER))
    return top_k_per_group(kept, [*extra_keys, level_col],
                           [F.col(name_col).asc_nulls_last(), F.col(id_col).asc_nulls_last()], k)


def sequential_ids(df: DataFrame, order_cols, prefix: str = "U", out_col: str = "seq_id") -> DataFrame:
    """``prefix || ROW_NUMBER() OVER (ORDER BY order_cols)`` without a global window.

    The table is range-partitioned and sorted on the (total) order once, and
    that pass is stored with every row's partition and position.  Counts and
    rows are both read from the stored table, so they agree whatever the
    sampled bounds or the coalescing were.  The running sum over the counts
    (one row per partition) gives each partition its first id.
    """
    order = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order_cols]
    sorted_df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = sorted_df.withColumn("_pid", F.spark_partition_id()) \
                      .withColumn("_mid", F.monotonically_increasing_id())
    # Position inside the partition: monotonically_increasing_id packs the
    # partition id in the upper bits and the record index in the lower 33.
    tagged = tagged.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    tagged = stored(tagged.drop("_mid"), "sequential-ids")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")  # one row per partition
    return out.withColumn(out_col, F.concat(F.lit(prefix), (F.col("_off") + F.col("_pos") + 1).cast("string"))) \
              .drop("_pid", "_pos", "_off")


def latest_per_key(df: DataFrame, keys, ts_col: str, tie_col: str) -> DataFrame:
    """The most recent row per key (ties broken by ``tie_col`` descending).

    Written as ``max_by`` over a struct so the aggregation is partial
    (map-side combine) and a hot key never gathers its rows in one task.
    """
    cols = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in cols])
    order = F.struct(F.col(ts_col), F.col(tie_col))
    agg = df.groupBy(*keys).agg(F.max_by(packed, order).alias("_latest"))
    return agg.select(*keys, *[F.col("_latest")[c].alias(c) for c in cols])


def recent_n(df: DataFrame, key: str, ts_col: str, n: int = 5, tie_col: str | None = None) -> DataFrame:
    """Last ``n`` rows per key by timestamp, ``n`` clamped to 1..20."""
    n = max(1, min(20, int(n)))
    order = [F.col(ts_col).desc_nulls_last()]
    if tie_col:
        order.append(F.col(tie_col).desc_nulls_last())
    return top_k_per_group(df, [key], order, n)


def topk(df: DataFrame, score_col: str, k: int, tie_col: str) -> DataFrame:
    """Global top-k by score (NULL scores dropped), ties by key."""
    return (df.filter(F.col(score_col).isNotNull())
            .orderBy(F.col(score_col).desc(), F.col(tie_col).asc()).limit(k))


def order_by_level(df: DataFrame, level_col: str = "level_category", *ties, key: str | None = None) -> DataFrame:
    """Alphabetical level order (ADVANCED, BEGINNER, INTERMEDIATE).

    With ``key`` (a user's list) each key's rows are ordered among themselves,
    in one partition; no order over all keys is asked for, so no range pass runs.
    """
    if key is not None:
        return df.repartition(key).sortWithinPartitions(key, F.col(level_col).asc_nulls_last(), *ties)
    return df.orderBy(F.col(level_col).asc_nulls_last(), *ties)


def first_k_of_list(arr, k: int) -> Column:
    """T4: keep the first ``k`` list items."""
    return F.slice(F.col(arr) if isinstance(arr, str) else arr, 1, k)
