"""Session helpers: one place that fixes the SQL semantics every job relies on.

The cluster owns ``spark.checkpoint.dir``; jobs read it from the session and
only fall back to a scratch folder when it is unset and the master is local.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings that change results, pinned so Spark and the DuckDB oracle agree.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
}

# Settings that only change the physical plan.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner can prove small; the operators add
    # explicit hints only for sides whose size is bounded by construction.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # AQE sizes post-shuffle partitions from map output statistics.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    # Keyed streaming state (crawl dedup) lives in RocksDB on local disk + checkpoint, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "skillgrid") -> SparkSession:
    """Create (or reuse) a session with the pinned semantics.

    ``master`` defaults to the launcher's (``spark-submit --master ...``); only
    when none is configured does it fall back to ``local[$BENCH_CPUS]`` / ``local[*]``.
    """
    from pyspark import SparkConf
    if master is None and not SparkConf().contains("spark.master"):
        # No launcher-provided master (spark-submit sets one on a cluster): run locally.
        cpus = os.environ.get("BENCH_CPUS")
        master = f"local[{cpus}]" if cpus else "local[*]"
    builder = SparkSession.builder
    if master is not None:
        builder = builder.master(master)
    builder = (builder.appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("SKILLGRID_DRIVER_MEMORY", "16g")))
    for k, v in {**SEMANTIC_CONF, **PLAN_CONF}.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_semantics(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_semantics(spark: SparkSession) -> None:
    """Pin result-affecting settings on an existing session (driver-made ones too)."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="skillgrid-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
        spark.conf.set("spark.checkpoint.dir", current)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"

