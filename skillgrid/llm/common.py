"""Shared plumbing of the training-data operators: sessions, staged tables, bounded Arrow pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

LAST_ID = 2 ** 63 - 1


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts can hold (the default is 10,000 rows)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite").option("compression", "zstd")
    # the table is the recovery point: the shuffle files of the job that wrote it can go with the job
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(tidy, before)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that others may have any name."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fold_of(*columns: Column | str) -> Column:
    """64 bits that tell rows of one id apart: two different texts agree once in 2^64, so n rows of one id by about n * n / 2^65 pairs."""
    return F.xxhash64(*columns)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and a row key (ord, fold): null ids order last; rows that share an id differ by a 64-bit text hash."""
    d = id_and_text(docs, id_col, text_col)
    return d.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("ord"), fold_of("text").alias("fold"), "doc_id", "text")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds one row or at most ``limit`` bytes of ``column``."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")
