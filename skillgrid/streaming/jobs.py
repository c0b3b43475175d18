"""Structured Streaming jobs for the reference's incremental behaviours (ST1-ST4).

All four read a folder of file drops with ``readStream`` and keep their
progress in a checkpoint under the shared ``spark.checkpoint.dir``, so a
restarted query (or a lost executor) resumes without reprocessing committed
files.  Sinks are written by ``foreachBatch`` as idempotent, keyed updates
(anti-join + append, or a versioned overwrite), which gives exactly-once
results on top of the at-least-once batch delivery.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as SR
from ..sources.keyed import KeyedTable


def _source(spark: SparkSession, path: str, schema: str, max_files: int | None) -> DataFrame:
    """A folder of parquet drops; ``max_files`` bounds the files of a micro-batch (unset: all that are there)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def _last_delivery(batch: DataFrame, key: str, place: str, path: str) -> DataFrame:
    """The batch without rows whose key is delivered again at a later ``place``.

    Only keys and places are shuffled; keys with several deliveries are written to ``path``,
    so that the join knows their size and texts need not move where they are few.
    """
    last = batch.groupBy(key).agg(F.max(place).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, "_last")
    last.write.mode("overwrite").parquet(path)
    several = batch.sparkSession.read.schema(last.schema).parquet(path)
    return batch.join(several, key, "left").where(F.col("_last").isNull() | (F.col("_last") == F.col(place))).drop("_last", place)


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Shuffle files of the queries that run inside go when the query ends: what they wrote is the recovery point."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run(query) -> None:
    """Wait until the query has ended by itself; its failure is raised here, and nothing partial is returned."""
    query.awaitTermination()


def index_refresh(spark: SparkSession, source_dir: str, schema: str, index_dir: str, checkpoint: str,
                  key: str = "doc_id", text: str = "text", attrs=("lang",), trigger=None,
                  max_files: int | None = None) -> str:
    """ST1 (+V6): keep an inverted index in step with a document drop folder.

    Each micro-batch appends only its own documents' postings, tagged with the
    batch id (``epoch``) -- no rewrite of the existing index -- and a row per
    delivered document.  A document that is delivered again supersedes its older
    postings, also if it has no word left: ``read_index`` keeps, per document,
    the postings of the epoch that delivered it last.  Of several deliveries of
    a document within one micro-batch the last one counts: by the file's
    modification time, then its path, then the row's place in it.  ``trigger`` defaults to
    ``availableNow``; a deployment uses ``processingTime='1 minute'`` for the
    reference's one-minute lag.  Re-running a failed batch overwrites that
    batch's own ``epoch=`` partition, so replays are idempotent.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    stream = _source(spark, source_dir, schema, max_files).select(key, text, *attrs, place.alias("_place"))

    def append_postings(batch: DataFrame, epoch: int) -> None:
        root, spark = index_dir.rstrip("/"), batch.sparkSession
        batch = _last_delivery(batch, key, "_place", f"{root}/repeated/epoch={epoch:010d}")
        with shuffle_files_dropped(spark):
            folder = f"{root}/postings/epoch={epoch:010d}"
            # a key has one row by now, so a document's words are counted within its row; rows without a key are one document
            lone = SR.row_postings(batch.filter(F.col(key).isNotNull()), key, text, attrs).select(*attrs, "term", key, "cnt")
            lone.write.mode("overwrite").option("compression", "zstd").parquet(folder)
            none = batch.filter(F.col(key).isNull())
            if not none.isEmpty():
                (SR.build_index(none, key, text, attrs).select(*attrs, "term", key, "cnt")
                 .write.mode("append").option("compression", "zstd").parquet(folder))
            batch.select(key).distinct().write.mode("overwrite").parquet(f"{root}/deliveries/epoch={epoch:010d}")

    w = stream.writeStream.foreachBatch(append_postings).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    _run(w.start())
    return index_dir


def read_index(spark: SparkSession, index_dir: str, key: str = "doc_id") -> DataFrame:
    """The current index: for every document, the postings of the epoch that delivered it last.

    Nothing can supersede the newest epoch, so its postings are read as they
    are; only older epochs meet the deliveries that came after them.
    """
    root = index_dir.rstrip("/")
    deliveries = spark.read.parquet(f"{root}/deliveries")
    postings = spark.read.parquet(f"{root}/postings")
    newest = deliveries.agg(F.max("epoch")).first()[0]
    if newest is None:
        return postings.drop("epoch")
    latest = deliveries.groupBy(key).agg(F.max("epoch").alias("epoch")).filter(F.col("epoch") < newest)
    older = postings.filter(F.col("epoch") < newest).join(latest, [key, "epoch"], "left_semi")
    return postings.filter(F.col("epoch") == newest).unionByName(older).drop("epoch")


def session_stream(spark: SparkSession, source_dir: str, schema: str, sink_dir: str, checkpoint: str,
                   max_files: int | None = None) -> str:
    """ST2 (+M4): session rows appended continuously to a parquet sink (file sink = exactly once)."""
    stream = _source(spark, source_dir, schema, max_files)
    q = (stream.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    _run(q)
    return sink_dir


def crawl_dedup_stream(spark: SparkSession, source_dir: str, schema: str, sink_dir: str, checkpoint: str,
                       key: str = "url", max_files: int | None = None) -> str:
    """ST3: never emit the same link twice across batches (keyed dedup state in the checkpoint).

    The dedup state is keyed by URL; with the RocksDB state store it lives on
    local disk of the executors and in the checkpoint, not in JVM heap.
    """
    stream = _source(spark, source_dir, schema, max_files)
    q = (stream.dropDuplicates([key]).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    _run(q)
    return sink_dir


def incremental_model(spark: SparkSession, source_dir: str, schema: str, target_dir: str, checkpoint: str,
                      key: str, max_files: int | None = None) -> str:
    """ST4 (+J2): per micro-batch, append only keys not yet in the target table.

    The target is a keyed table (``sources/keyed.py``): a batch reads the keys
    of the hash buckets that its own keys fall into and adds files of its new
    rows; other buckets are not looked at.  A replayed batch (after a failure)
    finds its keys held and adds nothing.
    """
    table = KeyedTable(spark, target_dir, schema, key)

    def append_new(batch: DataFrame, epoch: int) -> None:
        others = [c for c in batch.columns if c != key]
        least = F.min(F.struct(*others)).alias("r")  # of rows with one key always the same is kept
        table.insert_new(batch.filter(F.col(key).isNotNull()).groupBy(key).agg(least).select(
            *[F.col(f"r.{c}").alias(c) if c != key else F.col(key) for c in batch.columns]))

    q = (_source(spark, source_dir, schema, max_files).writeStream.foreachBatch(append_new).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    _run(q)
    return target_dir


def read_model(spark: SparkSession, target_dir: str) -> DataFrame | None:
    """All rows of an incremental model, or None before the first batch that had any."""
    table = KeyedTable.open(spark, target_dir)
    return table.read() if table is not None else None
