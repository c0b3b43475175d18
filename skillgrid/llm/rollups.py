"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A change says what is to hold for one document and tokenizer version from now
on: ``insert`` and ``revise`` give its count, ``delete`` takes it away.  A batch
of changes is compared with the ledger, and only the signed difference is
written: -old +new where something changed.  Totals are plain sums over the
differences of committed batches, so they never look at a text again.

A batch counts once its commit record is written, last of all.  Committing the
same batch id again does nothing; a batch that broke off before its record is
overwritten by its retry.

Within a batch the highest ``seq`` of a document and version wins (ties: the
larger count).  A document is its id and ``row``: 0 where the id alone names
it, and a hash of text, source and language for rows without an id or whose id
others have too (``counted_rows``), so that each of them counts.  ``copies``
says for how many equal rows a change stands.  Changes without these columns
have row 0 and one copy.  Null sources and languages are groups of their own, a
null count is 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_bytes, small_batches
from .tokens import Tokenizer

CHANGE = "doc_id long, source string, lang string, tokenizer string, op string, n_tokens long, seq long"  # and row long, copies long where ids do not name a row
DELTA = "doc_id long, row long, source string, lang string, tokenizer string, d_docs long, d_tokens long, batch string"
KEY = ("source", "lang", "tokenizer")


def token_counts(docs: DataFrame, tokenizers: list[Tokenizer]) -> DataFrame:
    """(doc_id, fold, source, lang, tokenizer, n_tokens): one row per row of ``docs`` and tokenizer, whole texts; fold: a hash of the row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for part in by_bytes(batches, "text"):
            texts = part.column("text").to_pylist()
            for t in tokenizers:
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "fold", "source", "lang")), pa.array([t.version] * len(texts), pa.string()),
                                       pa.array([t.count(x) for x in texts], pa.int64())],
                                      names=["doc_id", "fold", "source", "lang", "tokenizer", "n_tokens"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
            .withColumn("fold", F.xxhash64("text", F.col("source").isNull(), "source", F.col("lang").isNull(), "lang"))
            .mapInArrow(run, "doc_id long, fold long, source string, lang string, tokenizer string, n_tokens long"))


def counted_rows(counts: DataFrame) -> DataFrame:
    """``token_counts`` rows -> (doc_id, row, copies, source, lang, tokenizer, n_tokens), one row per document of the ledger.

    Equal rows are added up by a partial aggregate; ids that several different
    rows have are found by another one, so no id's rows meet in one task.
    """
    equal = counts.groupBy("doc_id", "fold", "tokenizer").agg(
        F.count("*").alias("copies"), F.first(F.struct("source", "lang", "n_tokens")).alias("c"))
    shared = (equal.where("doc_id IS NOT NULL").groupBy("doc_id", "tokenizer").agg(F.sum("copies").alias("n")).where("n > 1")
              .select("doc_id", F.lit(True).alias("shared")).distinct())
    named = equal.join(shared, "doc_id", "left")
    row = F.when(F.col("doc_id").isNull() | F.col("shared"), F.col("fold")).otherwise(F.lit(0))
    return named.select("doc_id", row.cast("long").alias("row"), "copies", "c.source", "c.lang", "tokenizer", "c.n_tokens")


class TokenRollup:
    """A ledger of signed deltas below ``path`` in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> list[str]:
        """Ids of the batches that count (one per commit, as many as there were batches)."""
        return sorted(r.batch for r in self._table("commits", "batch string").collect())

    def deltas(self) -> DataFrame:
        """Signed document-level differences of all committed batches."""
        done = self.committed()
        return self._table("deltas", DELTA).where(F.col("batch").isin(done) if done else F.lit(False))

    def _compare(self, changes: DataFrame) -> DataFrame:
        for column, usual in (("row", 0), ("copies", 1)):
            if column not in changes.columns:
                changes = changes.withColumn(column, F.lit(usual).cast("long"))
        last = F.max_by(F.struct("source", "lang", "op", "copies", "n_tokens"), F.struct(F.coalesce("seq", F.lit(0)), F.coalesce("n_tokens", F.lit(0))))
        new = changes.groupBy("doc_id", "row", "tokenizer").agg(last.alias("c")).select(
            "doc_id", "row", "tokenizer",
            F.when(F.col("c.op") != "delete", F.struct("c.source", "c.lang", F.col("c.copies").alias("k"),
                                                       (F.col("c.copies") * F.coalesce("c.n_tokens", F.lit(0))).alias("n"))).alias("new"))
        held = (self.deltas().groupBy("doc_id", "row", *KEY).agg(F.sum("d_docs").alias("k"), F.sum("d_tokens").alias("n")).where("k <> 0")
                .select(F.col("doc_id").alias("o_id"), F.col("row").alias("o_row"), F.col("tokenizer").alias("o_tok"), F.struct("source", "lang", "k", "n").alias("old")))
        both = new.join(held, F.col("doc_id").eqNullSafe(F.col("o_id")) & F.col("row").eqNullSafe(F.col("o_row")) & F.col("tokenizer").eqNullSafe(F.col("o_tok")), "left")
        same = F.col("old.source").eqNullSafe(F.col("new.source")) & F.col("old.lang").eqNullSafe(F.col("new.lang"))

        def signed(group, docs, tokens):
            return F.struct(F.col(f"{group}.source").alias("source"), F.col(f"{group}.lang").alias("lang"), docs.alias("d_docs"), tokens.alias("d_tokens"))

        moved = F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & same, F.array(
            signed("new", F.col("new.k") - F.col("old.k"), F.col("new.n") - F.col("old.n")))).otherwise(F.array(
                signed("old", -F.col("old.k"), -F.col("old.n")), signed("new", F.col("new.k"), F.col("new.n"))))
        return (both.select("doc_id", "row", "tokenizer", F.explode(moved).alias("d")).select("doc_id", "row", "d.source", "d.lang", "tokenizer", "d.d_docs", "d.d_tokens")
                .where("d_docs IS NOT NULL AND (d_docs <> 0 OR d_tokens <> 0)"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False, and nothing written, if it has been committed before."""
        if batch in self.committed():
            return False
        signed = self._compare(changes).withColumn("batch", F.lit(batch))
        signed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/deltas")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that have come to nothing are left out."""
        return (self.deltas().groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
                .where("n_docs <> 0 OR n_tokens <> 0"))
