"""Fitted text classifiers for E3 and E4: multinomial naive Bayes over hashed counts.

The model is fitted on a bounded sample of the labelled rows (``sample_rows``:
an equal share of different texts of every label, by least hash) and scores
every row over its whole text, map-side in the JVM.  Its size is labels times
``features`` numbers, whatever the input.

Rows without a label or without features are not fitted on.  A row whose text
is null or has no letters gets NULL; equal texts get equal labels; a table
without labelled rows gives a model that answers NULL everywhere.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import _col
from ..session import scratch_path


def letters(text) -> Column:
    """Lower-cased words of letters, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}]+", " ")), F.lit(" "))


@dataclass(frozen=True)
class TextClassifier:
    """``unit``: "characters" (runs of ``n`` letters and word ends) or "words" (runs of ``n`` words)."""

    unit: str = "characters"
    n: int = 3
    features: int = 1 << 15
    sample_rows: int = 20_000
    smoothing: float = 1.0

    def counts(self, df: DataFrame, text_col: str) -> DataFrame:
        """``df`` with ``_grams`` (hashed counts) and ``_any`` (whether there is a letter to judge by)."""
        # all runs of n characters: those that start at 1, n+1, ..., at 2, n+2, ..., and so on
        none = F.array().cast("array<string>")
        df = df.withColumn("_low", letters(text_col))
        enough = F.length("_low") > 2
        if self.unit == "characters":
            starts = (F.regexp_extract_all(F.substring("_low", i + 1, 1 << 30), F.lit(f".{{{self.n}}}"), F.lit(0)) for i in range(self.n))
            df = df.withColumn("_runs", F.coalesce(F.when(enough, F.concat(*starts)), none)).drop("_low")
        else:
            df = df.withColumn("_units", F.coalesce(F.when(enough, F.split(F.trim("_low"), " ")), none)).drop("_low")
            df = NGram(n=self.n, inputCol="_units", outputCol="_runs").transform(df).drop("_units") if self.n > 1 else df.withColumnRenamed("_units", "_runs")
        df = HashingTF(numFeatures=self.features, inputCol="_runs", outputCol="_grams").transform(df)
        return df.withColumn("_any", F.size("_runs") > 0).drop("_runs")

    def sample(self, labelled: DataFrame, text_col: str, label_col: str) -> tuple[list[str], DataFrame]:
        """The labels in order, and at most ``sample_rows`` rows (label, text): an equal share of every label.

        Different texts, by least hash.  Hashes below a bound that lets through about four shares of a label's rows are
        taken first, so the ranking meets a bounded number of rows and copies collapse before the shuffle; a label whose
        rows are mostly copies gets less than its share.
        """
        rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
        held = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a class
        if not held:
            return [], rows
        share = max(1, self.sample_rows // len(held))
        bound = F.create_map(*(F.lit(x) for k, n in held.items() for x in (k, int(min(1.0, 4 * share / n) * (1 << 30)))))
        near = rows.withColumn("_hash", F.xxhash64("text")).where(F.pmod("_hash", F.lit(1 << 30)) < F.element_at(bound, F.col("label")))
        rank = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash"))
        kept = near.groupBy("label", "_hash").agg(F.min("text").alias("text")).withColumn("_rank", rank).where(F.col("_rank") <= share)
        spark = labelled.sparkSession
        path = scratch_path(spark, f"models/sample-{uuid.uuid4().hex}")
        kept.select("label", "text").write.parquet(path)  # chosen once, read for every job of the fit
        return sorted(held), spark.read.schema("label string, text string").parquet(path)

    def fit(self, labelled: DataFrame, text_col: str, label_col: str) -> FittedText:
        """Labels are numbered in their own order, so a tie goes to the first."""
        names, sample = self.sample(labelled, text_col, label_col)
        tasks = labelled.sparkSession.sparkContext.defaultParallelism
        path = scratch_path(labelled.sparkSession, f"models/counts-{uuid.uuid4().hex}")
        self.counts(sample.repartition(tasks), "text").where("_any").select("label", "_grams").write.parquet(path)
        counted = labelled.sparkSession.read.parquet(path)  # the fit reads it several times
        if not names or counted.isEmpty():
            return FittedText(self, (), None)
        number = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
        model = NaiveBayes(smoothing=self.smoothing, featuresCol="_grams", labelCol="_label", predictionCol="_class",
                           rawPredictionCol="", probabilityCol="").fit(counted.withColumn("_label", number.cast("double")))
        return FittedText(self, tuple(names), model)


@dataclass(frozen=True)
class FittedText:
    spec: TextClassifier
    names: tuple[str, ...]
    model: NaiveBayesModel | None

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """``df`` with the likeliest label of every row's whole text."""
        if self.model is None:
            return df.withColumn(out_col, F.lit(None).cast("string"))
        rows = self.model.transform(self.spec.counts(df, text_col))
        label = F.element_at(F.array(*map(F.lit, self.names)), F.col("_class").cast("int") + 1)
        return rows.withColumn(out_col, F.when(F.col("_any"), label)).select(*df.columns, out_col)
