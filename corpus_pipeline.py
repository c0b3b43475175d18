"""Document pipeline: quality rules, SimHash near-dedup, substring dedup, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns the columns of ``documents``; the last returns packed pieces.
Null texts fail the word-count rule of the first stage; later stages have rows
of equal ids, null ids and empty tables behave as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillgrid.llm import decontaminate, packing, phrases, quality, simhash
from skillgrid.llm.common import staged
from skillgrid.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy of the rule ledger rejects go."""
    return quality.kept_documents(docs, quality.STANDARD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (3-word shingles, 2 bits) the one with the least id stays."""
    return simhash.one_per_group(docs, k=3, max_bits=2, seed=42)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """50-word passages that also start in a document with a smaller id are cut out; a document left empty goes."""
    return phrases.deduplicated(docs, width=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside 10-word windows of benchmark items are cut out; a document covered by half or more goes."""
    return decontaminate.cleaned(docs, read_table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents in bins of 512 to 4096 tokens."""
    return packing.packed_documents(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

# Similarity links, suffix automata, byte-pair tokens and bin filling are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
