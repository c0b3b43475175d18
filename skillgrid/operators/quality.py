"""Data-quality checks (Q1-Q5) as aggregations that return violation rows or counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_check(df: DataFrame, col: str) -> DataFrame:
    """Q1: values of ``col`` that occur more than once, with their counts (partial aggregation)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_null_check(df: DataFrame, cols) -> DataFrame:
    """Q2: one row with the NULL count of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def min_length_check(df: DataFrame, col: str, n: int = 50) -> DataFrame:
    """Q3: rows whose text is shorter than ``n`` characters (rejected)."""
    return df.filter(F.col(col).isNull() | (F.length(col) < n))


def list_size_check(arr, n: int = 5):
    """Q4: exactly ``n`` non-empty entries."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.size(F.filter(a, lambda s: s.isNotNull() & (F.trim(s) != ""))) == n


def skill_type_check(arr):
    """Q5: keep only non-NULL, non-empty skill strings."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.filter(a, lambda s: s.isNotNull() & (F.length(s) > 0))
