"""Connected components of a link table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the least node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them (rows have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) links -> (node, root): the least node of each component; nodes without links are absent.

    Only aggregates and equi-joins over the links run; a round is written to the
    shared folder, and the driver sees one count and one checksum per round.
    Self-links are ignored.  The number of rounds grows with the logarithm of
    the longest chain, and the loop ends when a round changes nothing.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = staged(edges, f"{name}-edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        edges = staged(_small_star(_large_star(edges)), f"{name}-edges")
