"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked through hubs (here: equal texts).  Every round counts the
members of each hub per shard, and a document moves to the shard most of its
neighbours are in, as long as that shard has room under its quota; the quota is
shared out by a hash of the document, so no task sees a whole hub.  Documents
without links move nowhere: they fill what is left, and so the counts end at
most one apart (law ``rows``).

Null texts have size 1 (no bytes, plus one) and checksum 0, and are no links
to one another; empty texts are texts like any other.  Repeated rows are
placed each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LAST_ID, staged


def _lookup(values: list[int], key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), key + 1)


def _counts(df: DataFrame, column: str, n: int) -> list[int]:
    """Rows per shard: at most ``n`` numbers reach the driver."""
    found = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [found.get(i, 0) for i in range(n)]


def numbered(df: DataFrame, group: str, total: int, name: str, *order: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in about 4 * sqrt(total) hashed buckets.

    Rows are ranked inside their bucket and the buckets' counts are added up, so
    neither step puts more than some sqrt(total) rows of a group together.
    """
    n = max(1, 4 * math.isqrt(total))
    parts = df.withColumn("_b", F.pmod(F.xxhash64(*order, F.lit(n)), F.lit(n)))
    sizes = parts.groupBy(group, "_b").count()
    before = sizes.select(group, "_b", (F.sum("count").over(Window.partitionBy(group).orderBy("_b")) - F.col("count")).alias("_o"))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)))
    return (ranked.join(before, [group, "_b"])
            .withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_o", "_r", "_b"))


def propagate(linked: DataFrame, quotas: list[int], rounds: int = 6) -> DataFrame:
    """(ord, fold, hub, ...) -> the same with ``label``: the shard after at most ``rounds`` rounds of voting."""
    n = len(quotas)
    state = staged(linked.withColumn("label", F.pmod(F.xxhash64("ord", "fold"), F.lit(n)).cast("int")), "shards-0")
    for turn in range(1, rounds + 1):
        load = _counts(state, "label", n)
        room = [max(0, q - x) for q, x in zip(quotas, load)]
        votes = state.groupBy("hub", "label").count()
        open_to = _lookup(room, F.col("label")) > 0
        hubs = votes.groupBy("hub").agg(
            F.map_from_entries(F.collect_list(F.struct("label", "count"))).alias("here"),  # one entry per shard
            F.max(F.when(open_to, F.struct(F.col("count").alias("votes"), (-F.col("label")).alias("neg")))).alias("best"))
        wish = state.join(hubs, "hub").withColumn("to", -F.col("best.neg"))
        mine = F.col("here")[F.col("label")]
        gains = (F.col("best.votes") > mine) | ((F.col("best.votes") == mine) & (F.col("to") < F.col("label")))
        wish = staged(wish.select(*state.columns, F.when(gains, F.col("to")).alias("to")), f"shards-wish-{turn}")
        asked = _counts(wish.where("`to` IS NOT NULL"), "to", n)
        if not any(asked):
            return state
        let_in = [min(10 ** 6, r * 10 ** 6 // a) if a else 0 for r, a in zip(room, asked)]
        accepted = F.pmod(F.xxhash64("ord", "fold", F.lit(turn)), F.lit(10 ** 6)) < _lookup(let_in, F.col("to"))
        state = staged(wish.withColumn("label", F.when(F.col("to").isNotNull() & accepted, F.col("to")).otherwise(F.col("label")).cast("int")).drop("to"),
                       f"shards-{turn}")
    return state


def shard(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot (gapless from 0 in its shard), grown_shard (null under this law)."""
    text = F.col(f"`{text_col}`").cast("string")
    ident = F.col(f"`{id_col}`").cast("long")
    nodes = staged(docs.select(
        F.coalesce(ident, F.lit(LAST_ID)).alias("ord"), ident.alias("doc_id"), F.hash(text).alias("fold"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("crc"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("hub")), "shards-nodes")
    total = nodes.count()
    quotas = [total // n + (s < total % n) for s in range(n)]
    groups = nodes.where("hub IS NOT NULL").groupBy("hub").count().where("count > 1").select("hub")
    linked = propagate(nodes.join(groups, "hub", "left_semi").select("ord", "fold", "doc_id", "size", "crc", "hub"), quotas, rounds)
    load = _counts(linked, "label", n)
    placed = staged(numbered(linked, "label", sum(load), "slot", "ord", "fold"), "shards-placed")
    quota = _lookup(quotas, F.col("label"))
    stay = placed.where(F.col("slot") < quota).select("doc_id", "size", "crc", F.col("label").alias("shard"), "slot")
    over = placed.where(F.col("slot") >= quota).select("ord", "fold", "doc_id", "size", "crc")
    alone = nodes.join(groups, "hub", "left_anti").select("ord", "fold", "doc_id", "size", "crc")
    held = [min(q, x) for q, x in zip(quotas, load)]
    gap = [q - h for q, h in zip(quotas, held)]
    upto = [sum(gap[: s + 1]) for s in range(n)]
    filler = numbered(over.union(alone).withColumn("all", F.lit(0)), "all", total, "place", "ord", "fold")
    to = sum((F.when(F.col("place") >= u, 1).otherwise(0) for u in upto[:-1]), F.lit(0)).cast("int")
    filler = filler.withColumn("shard", to).select(
        "doc_id", "size", "crc", "shard",
        (F.col("place") - _lookup([0, *upto[:-1]], F.col("shard")) + _lookup(held, F.col("shard"))).alias("slot"))
    return stay.union(filler).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
