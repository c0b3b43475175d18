"""SimHash near-duplicates, linked through Gray-order hierarchical indexes.

1. One map-side pass gives every document a 64-bit fingerprint; equal
   fingerprints are merged at once (a group of exact copies is one code).
2. Two codes within ``max_bits`` agree on at least one of ``max_bits + 1`` bit
   blocks, so each code is dealt once per block; a block value shared by more
   than ``GROUP`` codes is split again by blocks of the bits still free, until
   the free bits alone bound the group.  No code is ever left out.
3. Inside a task the codes of each group are sorted by Gray rank and a tree is
   built over them: an upper node holds the bits all codes below share.  A
   search adds up the differences node by node and drops whole subtrees once
   they pass ``max_bits``.  A task returns a spanning forest, not the pairs.
4. Star joins turn the forests into components.

Null and empty texts get fingerprint zero and link like any other code; null
ids order after all others; a repeated row falls into its copy's group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LAST_ID, by_bytes, fold_of, keyed, small_batches, staged, unsigned_hex
from .components import components

GROUP = 1024
FAN = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, k: int = 3, seed: int = 42, piece: int = 250_000) -> int:
    """The fingerprint of one text; long texts are counted in pieces of bounded size."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    last = ends[k - 1:] if len(words) >= k else ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, piece):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first[at:min(at + piece, n)].tolist(), last[at:at + piece].tolist())), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(ord, fold, doc_id, fp) per row; ``fp`` is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for part in by_bytes(batches, "text"):
            codes = np.array([fingerprint(t, k, seed) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([part.column("ord"), part.column("fold"), part.column("doc_id"), pa.array(codes.view(np.int64))],
                                  names=["ord", "fold", "doc_id", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "ord long, fold long, doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of a code in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(fixed: int, n: int) -> list[int]:
    """Masks that add one of ``n`` even blocks of the free bits to the ``fixed`` ones."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [fixed | sum(1 << b for b in part) for part in np.array_split(np.array(free, object), n)]


def _dealt(codes: DataFrame, max_bits: int, levels: int = 4) -> DataFrame:
    """(mask, value, fp): every code in each of its groups, large groups split by more bits."""
    known, groups = [0], None
    rest = codes.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(levels):
        finer = {m: _blocks(m, max_bits + 1) for m in known}
        table = F.create_map(*(x for m, subs in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*(F.lit(_signed(s)).cast("long") for s in subs)))))
        slots = rest.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        slots = slots.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        slots = slots.distinct() if level else slots
        known = sorted({s for subs in finer.values() for s in subs})
        hot = None
        if level < levels - 1:
            hot = staged(slots.groupBy("mask", "value").count().where(F.col("count") > GROUP).select("mask", "value"), "simhash-hot")
        if hot is None or hot.isEmpty():
            return slots if groups is None else groups.union(slots.select("fp", "mask", "value"))
        small = slots.join(hot, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        groups = small if groups is None else groups.union(small)
        rest = staged(slots.join(hot, ["mask", "value"], "left_semi").select("fp", "mask"), "simhash-split")
    raise AssertionError("the last level always returns")


def _tree(codes: np.ndarray, group: np.ndarray) -> list[tuple]:
    """Levels, leaves first: (bits shared, their values, first child, children, last leaf + 1)."""
    n = len(codes)
    shared_and, shared_or, of = codes, codes, group
    levels = [(np.full(n, ALL), codes, np.arange(n), np.zeros(n, np.int64), np.arange(n) + 1)]
    while len(of) > 1 and (of[1:] == of[:-1]).any():
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        inside = np.arange(len(of)) - np.repeat(heads, np.diff(np.append(heads, len(of))))
        first = np.flatnonzero(inside % FAN == 0)
        shared_and, shared_or = np.bitwise_and.reduceat(shared_and, first), np.bitwise_or.reduceat(shared_or, first)
        count = np.diff(np.append(first, len(of)))
        levels.append((~(shared_and ^ shared_or), shared_and, first, count, levels[-1][4][first + count - 1]))
        of = of[first]
    return levels


def close_pairs(codes: np.ndarray, group: np.ndarray, max_bits: int, chunk: int = 1024):
    """Yield (i, j) index arrays of pairs i < j of one group within ``max_bits``; codes in Gray order per group."""
    levels = _tree(codes, group)
    top = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))  # each group's root
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    tail = np.append(heads[1:], len(codes))[top]
    queries = np.flatnonzero(np.arange(len(codes)) + 1 < tail)
    for at in range(0, len(queries), chunk):
        q = queries[at:at + chunk]
        node = top[q]
        shared, value = levels[-1][0], levels[-1][1]
        far = np.bitwise_count((codes[q] ^ value[node]) & shared[node]).astype(np.int64)
        for level in range(len(levels) - 1, 0, -1):
            above, first, count = levels[level][0], levels[level][2], levels[level][3]
            shared, value, _, _, last = levels[level - 1]
            n = count[node]
            child = np.repeat(first[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            q, far, parent = np.repeat(q, n), np.repeat(far, n), np.repeat(node, n)
            far = far + np.bitwise_count((codes[q] ^ value[child]) & shared[child] & ~above[parent])
            keep = (far <= max_bits) & (last[child] > q + 1)
            q, far, node = q[keep], far[keep], child[keep]
        yield q, node


def join_forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the trees of ``parent`` (each node points at a smaller or equal one) along the pairs."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _forest(max_bits: int):
    def solve(mask, value, fp):
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        group, codes = np.cumsum(new), fp.view(np.uint64)
        parent = np.arange(len(codes))
        for i, j in close_pairs(codes, group, max_bits):
            parent = join_forest(parent, i, j)
        at = np.flatnonzero(parent != np.arange(len(codes)))
        return pa.record_batch([pa.array(fp[at]), pa.array(fp[parent[at]])], names=["u", "v"])

    def run(batches, room=100_000):
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("mask", "value", "fp")])
            rows += batch.num_rows
            if rows >= room:
                mask, value, fp = (np.concatenate(x) for x in zip(*held))
                cut = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
                cut = cut[-1] + 1 if len(cut) else 0  # the last group may go on
                if cut:
                    yield solve(mask[:cut], value[:cut], fp[:cut])
                held, rows = [[mask[cut:], value[cut:], fp[cut:]]], len(mask) - cut
        if rows:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def close_codes(codes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v) links that connect exactly the codes reachable through steps of at most ``max_bits`` bits."""
    dealt = _dealt(codes, max_bits).repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("fp")))
    return dealt.mapInArrow(_forest(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 2,
                    seed: int = 42) -> DataFrame:
    """(ord, fold, doc_id, fp, root, component): ``root`` is the fingerprint that stands for a component and names it;
    ``component`` is the least ``ord`` reachable, itself included, which components of null or repeated ids can share."""
    marked = staged(fingerprints(docs, id_col, text_col, k, seed), "simhash-marked")
    codes = staged(marked.groupBy("fp").agg(F.min("ord").alias("least")), "simhash-codes")
    roots = components(close_codes(codes.select("fp"), max_bits), "simhash")
    linked = codes.join(roots, codes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labels = linked.groupBy("root").agg(F.min("least").alias("component"))
    table = staged(linked.join(labels, "root").select("fp", "root", "component"), "simhash-labels")
    return marked.join(table, "fp").select("ord", "fold", "doc_id", "fp", "root", "component")


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (null only where all reachable ids are null)."""
    rows = near_duplicates(docs, **how)
    return rows.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"),
                       F.when(F.col("component") != LAST_ID, F.col("component")).alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The document with the least id of every component, all columns; of repeated rows one stays."""
    chosen = (near_duplicates(docs, id_col, text_col, **how)
              .groupBy("root").agg(F.min(F.struct("ord", "fold")).alias("s")).select("s.ord", "s.fold"))
    key = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("ord"),
                      fold_of(F.col(f"`{text_col}`").cast("string")).alias("fold"))
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy("ord", "fold").orderBy("ord", "fold"))
    return key.join(chosen, ["ord", "fold"]).withColumn("nth", nth).where("nth = 1").select("row.*")
