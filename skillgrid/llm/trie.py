"""Prefix trie of conversations by union-find over sorted neighbours.

Conversations are sorted by their turn digests, so those that share their first
d turns stand together.  The edge between two neighbours carries the number of
turns they share (their LCP).  A task takes the edges of its range in
descending depth and joins the components at both ends: a component that is
joined at a depth above its own bottom closes there, as a chain of nodes with
the same members, and becomes a child of the merged component, the branching
node.  All sums over a component are differences of running sums along the
sorted rows, because every node starts at exactly one row:

* leaves: rows longer than what they share with the next row;
* saved tokens: each row's words less the words that stand for a first time.

A component that touches neither end of its range is whole and goes out as
final rows.  The others, at most one chain along each end, are contracted to
one partial row per depth, keyed by depth and prefix digest, and added up over
ranges; where two ranges meet, a correction takes off what both counted (the
shared child, a leaf that goes on, words that stand again).  Ids of equal
conversations that lie across ranges meet as joined pieces, one per range.

Defined results: rows with a null conv_id belong to no conversation and are
left out.  A null role or text is empty, null turns come first, and turns of
equal number are ordered by digest.  Equality of turns is decided by 128 bits
of SHA-256 over role and text.  Repeated rows are turns of their own.  An empty
table has no nodes.  Texts never leave the scan; what a task holds per
conversation is its digests and word counts (about 50 bytes a turn), so the
longest single conversation must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions, staged

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 32                       # hex characters of a turn's digest
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RECORD = ("kind string, part int, node string, up string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends binary, words array<long>")
KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.binary(), pa.list_(pa.int64())]
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns -> (conv_id, t): each conversation's turns in order, as digest and word count."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), digest.alias("digest"),
                 F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))


def shared_openings(convs: DataFrame, every: int, length: Column, most: int) -> DataFrame:
    """Conversation c restarted with the first ``length`` (at most ``most``) turns of conversation c - c % every."""
    first = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, most).alias("opening"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", length.cast("int"))
    opening = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.array().cast(first.schema["opening"].dataType))
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1)))
    return own.join(first, "base", "left").select("conv_id", F.concat(opening, rest).alias("t"))


def shared_turns(a: str, b: str) -> int:
    """Leading turns that two keys have in common."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // DIGEST
    low, high = 0, least // DIGEST           # a[:low] is shared, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST: mid * DIGEST] == b[low * DIGEST: mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


def prefix_names(key: str) -> list[str]:
    """A digest for each prefix of a key, by depth from 0."""
    h, out = hashlib.sha256(), []
    out.append(h.hexdigest()[:DIGEST])
    for at in range(0, len(key), DIGEST):
        h.update(key[at:at + DIGEST].encode())
        out.append(h.hexdigest()[:DIGEST])
    return out


class Forest:
    """Components of one range of sorted conversations, joined edge by edge, deepest first."""

    def __init__(self, convs: list[int], keys: list[str], words: list[np.ndarray]):
        n = len(keys)
        self.convs, self.keys = convs, keys
        self.size = np.array([len(k) // DIGEST for k in keys], np.int64)
        self.runs = [np.concatenate([[0], np.cumsum(w)]).astype(np.int64) for w in words]     # words of the first d turns
        self.lcp = np.array([0] + [shared_turns(keys[i - 1], keys[i]) for i in range(1, n)], np.int64)
        total = np.array([r[-1] for r in self.runs], np.int64)
        new = np.array([r[-1] - r[k] for r, k in zip(self.runs, self.lcp)], np.int64)
        leaf = (self.size > np.append(self.lcp[1:], -1)).astype(np.int64)
        self.total, self.new, self.leaf = (np.concatenate([[0], np.cumsum(v)]) for v in (total, new, leaf))
        # a component: first row, end, bottom depth, least id, children at the bottom; closed ones get a top and the component above
        self.start, self.end, self.bottom = list(range(n)), list(range(1, n + 1)), self.size.tolist()
        self.least, self.children = list(convs), [0] * n
        self.top, self.above = [0] * n, [-1] * n
        self._join()

    def _join(self) -> None:
        root = list(range(len(self.keys)))               # a set's representative row
        held = list(range(len(self.keys)))               # the open component of each representative

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for edge in np.argsort(-self.lcp[1:], kind="stable").tolist():
            depth = int(self.lcp[edge + 1])
            a, b = find(edge), find(edge + 1)
            left, right = held[a], held[b]
            rank_a, rank_b = self.end[left] - self.start[left], self.end[right] - self.start[right]
            at_depth = [c for c in (left, right) if self.bottom[c] == depth]
            if at_depth:
                node = at_depth[0]
                for other in at_depth[1:]:               # both are the node of this depth: one takes the other's children
                    self.children[node] += self.children[other]
                    self.above[other] = -2 - node
            else:
                node = len(self.start)
                for column, value in ((self.start, 0), (self.end, 0), (self.bottom, depth), (self.least, 0), (self.children, 0), (self.top, 0), (self.above, -1)):
                    column.append(value)
            for c in (left, right):
                if self.bottom[c] > depth:
                    self.top[c], self.above[c] = depth + 1, node
                    self.children[node] += 1
            self.least[node] = min(self.least[left], self.least[right])
            self.start[node], self.end[node] = self.start[left], self.end[right]
            small, large = (a, b) if rank_a < rank_b else (b, a)
            root[small], held[large] = large, node

    def resolve(self, c: int) -> int:
        """The component that took in ``c`` at equal depth, or ``c``."""
        while self.above[c] < -1:
            c = -2 - self.above[c]
        return c

    def components(self) -> Iterator[int]:
        return (c for c in range(len(self.start)) if self.above[c] >= -1)

    def saved(self, c: int, before: int) -> int:
        """Saved tokens of the node whose first ``before`` words lie above it."""
        s, e = self.start[c], self.end[c]
        first_time = self.new[e] - self.new[s + 1] + self.runs[s][-1] - before
        return int(self.total[e] - self.total[s] - (e - s) * before - first_time)

    def ends(self, c: int) -> list[int]:
        """Ids of the rows that end at the component's bottom; they come first and in order."""
        s, out = self.start[c], []
        while s < self.end[c] and self.size[s] == self.bottom[c]:
            out.append(self.convs[s])
            s += 1
        return out


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def forest_records(part: int, convs: list[int], keys: list[str], words: list[np.ndarray]) -> Iterator[tuple]:
    """Final nodes, partial nodes along both ends, and the two end rows of one range."""
    f, n = Forest(convs, keys, words), len(keys)
    names: dict[int, list[str]] = {}

    def named(row: int) -> list[str]:
        if row not in names:
            names[row] = prefix_names(keys[row])
        return names[row]

    for c in f.components():
        s, e, bottom = f.start[c], f.end[c], f.bottom[c]
        above = f.resolve(f.above[c]) if f.above[c] >= 0 else -1
        runs = f.runs[s]
        ends = f.ends(c)
        leaves = int(f.leaf[e] - f.leaf[s])
        is_open = s == 0 or e == n
        parent_open = above < 0 or f.start[above] == 0 or f.end[above] == n
        for depth in range(f.top[c], bottom + 1):
            last = depth == bottom
            before = int(runs[depth - 1]) if depth else 0
            common = (f.least[c], depth)
            counts = (e - s, f.children[c] if last else 1, leaves, f.saved(c, before))
            held = _joined(ends) if last and ends else None
            if is_open:
                tag = named(0 if s == 0 else n - 1)
                yield ("open", part, tag[depth], tag[depth - 1] if depth else None, *common, None, *counts, held, None)
            else:
                up = depth == f.top[c]
                parent = None if up and parent_open else f.least[above] if up else f.least[c]
                key = named(f.start[above] if f.start[above] == 0 else n - 1)[depth - 1] if up and parent_open else None
                yield ("node", part, None, key, *common, parent, *counts, hashlib.sha256(held or b"").digest(), None)
    for side, row in (("first", 0), ("last", n - 1)):
        yield (side, part, keys[row], None, convs[row], len(keys[row]) // DIGEST, *[None] * 5, None, np.diff(f.runs[row]).tolist())


def _batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), KINDS)], names=NAMES)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), KINDS)], names=NAMES)


def _range_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, keys, words, part = [], [], [], -1
    for b in batches:
        if b.num_rows:
            part = b.column("part")[0].as_py()
            convs += b.column("conv_id").to_pylist()
            keys += b.column("key").to_pylist()
            lists = b.column("words")
            words += np.split(lists.flatten().to_numpy(zero_copy_only=False), (lists.offsets.to_numpy() - lists.offsets[0].as_py())[1:-1])
    if convs:
        yield from _batches(forest_records(part, convs, keys, words))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections along the prefix that the last row of a range shares with the first of the next."""
    def rows():
        for b in batches:
            for r in b.to_pylist():
                depth = shared_turns(r["key"], r["next_key"])
                tag, runs = prefix_names(r["key"][: depth * DIGEST]), np.concatenate([[0], np.cumsum(np.array(r["words"][:depth], np.int64))])
                ended = len(r["key"]) // DIGEST == depth
                for d in range(depth + 1):
                    again = int(runs[depth] - (runs[d - 1] if d else 0))
                    yield ("open", None, tag[d], tag[d - 1] if d else None, None, d, None, 0, -int(d < depth), -int(ended), again, None, None)
    yield from _batches(rows())


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's pieces, which come in order of their ranges."""
    node = state = None

    def out():
        return pa.record_batch([pa.array([node]), pa.array([state.digest()], pa.binary())], names=["node", "ends"])

    for b in batches:
        for tag, piece in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()):
            if tag != node:
                if state is not None:
                    yield out()
                node, state = tag, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
    if state is not None:
        yield out()


def prefix_trie(convs: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, t) -> one row per distinct sequence of first turns; see NODE."""
    rows = convs.select("conv_id", F.array_join(F.transform("t", lambda x: x["digest"]), "").alias("key"),
                        F.transform("t", lambda x: x["words"]).alias("words"))
    ranges = (staged(rows, "trie-rows").repartitionByRange(parts or partitions(convs.sparkSession), "key", "conv_id")
              .sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id()))
    records = staged(ranges.mapInArrow(_range_forest, RECORD), "trie-records")

    # one row per range on each side; a range's neighbour is the next one that has rows
    order = Window.orderBy("part")
    ends = records.where("kind = 'last'").select("part", F.col("node").alias("key"), "words").withColumn("next", F.lead("part").over(order))
    starts = records.where("kind = 'first'").select(F.col("part").alias("next"), F.col("node").alias("next_key"))
    meetings = ends.join(starts, "next").select("key", "words", "next_key").mapInArrow(_meetings, RECORD)

    partial = records.where("kind = 'open'")
    merged = (partial.unionByName(meetings).groupBy("depth", "node", "up")
              .agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))))
    pieces = partial.where("ends IS NOT NULL").select("node", "part", "ends")
    hashed = (pieces.repartition("node").sortWithinPartitions("node", "part")
              .mapInArrow(_hash_pieces, "node string, ends binary"))
    merged = staged(merged.join(hashed, "node", "left"), "trie-open")

    above = merged.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    whole = records.where("kind = 'node'").select("up", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    opened = merged.select("up", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    asked = whole.where("up IS NOT NULL").union(opened.where("up IS NOT NULL")).join(above, "up").withColumn("parent_conv_id", F.col("up_conv")).drop("up_conv")
    return (asked.unionByName(whole.where("up IS NULL")).unionByName(opened.where("up IS NULL"))
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS)).alias("ends_sha256")))
