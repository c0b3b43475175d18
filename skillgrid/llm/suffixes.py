"""Exact substring dedup over UTF-8 bytes with per-shard suffix arrays.

A window is ``width`` consecutive bytes of one text; its anchor is its least
gram of ``gram`` bytes, so equal windows have equal anchors.

1. One pass lists every text's runs of windows with a common anchor.  An anchor
   that stands only once holds no repeated window and is done.
2. Equal runs are counted by an aggregate: a run seen twice repeats whole.
3. The other runs of recurring anchors are dealt to shards by anchor, one copy
   each; runs of a very frequent anchor are first cut into parts of a few
   windows, which only meet if the bytes that all their windows share agree.  A shard sorts its suffixes by
   Larsson-Sadakane refinement, takes common prefixes after Kasai, and marks
   neighbouring windows that share ``width`` bytes.
4. Where even parts that agree are too many for a shard, they are dealt over
   all of them, and their windows are merged across shards: each shard
   sends one key per different window, keys are dealt by range, and binary
   search in the sorted keys finds those that other shards have too.
5. Every text gets the spans of its repeated windows and loses their bytes.

Runs and windows are compared by 128-bit hashes outside the shards.  Null texts
are empty; repeated rows repeat each other; null ids are rows like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, keyed, small_batches, staged
from .spans import anchor_table, byte_hashes, byte_view, covered, mix, runs_of

RUNS = "a long, g long, ord long, fold long, start int, n int, off int, reps int"
PIECE = 2_000_000
SHARD_BYTES = 250_000  # a shard's arrays stay in the processor's cache
HOT = 256  # runs of one anchor that are left together
SPLIT = 16  # windows of a frequent anchor that are told apart by what they share


def _runs(width: int, gram: int, scoped: bool):
    def run(batches):
        for part in by_bytes(batches, "text", PIECE):
            raw, offsets = byte_view(part.column("text"))
            row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
            t = anchor_table(byte_hashes(raw), row, width, gram)
            if scoped:  # anchors of different scopes never meet
                t["anchor"] = mix(t["anchor"] + part.column("scope").to_numpy().view(np.uint64)[t["row"]])
            at = pa.array(t["row"])
            yield pa.record_batch([
                pa.array(t["anchor"].view(np.int64)), pa.array(t["digest"].view(np.int64)), part.column("ord").take(at), part.column("fold").take(at),
                pa.array(t["start"] - offsets[t["row"]], pa.int32()), pa.array(t["n"], pa.int32()),
                pa.array(t["off"], pa.int32()), pa.array(t["reps"], pa.int32())],
                names=["a", "g", "ord", "fold", "start", "n", "off", "reps"])
    return run


def suffix_order(raw: np.ndarray, depth: int, beyond: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes (at least), and their group ranks.

    Larsson-Sadakane: sort by eight bytes, then double the sorted depth, looking
    only at groups that still hold several suffixes; a suffix's rank is the last
    place of its group.  ``beyond`` tells how many bytes a suffix stands behind
    the last one whose order is asked for: it serves that one's order with its
    first depth - beyond bytes, and is sorted no deeper.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key).astype(np.int32)  # a shard is far shorter than 2^31
    new = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]]) if n else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], n) - 1
    rank = np.empty(n, np.int32)
    rank[sa] = np.repeat(tails, tails - heads + 1) if n else rank
    open_ = np.repeat(tails > heads, tails - heads + 1) if n else np.zeros(0, bool)
    h = 8
    place = np.flatnonzero(open_)
    while h < depth:
        step = min(h, depth - h)  # the last step reaches exactly to the depth
        place = place[open_[place]]
        if beyond is not None:
            place = place[beyond[sa[place]] <= depth - h - step]
        if not len(place):
            break
        suffix = sa[place]
        group = rank[suffix]
        after = suffix + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.argsort(group.astype(np.int64) * (n + 1) + second)  # below n * n + 2 n, so far from the limit for a shard's n
        suffix, group, second = suffix[order], group[order], second[order]
        sa[place] = suffix
        cut = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        heads = np.flatnonzero(cut)
        size = np.diff(np.append(heads, len(place)))
        rank[suffix] = np.repeat(place[heads + size - 1], size)
        open_[place] = np.repeat(size > 1, size)
        h += step
    return sa, rank


def common_prefixes(raw: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix of ``sa`` (sorted by ``limit`` bytes; all suffixes or some) shares with the one before it, up to ``limit``.

    Kasai's bound in text order, ``k`` places at a time: if a suffix shares L <
    limit bytes with its predecessor, the one ``k`` places on shares at least
    L - k with its own, provided that the place k behind the predecessor is in
    ``sa`` too.  Comparisons start there and go on eight bytes at a time for all
    suffixes at once, first for every 64th place, last for every one.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    got = np.zeros(n, np.int64)
    padded = np.concatenate([raw, np.zeros(16 + limit, np.uint8)])
    lanes = np.ndarray((n + limit + 8,), dtype="<u8", buffer=padded, strides=(1,))
    member = np.zeros(n + 64, bool)
    member[sa] = True
    open_ = member[:n] & (before >= 0)
    step = 64
    while step:
        at = np.arange(0, n, step)
        at = at[open_[at]]
        left = np.maximum(at - step, 0)
        sure = (at >= step) & (before[left] >= 0) & (got[left] < limit) & member[np.maximum(before[left], 0) + step]
        length = np.where(sure, np.maximum(got[left] - step, 0), 0)
        live, own, other = np.arange(len(at)), at + length, before[at] + length
        while len(live):
            x = lanes[own] ^ lanes[other]
            same = x == 0
            low = x & (~x + np.uint64(1))
            length[live] += np.where(same, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
            more = same & (length[live] < limit)
            live, own, other = live[more], own[more] + 8, other[more] + 8
        got[at] = np.minimum(np.minimum(length, limit), n - np.maximum(at, before[at]))  # nothing lies beyond the end
        open_[at] = False
        step //= 2
    return got[sa]


def repeated_windows(pieces: list[bytes], windows: list[int], low: list[int], high: list[int], width: int) -> list[np.ndarray]:
    """Per piece, a class number for each of its first windows: equal numbers, equal bytes; -1: not repeated.

    ``low`` and ``high`` are the least and greatest place a piece stands at; a
    class is repeated if its pieces' places are not all the same.
    """
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    # bytes after a piece's last window serve the order only
    beyond = np.maximum(np.arange(len(raw)) - np.repeat(begin[:-1] + np.array(windows) - 1, sizes), 0)
    sa, _ = suffix_order(raw, width, beyond)
    sa = sa[beyond[sa] == 0]
    number = np.cumsum(common_prefixes(raw, sa, width) < width)
    heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    piece = np.searchsorted(begin, sa, side="right") - 1
    apart = np.minimum.reduceat(np.array(low)[piece], heads) != np.maximum.reduceat(np.array(high)[piece], heads)
    label = np.full(len(raw), -1, np.int64)
    label[sa] = np.where(np.repeat(apart, np.diff(np.append(heads, len(sa)))), number, -1)
    return [label[b:b + n] for b, n in zip(begin, windows)]


BODIES = "a long, g long, meet long, base int, n int, whole boolean, hot boolean, low long, high long, body binary"


def _parts(w: dict, body: bytes, width: int):
    """(meet, base, n, body) of a run; equal windows have an equal ``meet``.

    Runs of a frequent anchor are cut by the place of the anchor in their
    windows, ``SPLIT`` places at a time, and meet only where all the bytes
    agree that such windows have in common.
    """
    if not w["hot"]:
        yield w["a"], 0, w["n"], body
        return
    off, n = w["off"], w["n"]
    for j in range((off - n + 1) // SPLIT, off // SPLIT + 1):
        common = body[off - j * SPLIT: off - (j + 1) * SPLIT + 1 + width]
        key = xxhash.xxh3_64_intdigest(common, seed=w["a"] % 2 ** 64)
        first, last = off - min(off, j * SPLIT + SPLIT - 1), off - max(off - n + 1, j * SPLIT)
        yield key - (1 << 64) if key >> 63 else key, first, last - first + 1, body[first:last + width]


def _read(width: int):
    """The bytes of each wanted run, or of its parts."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    names = ["a", "g", "meet", "base", "n", "whole", "hot", "low", "high", "body"]

    def run(batches):
        for part in by_bytes(batches, "text", PIECE):
            out = []
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                raw = text.encode()
                for w in wanted:
                    for meet, base, n, body in _parts(w, raw[w["start"]: w["start"] + w["n"] + width - 1], width):
                        out.append((w["a"], w["g"], meet, base, n, w["whole"], w["hot"], w["low"], w["high"], body))
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)
    return run


VERDICTS = "a long, g long, kind int, at array<int>, k1 long, k2 long, low long, high long"


def _verdicts(width: int):
    """Kind 0: runs of repeated windows of (a, g).  Kind 1: a single window ``at`` to be looked for in other shards.
    Kind 2: a key that this shard has; nothing is to be found out for it."""

    def solve(rows):
        labels = repeated_windows([r["body"] for r in rows], [r["n"] for r in rows], [r["low"] for r in rows], [r["high"] for r in rows], width)
        out, sent = [], set()
        for r, label in zip(rows, labels):
            many = label >= 0
            if not r["whole"] and many.any():
                s, e = runs_of(many)
                out.append((r["a"], r["g"], 0, (np.stack([s, e], axis=1) + r["base"]).ravel().tolist(), 0, 0, 0, 0))
            if r["hot"]:
                for o, c in enumerate(label.tolist()):
                    if c >= 0 and c in sent:
                        continue
                    sent.add(c)
                    d = xxhash.xxh3_128_intdigest(r["body"][o:o + width])
                    k1, k2 = (x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & 0xFFFFFFFFFFFFFFFF))
                    # a window that its shard has several times, or whose run repeats whole, is settled but counts for others
                    out.append((r["a"], r["g"], 2 if c >= 0 or r["whole"] else 1, [o + r["base"]], k1, k2, r["low"], r["high"]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.int64()] * 4]
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)],
                               names=["a", "g", "kind", "at", "k1", "k2", "low", "high"])

    def run(batches):
        held, shard = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard and held:
                    yield solve(held)
                    held = []
                shard = r["shard"]
                held.append(r)
        if held:
            yield solve(held)

    return run


def _merge(batches):
    """Keys of one range, sorted: a window is repeated if binary search finds its key at another place too."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    ask = np.flatnonzero(t.column("kind").to_numpy() == 1)
    k1, k2, low, high = (t.column(c).to_numpy() for c in ("k1", "k2", "low", "high"))
    lo, hi = np.searchsorted(k1, k1[ask], "left"), np.searchsorted(k1, k1[ask], "right")
    near = hi - lo > 1
    twice = []
    for i, l, h in zip(ask[near], lo[near], hi[near]):
        same = k2[l:h] == k2[i]
        if low[l:h][same].min() != high[l:h][same].max():
            twice.append(i)
    found = t.take(pa.array(twice, pa.int64())).to_pylist()
    yield pa.record_batch([pa.array([r["a"] for r in found], pa.int64()), pa.array([r["g"] for r in found], pa.int64()),
                           pa.array([[r["at"][0], r["at"][0] + 1] for r in found], pa.list_(pa.int32()))], names=["a", "g", "at"])


def repeated_spans(docs: DataFrame, width: int, gram: int, scoped: bool = False) -> DataFrame:
    """ord, fold, spans: per text the (start, end) byte ranges covered by repeated windows; may overlap.

    A window is repeated if it starts anywhere else; with ``scoped``, if it also
    starts in another text (ord, fold) of the same ``scope`` (a long).
    """
    columns = ["ord", "fold", "text", *(["scope"] if scoped else [])]
    runs = staged(docs.select(*columns).mapInArrow(_runs(width, gram, scoped), RUNS), "suffixes-runs")
    place = F.xxhash64("ord", "fold")
    repeats = (F.min(place) != F.max(place)) if scoped else (F.sum("reps") > 1)
    again = runs.groupBy("a").agg(repeats.alias("r")).where("r").select("a")
    runs = staged(runs.join(again, "a", "left_semi"), "suffixes-recurring")
    low, high = (F.min(place), F.max(place)) if scoped else (F.xxhash64("a", "g"), F.xxhash64("a", "g"))  # a run is its own place
    kinds = staged(runs.groupBy("a", "g").agg(repeats.alias("whole"), F.first("n").alias("n"), F.first("off").alias("off"), F.min(F.struct("ord", "fold", "start")).alias("at"),
                                              low.alias("low"), high.alias("high")), "suffixes-kinds")
    several = staged(kinds.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "suffixes-several")
    mixed = kinds.join(several, "a").withColumn("hot", F.col("m") > HOT)
    wanted = (mixed.select(F.col("at.ord").alias("ord"), F.col("at.fold").alias("fold"),
                           F.struct("a", "g", F.col("at.start").alias("start"), "n", "off", "whole", "hot", "low", "high").alias("w"))
              .groupBy("ord", "fold").agg(F.collect_list("w").alias("wanted")))  # bounded by the text's length
    bodies = (docs.select("ord", "fold", "text").join(wanted, ["ord", "fold"])
              .mapInArrow(_read(width), BODIES).dropDuplicates(["a", "g", "base"]))
    bodies = staged(bodies, "suffixes-bodies")
    meets = bodies.where("hot").groupBy("meet").count().where("count > 1").select("meet", (F.col("count") > HOT).alias("many"))
    several = bodies.where("hot").join(meets, "meet").select(*bodies.columns, "many").drop("hot").withColumnRenamed("many", "hot")
    bodies = staged(bodies.where("NOT hot").drop("hot").withColumn("hot", F.lit(False)).unionByName(several), "suffixes-met")
    total = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, total // SHARD_BYTES + 1)
    dealt = (bodies.withColumn("shard", F.pmod(F.when(F.col("hot"), F.xxhash64("a", "g", "base")).otherwise(F.xxhash64("meet")), F.lit(shards)))
             .repartition("shard").sortWithinPartitions("shard"))
    verdicts = staged(dealt.mapInArrow(_verdicts(width), VERDICTS), "suffixes-verdicts")
    across = (verdicts.where("kind > 0").repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2")
              .mapInArrow(_merge, "a long, g long, at array<int>"))
    marks = verdicts.where("kind = 0").select("a", "g", "at").union(across).groupBy("a", "g").agg(F.flatten(F.collect_list("at")).alias("at"))  # bounded by a run's length
    settled = kinds.select("a", "g", "whole").join(marks, ["a", "g"], "left").where("whole OR at IS NOT NULL")
    spans = runs.join(settled, ["a", "g"]).select("ord", "fold", F.when(
        F.col("whole"), F.array(F.col("start"), F.col("start") + F.col("n") * F.col("reps") + (width - 1))).otherwise(
        F.transform("at", lambda x, i: F.col("start") + x + F.when(i % 2 == 1, width - 1).otherwise(0))).alias("s"))
    return spans.groupBy("ord", "fold").agg(F.flatten(F.collect_list("s")).alias("spans"))  # bounded by the text's length


def _strip(batches):
    for part in by_bytes(batches, "text", PIECE):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans")):
            raw = (text or "").encode()
            n_bytes.append(len(raw))
            if not spans.is_valid:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(hashlib.sha256(raw).hexdigest())
                continue
            at = spans.values.to_numpy().astype(np.int64)
            gone = covered(len(raw), at[::2], at[1::2])
            n_removed.append(int(gone.sum()))
            n_spans.append(len(runs_of(gone)[0]))
            kept.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.record_batch([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept)],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, width: int = 200, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    small_batches(docs.sparkSession)
    docs = keyed(docs, id_col, text_col)
    return docs.join(repeated_spans(docs, width, gram), ["ord", "fold"], "left").select("doc_id", "text", "spans").mapInArrow(
        _strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
