"""Best-fit packing of token pieces into bins of several permitted capacities.

Documents longer than the largest capacity are cut into pieces of it.  Pieces
are dealt evenly to groups of a bounded number of pieces; within a group they
are placed longest first into the open bin that they fill best.  A bin of c
tokens costs what a training step over it costs, padding included: c for the
layers, c * c / ``attention`` for attention (about six times the model's width)
and ``overhead``.  So a small bin is cheaper per token, a large one is filled
better, and the lengths compete: where no open bin has room, the capacity is
opened whose forecast cost per token is least, the forecast being that the bin
takes the longest pieces that fit of those still to come.  Every mix of
permitted capacities is tried on the group, bins are cut down to the smallest
capacity that holds their contents, and the mix of least total cost stays; no
single capacity does better.  A group leaves few bins partly filled, so many
groups pack as well as one.

Documents without tokens (null or empty texts) take no room: their row has a
null bin.  Repeated rows are packed each for itself.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, id_and_text, small_batches, staged
from .tokens import Tokenizer

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 4096
OVERHEAD = 32
ATTENTION = 12288
PIECES = "doc_id long, piece int, first_token long, n_tokens long"
PACKED = "bin_id long, capacity int, position int, doc_id long, piece int, first_token long, n_tokens long"


def pieces(docs: DataFrame, tokenizer: Tokenizer, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``longest`` tokens, in order; a document without tokens has one empty piece."""
    small_batches(docs.sparkSession)

    def run(batches):
        for part in by_bytes(batches, "text"):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                n = tokenizer.count(text)
                out += [(doc, k, first, min(longest, n - first)) for k, first in enumerate(range(0, max(n, 1), longest))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "first_token", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> int:
    """Cost of one bin, times ``attention`` to stay whole."""
    return attention * (capacity + overhead) + capacity * capacity


def forecasts(lengths: list[int], sizes: list[int], overhead: int, attention: int) -> dict[int, list[int]]:
    """Per length of ``lengths`` (longest first): the capacities that hold it, the least forecast cost per token first."""
    sums = [0, *accumulate(lengths)]
    falling = [-n for n in lengths]
    out: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        if n in out:
            continue
        rated = []
        for c in sizes:
            if c < n:
                continue
            room, j = c, i
            while (j := bisect_left(falling, -room, j)) < len(lengths):
                k = bisect_right(sums, sums[j] + room, j) - 1  # all of j..k fit one after the other
                room -= sums[k] - sums[j]
                j = k
            held = c - room
            rated.append((cost(next(x for x in sizes if x >= held), overhead, attention) / held, c))
        out[n] = [c for _, c in sorted(rated)]
    return out


def _fill(lengths: list[int], largest: int, opens: dict[int, int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit, a bin of ``opens[n]`` being opened for a piece of n: (bin, position) of each piece, and tokens per bin."""
    with_room: list[list[int]] = [[] for _ in range(largest + 1)]  # bins by the room they have left
    open_rooms = 0  # bit r: some bin has r left
    places, used = [], []
    for n in lengths:
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room = opens[n]
            b = len(used)
            used.append(0)
        places.append((b, used[b]))
        used[b] += n
        room -= n
        if room:
            with_room[room].append(b)
            open_rooms |= 1 << room
    return places, used


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int, attention: int = ATTENTION) -> tuple[list[tuple[int, int]], list[int]]:
    """Place ``lengths`` (longest first): (bin, position) of each, and every bin's final capacity.

    A piece that a mix has no capacity for opens the smallest that holds it.  Of mixes of equal cost the first stays,
    fewer capacities before more.
    """
    sizes = sorted(set(capacities))
    ranked = forecasts(lengths, sizes, overhead, attention)
    best = None
    for mix in (m for k in range(1, len(sizes) + 1) for m in combinations(sizes, k)):
        opens = {n: next((c for c in order if c in mix), min(order)) for n, order in ranked.items()}
        places, used = _fill(lengths, sizes[-1], opens)
        final = [sizes[bisect_left(sizes, u)] for u in used]
        total = sum(cost(c, overhead, attention) for c in final)
        if best is None or total < best[0]:
            best = total, places, final
    return best[1], best[2]


def _pack(capacities: tuple[int, ...], overhead: int, attention: int):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["bin_id", "capacity", "position", "doc_id", "piece", "first_token", "n_tokens"]

    def solve(group, rows):
        places, final = best_fit([r["n_tokens"] for r in rows], capacities, overhead, attention)
        out = [((group << 20) + b, final[b], at, r["doc_id"], r["piece"], r["first_token"], r["n_tokens"]) for (b, at), r in zip(places, rows)]
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches):
        held, group = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["grp"] != group and held:
                    yield solve(group, held)
                    held = []
                group = r["grp"]
                held.append(r)
        if held:
            yield solve(group, held)

    return run


def pack(rows: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group: int = GROUP,
         attention: int = ATTENTION) -> DataFrame:
    """Pieces -> bin_id, capacity (after downsizing), position in the bin, and the piece."""
    rows = staged(rows, "packing-pieces")
    full = rows.where("n_tokens > 0")
    groups = full.count() // group + 1
    dealt = (full.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
             .repartition("grp").sortWithinPartitions("grp", F.col("n_tokens").desc(), "doc_id", "piece"))
    empty = rows.where("n_tokens = 0").select(F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"),
                                              F.lit(None).cast("int").alias("position"), "doc_id", "piece", "first_token", "n_tokens")
    return dealt.mapInArrow(_pack(tuple(capacities), overhead, attention), PACKED).union(empty)


def packed_documents(docs: DataFrame, tokenizer: Tokenizer = Tokenizer("byte_bpe_50k@1"), capacities: tuple[int, ...] = CAPACITIES,
                     overhead: int = OVERHEAD, group: int = GROUP, attention: int = ATTENTION) -> DataFrame:
    return pack(pieces(docs, tokenizer, max(capacities)), capacities, overhead, group, attention)
