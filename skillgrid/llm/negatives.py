"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Rows are dealt to chunks of about ``CHUNK`` rows.  In a chunk every dimension
has its rows in descending order.  An anchor reads all its lists in step, from
the top where its own component is positive and from the bottom where it is
negative, and scores each row it meets for the first time by its exact integer
inner product.  The threshold is the score of an imaginary row that stands at
the present depth of every list; no row that was not met can score more.
Reading stops once the threshold is strictly below the k-th score of every
window that is full, and below the lower end of every window that is not, so
ties at the k-th score are always met.

Two passes: the first finds each anchor's positives (one open window over rows
of its label), the second its negatives (one window per positive, bounded by a
share of the positive's score).  What the chunks find is merged by rank.

Defined results: a row with a null label, a null vector, or a null or
non-finite component takes no part.  Vectors of different lengths are compared
as if the shorter one ended in zeros; an empty vector scores 0.  Scaled
components are held within +-2^24 (|x| up to 65,536 at scale 256), so that
scores stay within 64 bits.  Null ids order last; rows that share an id are
rows of their own, each an anchor if the id is one.  Fewer positives or
negatives than asked for are returned as they are; an anchor without positives
has no rows.  Columns beside the three named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

CHUNK = 8192       # candidate rows of a cell
ANCHORS = 2048     # anchors of a cell
LIMIT = float(2 ** 24)
ALL = (-(2 ** 63), 2 ** 63 - 1)
FOUND = "anchor_row long, window int, row long, id long, score long"


def quantised(vectors: DataFrame, label: Column, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows that take part: row (a number of their own), id, label and floor(scale * component)."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-LIMIT)), F.lit(LIMIT))))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("v"))
            .where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(whole)
            .select(F.monotonically_increasing_id().alias("row"), "id", "label", scaled.alias("q")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as integer rows of ``dims`` components, zeros behind the shorter ones."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def _longest(table: pa.Table) -> int:
    return pa.compute.max(pa.compute.list_value_length(table["q"])).as_py() or 0


class Best:
    """The first k rows of one score window: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.at, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        least = self.scores[-1] if len(self.scores) == self.k else self.low
        keep = (scores >= least) & (scores <= self.high)
        at, scores = np.concatenate([self.at, at[keep]]), np.concatenate([self.scores, scores[keep]])
        if len(at) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            at, scores = at[scores >= cut], scores[scores >= cut]
        order = np.lexsort((ids[at], nulls[at], -scores))[: self.k]
        self.at, self.scores = at[order], scores[order]

    def settled(self, threshold: float) -> bool:
        """No row that scores ``threshold`` or less can still enter."""
        return threshold < (self.scores[-1] if len(self.scores) == self.k else self.low)


class SortedLists:
    """A chunk's rows in descending order of every dimension."""

    def __init__(self, x: np.ndarray, largest: int):
        self.n, self.dims = x.shape
        exact = float(np.abs(x).max(initial=0)) * largest * max(self.dims, 1) < 2 ** 53
        self.x = x.astype(np.float64) if exact else x      # doubles hold these sums exactly, and multiply faster
        self.order = np.argsort(-x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)

    def search(self, q: np.ndarray, windows: list[Best], offer) -> int:
        """Read the lists until every window is settled; the number of rows met."""
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        weights = q.astype(self.x.dtype)
        seen = np.zeros(self.n, bool)
        depth, step = 0, max(16, self.n // 128)
        if not len(up) and not len(down):
            depth = self.n                                   # a zero anchor scores every row 0
            offer(np.arange(self.n), np.zeros(self.n, np.int64))
        while depth < self.n:
            to = min(self.n, depth + step)
            met = np.zeros(self.n, bool)
            met[self.order[depth:to, up]] = True
            met[self.order[self.n - to: self.n - depth, down]] = True
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            offer(new, (self.x[new] @ weights).astype(np.int64))
            threshold = int(self.sorted[to - 1, up] @ q[up]) + int(self.sorted[self.n - to, down] @ q[down])
            if all(w.settled(threshold) for w in windows):
                break
            depth, step = to, step * 2
        return int(seen.sum())


def _cells(left: DataFrame, right: DataFrame, solve) -> DataFrame:
    """``solve(anchors, rows)`` for every cell of an anchor block and a chunk of rows."""
    return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(solve, FOUND)


def _solver(k: int, same_label: bool):
    def solve(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            dims = max(_longest(anchors), _longest(rows))
            mine = _matrix(anchors["q"], dims)
            lists = SortedLists(_matrix(rows["q"], dims), int(np.abs(mine).max(initial=0)))
            number, labels = rows["row"].to_numpy(), rows["label"].to_numpy()
            nulls = rows["id"].is_null().to_numpy()
            ids = rows["id"].fill_null(2 ** 63 - 1).to_numpy()
            spans = anchors["windows"].to_pylist()
            for q, anchor, label, bounds in zip(mine, anchors["row"].to_pylist(), anchors["label"].to_pylist(), spans):
                best = [Best(k, b["low"], b["high"]) for b in bounds]
                fits = (labels == label) & (number != anchor) if same_label else labels != label

                def offer(at, scores, best=best, fits=fits):
                    good = fits[at]
                    at, scores = at[good], scores[good]
                    for b in best:
                        b.offer(at, scores, ids, nulls)

                lists.search(q, best, offer)
                out += [(anchor, b["window"], int(number[i]), None if nulls[i] else int(ids[i]), int(s))
                        for b, held in zip(bounds, best) for i, s in zip(held.at, held.scores)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_row", "window", "row", "id", "score"])

    return solve


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_row", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
                   chunk: int = CHUNK, block: int = ANCHORS) -> DataFrame:
    """(row, id, label, q) rows -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows ask.  A positive's negatives have another label
    and a score of ``low`` to ``high`` hundredths of the positive's.
    """
    rows = staged(rows.withColumn("asks", F.coalesce(anchor, F.lit(False))), "negatives-rows")
    counts = rows.agg(F.count("*"), F.count_if("asks")).first()
    chunks, blocks = counts[0] // chunk + 1, counts[1] // block + 1
    right = (rows.select(*(F.col(c).alias(c) for c in ("row", "id", "label", "q")), F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("c"))
             .withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    ask = (rows.where("asks").select("row", "id", "label", "q", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("a"))
           .withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))))

    def bound(window, lo, hi):
        return F.struct(window.cast("int").alias("window"), lo.cast("long").alias("low"), hi.cast("long").alias("high"))

    open_window = F.array(bound(F.lit(0), F.lit(ALL[0]), F.lit(ALL[1])))
    positives = staged(_first(_cells(ask.withColumn("windows", open_window), right, _solver(n_positives, True)), n_positives)
                       .select("anchor_row", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                       "negatives-positives")
    score = F.col("positive_score")
    # smallest and largest integers within the two shares of the score
    lo, hi = -F.floor(-score * low / F.lit(100)), F.floor(score * high / F.lit(100))
    exact_lo = F.when(lo * 100 < score * low, lo + 1).when((lo - 1) * 100 >= score * low, lo - 1).otherwise(lo)
    exact_hi = F.when(hi * 100 > score * high, hi - 1).when((hi + 1) * 100 <= score * high, hi + 1).otherwise(hi)
    windows = (positives.withColumn("low", exact_lo).withColumn("high", exact_hi).where("low <= high")
               .groupBy("anchor_row").agg(F.collect_list(bound(F.col("window"), F.col("low"), F.col("high"))).alias("windows")))
    asks = ask.join(windows, ask.row == windows.anchor_row).drop("anchor_row")
    found = _first(_cells(asks, right, _solver(n_negatives, False)), n_negatives)
    names = rows.where("asks").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return (found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
            .join(positives, ["anchor_row", "window"]).join(names, "anchor_row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
