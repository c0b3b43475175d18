"""Quality rules: a bitmask ledger.

Each document is measured once.  The ledger stores the measurements and one
bit per failed rule; a policy is a versioned mask over those bits, so another
policy, or the effect of leaving a rule out, costs a bitwise aggregate over
the ledger and no second look at any text.

Null texts count as empty; an empty or short text fails the word-count rule.
Repeated rows are judged each for itself, null ids stay null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, id_and_text, small_batches
from .spans import byte_view, hash_spans, mix, rolling, word_bounds

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_latin")
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

# Bit, name, failure condition; the same whole-number arithmetic serves Spark columns and numpy arrays.
RULES = (
    (0, "too_few_words", lambda m: m["n_words"] < 10),
    (1, "repeated_word_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    (2, "symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    (3, "duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 35 * m["n_lines"]),
    (4, "short_words", lambda m: 10 * m["word_chars"] < 25 * m["n_words"]),
    (5, "long_words", lambda m: m["word_chars"] > 12 * m["n_words"]),
    (6, "capitals", lambda m: 2 * m["n_capitals"] > m["n_latin"]),
    (7, "too_many_words", lambda m: m["n_words"] > 1000000),
)
BIT = {name: 1 << bit for bit, name, _ in RULES}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_word_windows"))
LENIENT = Policy("web", 1, ("too_few_words", "repeated_word_windows", "symbols"))
STANDARD = Policy("web", 2, ("too_few_words", "repeated_word_windows", "symbols", "duplicate_lines", "short_words",
                             "long_words", "capitals"))


def _repeat_words(words: list[bytes], k: int = 5) -> int:
    """Words inside ``k``-word windows that stand twice or more, compared by word ids, not hashes."""
    n, ids = len(words), {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    run, size = one, 1
    while size < k:
        step = min(size, k - size)
        right = run if step == size else one
        tail = right[size: size + n - size - step + 1]
        run = np.unique(run[: len(tail)] * (int(right.max()) + 1) + tail, return_inverse=True)[1]
        size += step
    twice = np.bincount(run)[run] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measure(batches):
    blank = " \t\r\x0b\x0c"
    for part in by_bytes(batches, "text"):
        raw, offsets = byte_view(part.column("text"))
        texts = part.column("text").to_pylist()
        n = len(texts)
        starts, ends, row = word_bounds(raw, offsets)
        n_words = np.bincount(row, minlength=n)
        # rows in which some five-word window may stand twice; only those are looked at word by word
        suspect = np.zeros(0, np.int64)
        if len(starts) >= 5:
            h = rolling(hash_spans(raw, starts, ends), 5)
            whole = row[: len(h)] == row[4:]
            key, of = mix(h[whole] ^ row[: len(h)][whole].astype(np.uint64)), row[: len(h)][whole]
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            suspect = np.unique(of[order[1:][same]])
        repeats = np.zeros(n, np.int64)
        for i in suspect:
            repeats[i] = _repeat_words(texts[i].encode().split())
        out = {m: np.zeros(n, np.int64) for m in MEASURES}
        out["n_words"], out["n_repeat_words"] = n_words, repeats
        upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        for name, mask in (("n_capitals", upper), ("n_latin", upper | lower)):
            total = np.concatenate([[0], np.cumsum(mask)])
            out[name] = total[offsets[1:]] - total[offsets[:-1]]
        for i, text in enumerate(texts):
            if text:
                out["word_chars"][i] = len(text) - sum(map(text.count, blank)) - text.count("\n")
                out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
                lines = [x for x in text.split("\n") if x.strip(blank)]
                out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        yield pa.record_batch([part.column("doc_id"), *(pa.array(out[m], pa.int64()) for m in MEASURES)], names=["doc_id", *MEASURES])


def fail_bits() -> Column:
    m = {x: F.col(x) for x in MEASURES}
    return sum((F.when(fails(m), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, fails in RULES), F.lit(0)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measurements and ``fail_bits``.  One map-side pass, no shuffle."""
    small_batches(docs.sparkSession)
    measured = id_and_text(docs, id_col, text_col).mapInArrow(_measure, SCHEMA)
    return measured.withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """``kept`` under a policy: no bit of its mask is set."""
    return (rows.withColumn("policy", F.lit(f"{policy.name}@{policy.version}"))
            .withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of ``policy``: rows failing it, and rows that only this rule rejects (kept if it were left out)."""
    masked = rows.select(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("b"))
    counts = masked.groupBy("b").count()  # at most 2^rules rows
    exploded = counts.withColumn("r", F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules))))
    return (exploded.groupBy(F.col("r.rule").alias("rule"))
            .agg(F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("count"))), F.lit(0)).alias("n_failed"),
                 F.coalesce(F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("count"))), F.lit(0)).alias("n_only_this"),
                 F.sum("count").alias("n_rows"))
            .withColumn("policy", F.lit(f"{policy.name}@{policy.version}")))


def shared_failures(rows: DataFrame, by: str) -> DataFrame:
    """Per group: bits that every row fails, bits that any row fails, and clean rows."""
    return rows.groupBy(by).agg(F.bit_and("fail_bits").alias("all_fail"), F.bit_or("fail_bits").alias("any_fail"),
                                F.count_if(F.col("fail_bits") == 0).alias("n_clean"), F.count("*").alias("n_rows"))


def kept_documents(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The documents a policy keeps, all their columns: measured in one pass with the rows passed through."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    mask = policy.mask

    def keep(batches):
        for batch in by_bytes(batches, "text"):
            ids = pa.array(range(batch.num_rows), pa.int64())
            measured = next(_measure(iter([pa.record_batch([ids, batch.column("text")], names=["doc_id", "text"])])))
            m = {x: measured.column(x).to_numpy() for x in MEASURES}
            bits = sum((np.where(fails(m), 1 << bit, 0) for bit, _, fails in RULES), np.int64(0))
            yield batch.filter(pa.array((bits & mask) == 0))

    return docs.mapInArrow(keep, schema)
