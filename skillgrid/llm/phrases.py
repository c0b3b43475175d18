"""Substring dedup with repeated-phrase automata.

A window is ``width`` consecutive words of one document; its anchor is its
least phrase of ``gram`` words, so copies of a window have the same anchor.

1. One pass lists every document's runs of windows with a common anchor.
2. Runs whose anchor stands in several documents are the recurring passages;
   an aggregate finds the first document of each.  Where one anchor has several
   different runs, their windows are compared one by one through an aggregate.
3. Every document gets the phrases of its recurring passages.  A task compiles
   them into an Aho-Corasick automaton per bounded piece of documents, streams
   the documents through it, and confirms each occurrence by a 128-bit digest of
   the whole passage as read from its first document.
4. Windows that also start in a document with a smaller id are marked, and the
   marked words go.

All steps are aggregates and equi-joins on anchors, passages or documents;
copies are merged before they meet.  Null ids count as larger than all others;
rows that share an id never remove from each other; null texts have no words.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, fold_of, keyed, small_batches, staged
from .spans import anchor_table, byte_view, covered, hash_spans, runs_of, word_bounds

RUNS = "a long, g long, ord long, fold long, start int, n int, off int"
PIECE = 500_000  # bytes of text that share one automaton


def _runs(width: int, gram: int):
    def run(batches):
        for part in by_bytes(batches, "text"):
            raw, offsets = byte_view(part.column("text"))
            starts, ends, row = word_bounds(raw, offsets)
            t = anchor_table(hash_spans(raw, starts, ends), row, width, gram)
            first = np.searchsorted(row, t["row"])  # word index at which the row begins
            # one row per document and passage is enough: its other places are found by the automaton
            key = np.stack([t["row"].view(np.uint64), t["anchor"], t["digest"]], axis=1)
            once = np.sort(np.unique(key, axis=0, return_index=True)[1]) if len(key) else np.zeros(0, np.int64)
            r = t["row"][once]
            yield pa.record_batch([
                pa.array(t["anchor"][once].view(np.int64)), pa.array(t["digest"][once].view(np.int64)),
                part.column("ord").take(pa.array(r)), part.column("fold").take(pa.array(r)),
                pa.array((t["start"] - first)[once], pa.int32()), pa.array(t["n"][once], pa.int32()), pa.array(t["off"][once], pa.int32())],
                names=["a", "g", "ord", "fold", "start", "n", "off"])
    return run


def passage_digest(words: list[bytes]) -> int:
    return xxhash.xxh3_128_intdigest(b" ".join(words))


def _halves(x: int) -> tuple[int, int]:
    return tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & 0xFFFFFFFFFFFFFFFF))


def _read_first(width: int, gram: int):
    """Per passage: its phrase, its digest, and if its anchor has several passages the digests of its windows."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        for part in by_bytes(batches, "text", PIECE):
            out = []
            for owner, text, wanted in zip(*(part.column(c).to_pylist() for c in ("ord", "text", "wanted"))):
                words = text.encode().split()
                for w in wanted:
                    s, n = w["start"], w["n"]
                    phrase = b" ".join(words[s + w["off"]: s + w["off"] + gram]).decode()
                    windows = [_halves(passage_digest(words[s + o: s + o + width])) for o in range(n)] if w["mixed"] else []
                    out.append((w["a"], w["g"], owner, n, w["off"], phrase, *_halves(passage_digest(words[s: s + n + width - 1])),
                                [x for x, _ in windows], [x for _, x in windows]))
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)],
                                  names=["a", "g", "owner", "n", "off", "phrase", "d1", "d2", "w1", "w2"])
    return run


def passages(runs: DataFrame, docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Recurring passages: a, g, owner, n, off, phrase, d1, d2 and ``own``, the bits of the windows that also start before the owner."""
    spans = runs.groupBy("a", "g").agg(F.min(F.struct("ord", "fold", "start")).alias("at"), F.max("ord").alias("last"),
                                       F.first("n").alias("n"), F.first("off").alias("off"))
    spans = staged(spans, "phrases-passages")
    several = staged(spans.groupBy("a").count().where("count > 1").select("a", F.lit(True).alias("mixed")), "phrases-several")
    # a passage matters if another document has it, or if its anchor has other passages to compare with
    wanted = (spans.join(several, "a", "left").where("mixed OR last > at.ord")
              .select(F.col("at.ord").alias("ord"), F.col("at.fold").alias("fold"),
                      F.struct("a", "g", F.col("at.start").alias("start"), "n", "off", F.coalesce("mixed", F.lit(False)).alias("mixed")).alias("w"))
              .groupBy("ord", "fold").agg(F.collect_list("w").alias("wanted")))  # bounded by the document's length
    texts = docs.select("ord", "fold", "text").join(wanted, ["ord", "fold"])
    read = staged(texts.mapInArrow(_read_first(width, gram), "a long, g long, owner long, n int, off int, phrase string, d1 long, d2 long, "
                                                             "w1 array<long>, w2 array<long>").dropDuplicates(["a", "g"]), "phrases-read")
    windows = read.select("a", "g", "owner", F.posexplode(F.arrays_zip("w1", "w2"))).select("a", "g", "owner", "pos", "col.w1", "col.w2")
    least = windows.groupBy("w1", "w2").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("w1", "w2", "least")
    earlier = (windows.join(least, ["w1", "w2"]).where("least < owner").groupBy("a", "g")
               .agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("own")))
    return read.drop("w1", "w2").join(earlier, ["a", "g"], "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))


def hints(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """ord, fold, hints: what to look for in each document that may lose words."""
    if not 0 < width - gram + 1 <= 63:
        raise ValueError("a run of windows must fit the bits of a long: width - gram + 1 <= 63")
    runs = staged(docs.select("ord", "fold", "text").mapInArrow(_runs(width, gram), RUNS), "phrases-runs")
    shared = runs.groupBy("a").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("a")
    runs = staged(runs.join(shared, "a", "left_semi"), "phrases-shared")
    known = passages(runs, docs, width, gram)
    full = F.lit(-1).cast("long")
    found = (runs.select("a", "g", "ord", "fold").join(known, ["a", "g"])
             .withColumn("mask", F.when(F.col("ord") > F.col("owner"), full).otherwise(F.col("own"))).where("mask <> 0")
             .select("ord", "fold", F.struct("phrase", "n", "off", "d1", "d2", "mask").alias("h")))
    return found.groupBy("ord", "fold").agg(F.collect_list("h").alias("hints"))  # bounded by the document's length


def _spans(words: list[bytes], entries: dict[str, list], automaton, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stream one document; the word spans that the confirmed occurrences of its hinted passages mark."""
    text = " " + b" ".join(words).decode() + " "
    ends = np.cumsum([0, *(len(w.decode()) + 1 for w in words)])  # character index of the blank before word i
    starts_at, ends_at, seen = [], [], set()
    for end, phrase in automaton.iter(text):
        if phrase not in entries:
            continue  # another document's phrase
        at = int(np.searchsorted(ends, end - len(phrase) - 1))
        for h in entries[phrase]:
            s, n = at - h["off"], h["n"]
            if s < 0 or s + n + width - 1 > len(words) or (s, h["d1"], h["d2"]) in seen:
                continue
            seen.add((s, h["d1"], h["d2"]))
            if _halves(passage_digest(words[s: s + n + width - 1])) != (h["d1"], h["d2"]):
                continue
            if h["mask"] == -1:
                starts_at.append(s)
                ends_at.append(s + n + width - 1)
            else:
                for o in range(n):
                    if h["mask"] >> o & 1:
                        starts_at.append(s + o)
                        ends_at.append(s + o + width)
    return np.array(starts_at, np.int64), np.array(ends_at, np.int64)


def _marked(part: pa.RecordBatch, width: int):
    """Per row of a piece: its words and which of them are to go (None if none can)."""
    all_hints = part.column("hints").to_pylist()
    automaton = ahocorasick.Automaton()
    for hs in all_hints:
        for h in hs or ():
            automaton.add_word(f" {h['phrase']} ", h["phrase"])
    if len(automaton):
        automaton.make_automaton()
    for text, hs in zip(part.column("text").to_pylist(), all_hints):
        words = text.encode().split() if text else []
        if not hs:
            yield words, None
            continue
        entries: dict[str, list] = {}
        for h in hs:
            entries.setdefault(h["phrase"], []).append(h)
        yield words, covered(len(words), *_spans(words, entries, automaton, width))


def _report(width: int):
    def run(batches):
        for part in by_bytes(batches, "text", PIECE):
            n_words, n_removed, kept = [], [], []
            for words, gone in _marked(part, width):
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.record_batch([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept)],
                                  names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def report(docs: DataFrame, width: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    small_batches(docs.sparkSession)
    docs = keyed(docs, id_col, text_col)
    return docs.join(hints(docs, width, gram), ["ord", "fold"], "left").select("doc_id", "text", "hints").mapInArrow(
        _report(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: str, gone: np.ndarray) -> str:
    """``text`` without the marked words and the white space before each removed run; the rest is untouched."""
    raw = text.encode()
    starts, ends, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    for s, e in zip(*runs_of(gone)):
        out.append(raw[at:starts[s]].rstrip(b" \t"))
        at = ends[e - 1]
    return b"".join([*out, raw[at:]]).decode()


def deduplicated(docs: DataFrame, width: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text",
                 count_col: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, without their repeated windows; a document that loses its last word goes."""
    small_batches(docs.sparkSession)
    schema, names = docs.schema, docs.columns
    key = keyed(docs, id_col, text_col)
    held = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2 ** 63 - 1)).alias("ord"),
                       fold_of(F.col(f"`{text_col}`").cast("string")).alias("fold"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = held.join(hints(key, width, gram), ["ord", "fold"], "left").select("doc", "text", "hints")

    def run(batches):
        for part in by_bytes(batches, "text", PIECE):
            texts, keep, changed = part.column("text").to_pylist(), [], {}
            for i, (words, gone) in enumerate(_marked(part, width)):
                keep.append(gone is None or not gone.all())
                if keep[-1] and gone is not None and gone.any():
                    changed[i] = cut(texts[i], gone)
            columns = dict(zip(names, part.column("doc").flatten()))
            if changed:
                columns[text_col] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[text_col].type)
                if count_col in columns:
                    old = columns[count_col].to_pylist()
                    columns[count_col] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old)], columns[count_col].type)
            yield pa.record_batch(list(columns.values()), names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)
