"""Benchmark decontamination with a generalised suffix automaton.

Spark tasks cut the benchmark's items into blocks of bounded size, turn each
block into one automaton of all its items' word sequences, and write it to the
shared folder; neither items nor automata pass through the driver.  All
documents stream through the blocks: per word the automaton keeps the longest
suffix of the text read so far that occurs in some item.  Where that length
reaches the window, the last ``window`` words are an item's window; a shorter
item is a window by itself.  The documents are never shuffled.  A task holds
one block at a time: a single block stays loaded, several are read in turn for
every ``POOL_BYTES`` of texts.

Null texts and items have no words, items without words match nothing, equal
items all count, and repeated rows are judged each for itself.  A null item id
is written as an empty string in the id list.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, id_and_text, small_batches, staged
from .tokenfiles import open_shared

# Words: digits, a-z after lower-casing, and everything beyond ASCII.
_KEEP = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK_WORDS = 100_000
POOL_BYTES = 32_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


@dataclass
class Automaton:
    """Suffix automaton of many word sequences; states know the items their longest strings come from."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[list[int]] = field(default_factory=lambda: [[]])  # items in which the state's strings occur
    whole: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])  # (words, item) of short items ending here or at a suffix

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append([])
        self.whole.append([])
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q  # another item has read this far
        new = self._state(length[last] + 1, {}, 0) if q is None else -1
        p = last
        if q is None:
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p == -1:
                return new
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
                return new
        twin = self._state(length[p] + 1, dict(nxt[q]), link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        link[q] = twin
        if new != -1:
            link[new] = twin
            return new
        return twin

    @classmethod
    def build(cls, items: list[list[bytes]], window: int) -> Automaton:
        """``items``: word lists; shorter ones than ``window`` match only as a whole."""
        a = cls()
        coded = [[a.vocabulary.setdefault(w, len(a.vocabulary)) for w in words] for words in items]
        for codes in coded:
            last = 0
            for c in codes:
                last = a._extend(last, c)
        for i, codes in enumerate(coded):
            at = 0
            for c in codes:
                at = a.next[at][c]
                up = at
                while up and (not a.items[up] or a.items[up][-1] != i):
                    a.items[up].append(i)
                    up = a.link[up]
            if 0 < len(codes) < window:
                while a.length[a.link[at]] >= len(codes):
                    at = a.link[at]
                a.whole[at].append((len(codes), i))
        for s in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            if a.link[s] > 0:
                a.whole[s] = a.whole[s] + a.whole[a.link[s]]
        return a

    def hits(self, words: list[bytes], window: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Covered word spans (merged, in order) and the items with an occurring window."""
        nxt, link, length, whole = self.next, self.link, self.length, self.whole
        spans: list[list[int]] = []
        found: set[int] = set()
        state = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = n = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            state = nxt[state].get(c, 0)
            n = n + 1 if state else 0
            reach = 0
            if n >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found.update(self.items[at])
                reach = window
            for k, item in whole[state]:
                if k <= n:
                    found.add(item)
                    reach = max(reach, k)
            if reach:
                start = i - reach + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [tuple(s) for s in spans], found


@dataclass(frozen=True)
class Blocks:
    """Written automata: ``files`` hold ``count`` of them, one a row."""

    files: tuple[str, ...]
    count: int

    def __iter__(self) -> Iterator[tuple[list[str], Automaton]]:
        if self.count == 0:
            yield [], Automaton()
        elif self.count == 1:
            yield _only(self)
        else:
            yield from _loaded(self.files)

    def pools(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
        """Rows to be held while the blocks go by: small pieces if there is one block, else about ``POOL_BYTES`` of ``column``."""
        if self.count < 2:
            yield from by_bytes(batches, column)
            return
        held, size = [], 0
        for part in by_bytes(batches, column):
            held.append(part)
            size += part.column(column).nbytes
            if size >= POOL_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)


def _loaded(files: tuple[str, ...]) -> Iterator[tuple[list[str], Automaton]]:
    for name in files:
        with open_shared(name) as f:
            for row in pq.ParquetFile(f).iter_batches(batch_size=1, columns=["block"]):
                for block in row.column("block"):
                    yield pickle.loads(block.as_py())


@lru_cache(maxsize=1)
def _only(blocks: Blocks) -> tuple[list[str], Automaton]:
    """A table's only block, loaded once per worker process."""
    return next(_loaded(blocks.files))


def _build(window: int, block_words: int):
    def run(batches):
        def block():
            return pa.record_batch([pa.array([pickle.dumps((ids, Automaton.build(texts, window)), 5)], pa.binary())], names=["block"])

        ids, texts, size = [], [], 0
        for part in by_bytes(batches, "text"):
            for item, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                if ids and size + len(words) > block_words:
                    yield block()
                    ids, texts, size = [], [], 0
                ids.append(item or "")
                texts.append(words)
                size += len(words)
        if ids:
            yield block()
    return run


def item_blocks(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Blocks:
    """Automata of at most ``block_words`` words or a single item each, built and written by tasks of about one block."""
    small_batches(items.sparkSession)
    rows = staged(items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
                  .where("text IS NOT NULL"), "benchmark")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    built = staged(rows.repartition(size // (8 * block_words) + 1).mapInArrow(_build(window, block_words), "block binary"), "benchmark-automata")
    return Blocks(tuple(sorted(built.inputFiles())), built.count())


def _merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _marks(texts: list[str | None], blocks: Blocks, window: int) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Per text: words, covered word ranges of all blocks, and sorted ids of the items found."""
    n_words, spans, items = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
    for ids, automaton in blocks:
        for i, text in enumerate(texts):
            words = words_of(text)
            n_words[i] = len(words)
            new, found = automaton.hits(words, window)
            if new:
                spans[i] = _merge(spans[i], [x for s in new for x in s])
                items[i] += [ids[k] for k in found]
    return n_words, spans, [sorted(x) for x in items]


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, spans (covered word ranges: start, end, start, end, ...), items (sorted ids)."""
    small_batches(docs.sparkSession)
    blocks = item_blocks(items, window, block_words=block_words)

    def run(batches):
        for part in blocks.pools(batches, "text"):
            n_words, spans, found = _marks(part.column("text").to_pylist(), blocks, window)
            yield pa.record_batch([part.column("doc_id"), part.column("text"), pa.array(n_words, pa.int64()),
                                   pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                                  names=["doc_id", "text", "n_words", "spans", "items"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_words long, spans array<int>, items array<string>")


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    def run(batches):
        for b in batches:
            spans = b.column("spans").to_pylist()
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            items_ = b.column("items").to_pylist()
            yield pa.record_batch([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()),
                                   pa.array([len(x) for x in items_], pa.int64()),
                                   pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items_]),
                                   pa.array([h > 0 for h in hit])],
                                  names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    return matches(docs, items, window).select("doc_id", "n_words", "spans", "items").mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut(text: str, spans: list[int]) -> str:
    """``text`` without the given word ranges and the white space before each, all else untouched."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, pos = [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        out.append(text[pos:at[s][0]].rstrip(" \t"))
        pos = at[e - 1][1]
    return "".join([*out, text[pos:]])


def cleaned(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text",
            count_col: str | None = "n_chars", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, hit spans cut out; a document covered to ``max_coverage`` or more goes.

    ``count_col``, if the table has it, is set to the new text's code points where the text changed.
    """
    small_batches(docs.sparkSession)
    blocks = item_blocks(items, window, block_words=block_words)
    names = docs.columns

    def run(batches):
        for part in blocks.pools(batches, text_col):
            texts = part.column(text_col).to_pylist()
            n_words, spans, _ = _marks(texts, blocks, window)
            keep, changed = [], {}
            for i, (n, s) in enumerate(zip(n_words, spans)):
                keep.append(not s or sum(s[1::2]) - sum(s[::2]) < max_coverage * n)
                if s and keep[-1]:
                    changed[i] = cut(texts[i], s)
            columns = {n: part.column(n) for n in names}
            if changed:
                columns[text_col] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[text_col].type)
                if count_col in columns:
                    old = columns[count_col].to_pylist()
                    columns[count_col] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old)], columns[count_col].type)
            yield pa.record_batch(list(columns.values()), names=names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
