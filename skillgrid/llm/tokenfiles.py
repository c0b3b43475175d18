"""Token ids in binary shard files, with a minimal perfect hash from document keys to places.

A data set is a folder:

* ``shards/``: one file per range of documents.  It starts with the raw ids,
  little-endian (2 bytes where the vocabulary has at most 65,536 ids, else 4),
  documents in ascending id order, each closed by id 0.  A footer (ids of the
  documents, counts) and a fixed trailer follow.  Spark's own text writer puts
  the rows down byte by byte, with the closing id as line separator, so files
  appear by Spark's commit, in any store that Spark writes.
* ``index/``: Parquet rows of about ``BUCKET`` keys each, a minimal perfect
  hash per row: keys hash to bits of a level, those that meet no other stay,
  the rest goes to the next level; a key's slot is the number of set bits
  before its own.  By slot: a 32-bit fingerprint, shard, offset and count.  A
  lookup reads one row, a few bits, one slot, and then the ids at one place of
  one file.
* ``manifest/``: one Parquet row per shard (path, first id position, counts),
  written last; without it the data set is not there.

Defined results: a null text is empty and has only the closing id.  Null ids
come last.  Rows that share an id (null too) are told apart by ``copy``, 0, 1,
... in file order, which is by a 64-bit text hash; equal rows are
interchangeable.  Texts are data: the strings of special tokens are encoded as
ordinary text.  A key that is not there is found absent but for one lookup in
2^32.  Columns beside the two named ones are ignored; an empty table makes an
empty data set.  One document's ids must stay below 2 GB.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_bytes, keyed, partitions, small_batches, staged
from .spans import C1, C2, mix

SHARD_BYTES = 256_000_000     # text of a shard, where that makes more shards than shuffle partitions
BUCKET = 4096                 # keys of an index row, on average
PIECE = 200_000               # characters after which a long text is cut, where a cut changes no id
WORDS = 1_000_000             # words whose ids a worker keeps
MAGIC = b"TOKIDS01"
TRAILER = np.dtype([("magic", "S8"), ("part", "<i4"), ("width", "<i4"), ("docs", "<i8"), ("tokens", "<i8")])
INDEX = "bucket long, n_keys int, sizes array<int>, bits binary, prints binary, shards binary, offsets binary, counts binary"


@dataclass(frozen=True)
class FileTokenizer:
    """A vocabulary file of the tokenizers library; the path is a parameter."""

    path: str

    @property
    def width(self) -> int:
        return 2 if load_tokenizer(self.path).get_vocab_size() <= 65_536 else 4

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, little-endian.

        The vocabulary's splitter starts a new word at every single space and
        line end between two other characters, whatever stands around.  So words
        are encoded once per worker and joined; a text with other white space
        goes through the library as it is, in long pieces.
        """
        words = word_ids(self.path)
        if not words.joinable:
            return words.library(text)
        out = []
        for k, piece in enumerate(pieces(text)):
            first, *rest = (piece[1:] if k else piece).replace("\n", " \n").split(" ")    # later pieces start with the space of their first word
            try:
                ids = list(map(words.__getitem__, rest))
                out += [words[first] if k else words.opening(first), *ids]
            except OddSpace:
                out.append(words.library(piece))
        return b"".join(out)


class OddSpace(Exception):
    """White space other than single spaces and line ends between words."""


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordIds(dict):
    """Ids of words as they stand behind a space (or from their own line end on); at most ``WORDS`` are kept."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 65_536 else "I"
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        # only then does a word's encoding not depend on its neighbours
        self.joinable = (made["normalizer"] is None and made["post_processor"] is None and made["model"]["type"] == "BPE"
                         and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False))
        self.model, self.characters = self.tokenizer.model, byte_characters()

    def packed(self, ids) -> bytes:
        ids = array(self.kind, ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def library(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def opening(self, word: str) -> bytes:
        """Ids of a text's first word."""
        if word[:1].isspace() or word[-1:].isspace():
            raise OddSpace
        return self.library(word)

    def __missing__(self, word: str) -> bytes:
        bare = word[1:] if word[:1] == "\n" else word
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise OddSpace
        if word.isalpha():                                   # one word to the splitter: straight to the merges
            ids = self.packed([t.id for t in self.model.tokenize(f" {word}".encode().decode("latin-1").translate(self.characters))])
        elif word[-1] in ",." and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self.library(word[-1])   # a mark behind a letter is a word of its own
        else:
            ids = self.library(word if word[0] == "\n" else " " + word)
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


_CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """A text in pieces of about ``size`` characters, cut before a single space between two letters, where a new word starts anyway."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


def _encode(tokenizer: FileTokenizer):
    """Sorted rows of one range -> the lines of its shard file: each document's ids, then footer and trailer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, counts, part = [], [], [], -1
        for batch in by_bytes(batches, "text", 1_000_000):
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            encoded = [tokenizer.encode(t or "") for t in batch.column("text").to_pylist()]
            ids.append(batch.column("doc_id").fill_null(0).to_numpy())
            known.append(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            counts.append(np.array([len(e) // tokenizer.width + 1 for e in encoded], "<i8"))
            yield pa.record_batch([pa.array(encoded, pa.binary())], names=["line"])
        if ids:
            ids, known, counts = (np.concatenate(x) for x in (ids, known, counts))
            end = np.array([(MAGIC, part, tokenizer.width, len(ids), counts.sum())], TRAILER)
            footer = ids.astype("<i8").tobytes() + counts.tobytes() + known.astype("u1").tobytes() + end.tobytes()
            yield pa.record_batch([pa.array([footer], pa.binary())], names=["line"])
    return run


def open_shared(path: str) -> pa.NativeFile:
    """A file of the shared store for reading at any place (Hadoop's spelling of its address)."""
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", path))
    if "://" not in uri:
        uri = f"file://{uri}"
    fs, name = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(name)


def read_footer(path: str) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray] | None:
    """(part, width, document ids, which of them are known, counts) of a shard file; None for an empty one."""
    with open_shared(path) as f:
        size = f.size()
        for width in (2, 4):
            at = size - width - TRAILER.itemsize
            if at < 0:
                continue
            end = np.frombuffer(f.read_at(TRAILER.itemsize, at), TRAILER)[0]
            if end["magic"] == MAGIC and end["width"] == width:
                n = int(end["docs"])
                body = f.read_at(n * 17, at - n * 17)
                return (int(end["part"]), width, np.frombuffer(body, "<i8", n), np.frombuffer(body, "u1", n, n * 16).astype(bool),
                        np.frombuffer(body, "<i8", n, n * 8))
    return None


ENTRY = "path string, part int, width int, at long, doc_id long, local long, offset long, n_tokens long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard paths -> one row per document: its place, and its number among equal ids of the shard."""
    for b in batches:
        for path in b.column("path").to_pylist():
            footer = read_footer(path)
            if footer is None:
                continue
            part, width, ids, known, counts = footer
            n = len(ids)
            new = np.append(True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))
            local = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
            offset = np.cumsum(counts) - counts
            for s in range(0, n, 50_000):
                c = slice(s, s + 50_000)
                m = len(ids[c])
                yield pa.record_batch([pa.array([path] * m), pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, width, np.int32)),
                                       pa.array(np.arange(s, s + m)), pa.array(ids[c], mask=~known[c]), pa.array(local[c]),
                                       pa.array(offset[c]), pa.array(counts[c])], names=[x.split()[0] for x in ENTRY.split(", ")])


def lanes(ids: np.ndarray, known: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every key."""
    low = mix(ids.astype(np.uint64) + np.uint64(1) * known.astype(np.uint64) * C2)
    high = mix((copies.astype(np.uint64) * np.uint64(2) + known.astype(np.uint64)) * C1 + low)
    return mix(low ^ (high * C2)), high | np.uint64(1)


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + b * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct keys: ``slots`` maps each of n keys to its own number below n."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, "u1"), bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "PerfectHash":
        left, sizes, bits = np.arange(len(a)), [], []
        while len(left):
            if len(sizes) > 300:
                raise ValueError("two keys agree in 128 bits")
            size = -(-2 * len(left) // 64) * 64
            at = _places(a[left], b[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").tobytes())
            left = left[~alone[at]]
        return cls(sizes, b"".join(bits))

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's slot; a key that was not built in gets any slot, or -1."""
        out, open_, base = np.full(len(a), -1), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = _places(a[open_], b[open_], level, size) + base
            hit = self.bits[at] == 1
            out[open_[hit]] = self.before[at[hit]]
            open_, base = open_[~hit], base + size
        return out


def _prints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(a * C2 + b) >> np.uint64(32)).astype("<u4")


def _keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    known = t["doc_id"].is_valid().to_numpy()
    return lanes(t["doc_id"].fill_null(0).to_numpy(), known, t["copy"].to_numpy())


def _build_bucket(key: tuple, t: pa.Table) -> pa.Table:
    a, b = _keys(t)
    mph = PerfectHash.build(a, b)
    slot = np.argsort(mph.slots(a, b))
    cols = [t[c].to_numpy()[slot].astype(k).tobytes() for c, k in (("part", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8"))]
    row = [key[0].as_py(), len(a), mph.sizes, mph.packed(), _prints(a, b)[slot].tobytes(), *cols]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 5]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])


def _probe(keys: pa.Table, index: pa.Table) -> pa.Table:
    none = pa.table([keys["doc_id"][:0], keys["copy"][:0], pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())],
                    names=["doc_id", "copy", "part", "offset", "n_tokens"])
    if not keys.num_rows or not index.num_rows:
        return none
    row = index.to_pylist()[0]
    a, b = _keys(keys)
    slot = PerfectHash(row["sizes"], row["bits"]).slots(a, b)
    found = np.flatnonzero(slot >= 0)
    found = found[np.frombuffer(row["prints"], "<u4")[slot[found]] == _prints(a, b)[found]]
    at = slot[found]
    place = [pa.array(np.frombuffer(row[c], k)[at].astype(k[1:])) for c, k in (("shards", "<i4"), ("offsets", "<i8"), ("counts", "<i8"))]
    mine = keys.take(pa.array(found))
    return pa.table([mine["doc_id"], mine["copy"], *place], names=none.column_names)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places, sorted by shard -> the ids at them, read from the files, as 32-bit values."""
    path, f = None, None
    for b in batches:
        out, held, start = [], 0, 0
        rows = zip(b.column("path").to_pylist(), b.column("width").to_pylist(), b.column("offset").to_pylist(), b.column("n_tokens").to_pylist())

        def batch(to):
            part = b.slice(start, to - start)
            return pa.record_batch([part.column("doc_id"), part.column("copy"), part.column("start"), part.column("n_tokens"), pa.array(out, pa.binary())],
                                   names=["doc_id", "copy", "start", "n_tokens", "ids"])

        for i, (name, width, offset, n) in enumerate(rows):
            if name != path:
                if f is not None:
                    f.close()
                path, f = name, open_shared(name)
            raw = f.read_at(n * width, offset * width)
            out.append(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw)
            held += 4 * n
            if held > 4_000_000:
                yield batch(i + 1)
                out, held, start = [], 0, i + 1
        if out:
            yield batch(b.num_rows)
    if f is not None:
        f.close()


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n))


class TokenFiles:
    """A written data set."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = spark.read.parquet(f"{self.path}/manifest")

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: FileTokenizer, id_col: str = "doc_id", text_col: str = "text",
              shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET, shards: int | None = None) -> "TokenFiles":
        """Encode whole texts into shards, index them, and write the manifest last."""
        spark, path = docs.sparkSession, path.rstrip("/")
        small_batches(spark)
        rows = keyed(docs, id_col, text_col)
        if shards is None:
            text = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            shards = max(partitions(spark), text // shard_bytes + 1)
        order = (F.col("doc_id").asc_nulls_last(), F.col("fold"), F.col("tie"))
        ranges = (rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order)
                  .select("doc_id", "text", F.spark_partition_id().alias("part")))
        tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(tidy, "false")
        spark.conf.set(tidy, "true")
        try:
            (ranges.mapInArrow(_encode(tokenizer), "line binary").select(F.col("line").cast("string").alias("value"))
             .write.mode("overwrite").option("lineSep", "\0" * tokenizer.width).text(f"{path}/shards"))
        finally:
            spark.conf.set(tidy, before)
        cls._index(spark, path, bucket)
        return cls(spark, path)

    @staticmethod
    def _index(spark: SparkSession, path: str, bucket: int) -> None:
        files = spark.read.format("binaryFile").load(f"{path}/shards").where("length > 0").select("path")
        entries = staged(files.mapInArrow(_entries, ENTRY), "token-entries")
        edge = F.struct("doc_id", "local")
        shards = sorted(entries.groupBy("part", "path", "width").agg(
            F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min_by(edge, "at").alias("first"), F.max_by(edge, "at").alias("last")).collect())
        manifest, start, docs, previous, run = [], 0, 0, None, 0
        for s in shards:                                  # one row per shard: its first position, and copies of its first id before it
            carried = run if previous is not None and previous[0] == s["first"]["doc_id"] else 0
            manifest.append((s["part"], s["path"], s["width"], start, s["tokens"], s["docs"], s["first"]["doc_id"], carried))
            whole = s["last"]["local"] + 1 == s["docs"]
            run, previous = s["last"]["local"] + 1 + (carried if whole else 0), (s["last"]["doc_id"],)
            start, docs = start + s["tokens"], docs + s["docs"]
        table = spark.createDataFrame(manifest, "part int, path string, width int, start long, n_tokens long, n_docs long, first_id long, carried long")
        carry = table.select(F.col("part").alias("p"), "first_id", "carried")
        copies = entries.join(carry, F.col("part") == F.col("p")).select(
            "doc_id", (F.col("local") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("carried")).otherwise(0)).alias("copy"),
            "part", "offset", "n_tokens")
        (copies.withColumn("bucket", _bucket(docs // bucket + 1)).groupBy("bucket").applyInArrow(_build_bucket, INDEX)
         .withColumn("buckets", F.lit(docs // bucket + 1)).write.mode("overwrite").parquet(f"{path}/index"))
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy) keys -> doc_id, copy, start (ids before it in the whole set), n_tokens, ids (32-bit little-endian); absent keys have no row."""
        small_batches(self.spark)
        index = self.spark.read.parquet(f"{self.path}/index")
        n = index.agg(F.max("buckets")).first()[0] or 1
        asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy")).withColumn("bucket", _bucket(n))
        found = (asked.groupBy("bucket").cogroup(index.drop("buckets").groupBy("bucket"))
                 .applyInArrow(_probe, "doc_id long, copy long, part int, offset long, n_tokens long"))
        places = found.join(self.manifest.select("part", "path", "width", F.col("start").alias("first")), "part").select(
            "doc_id", "copy", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "part", "path", "width", "offset")
        return (places.repartition("part").sortWithinPartitions("part", "offset")
                .mapInArrow(_payloads, "doc_id long, copy long, start long, n_tokens long, ids binary"))


def document_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every row's key: its id and a number among the rows of that id."""
    return (docs.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
            .select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))
