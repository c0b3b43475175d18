import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from skillgrid.llm import tokenfiles as TF
from skillgrid.llm.queries import QUERIES, TOKENIZER_FILE

from .conftest import ODD, SF


TOKENIZER = Tokenizer.from_file(TOKENIZER_FILE)
TOKENIZER.encode_special_tokens = True


def encode(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def folder(spark):
    from skillgrid.session import scratch_path
    return scratch_path(spark, f"test-tokens-{uuid.uuid4().hex}")


def test_query(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op12_token_files"](spark, SF).collect()}
    start = 0
    for d, text in documents:
        ids = encode(text)
        r = rows.pop(d)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), digest(ids))
        start += len(ids)
    assert not rows


@pytest.mark.parametrize("shards", [1, 9])
def test_odd_rows(spark, odd_docs, shards):
    docs = odd_docs.union(odd_docs.where("doc_id IS NULL OR doc_id = 5"))
    path = folder(spark)
    files = TF.TokenFiles.write(docs, path, TF.FileTokenizer(TOKENIZER_FILE), shards=shards, bucket=4)
    rows = files.lookup(TF.document_keys(docs)).collect()
    texts = ODD + [(i, t) for i, t in ODD if i is None or i == 5]
    want = sorted((str(i), digest(encode(t))) for i, t in texts)
    assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in texts if i is not None]) + [None] * 4     # ascending, null last
    at, copies = 0, {}
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and r.copy == copies.get(r.doc_id, 0)
        at, copies[r.doc_id] = at + r.n_tokens, r.copy + 1
    raw = b"".join(open_raw(p, r) for r in sorted(files.manifest.collect()) for p in [r["path"]])
    assert raw == b"".join(np.frombuffer(r.ids, "<u4").astype("<u2").tobytes() for r in rows)           # the files start with nothing but ids


def open_raw(path, shard):
    with TF.open_shared(path) as f:
        return f.read_at(shard["n_tokens"] * shard["width"], 0)


def test_absent_keys_and_empty_sets(spark, odd_docs, no_docs):
    t = TF.FileTokenizer(TOKENIZER_FILE)
    files = TF.TokenFiles.write(odd_docs, folder(spark), t, shards=3, bucket=5)
    asked = spark.createDataFrame([(1, 0), (5, 1), (5, 2), (99, 0), (None, 1), (None, 2), (1, 1)] + [(i, 0) for i in range(1000, 3000)], "doc_id long, copy long")
    assert sorted((str(r.doc_id), r.copy) for r in files.lookup(asked).collect()) == [("1", 0), ("5", 1), ("None", 1)]
    files = TF.TokenFiles.write(no_docs, folder(spark), t)
    assert files.lookup(asked).collect() == [] and files.manifest.count() == 0


def test_one_id_over_many_shards(spark):
    rows = [(7, f"text {i % 40}") for i in range(300)] + [(8, "x"), (6, "y")] + [(None, "same")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = TF.TokenFiles.write(docs, folder(spark), TF.FileTokenizer(TOKENIZER_FILE), shards=12, bucket=16)
    got = files.lookup(TF.document_keys(docs)).collect()
    assert files.manifest.count() > 5
    assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in got) == sorted((str(i), digest(encode(t))) for i, t in rows)


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(10 ** 6, n, replace=False) - 500_000
    a, b = TF.lanes(ids, np.arange(n) % 5 != 0, np.arange(n) % 3)
    mph = TF.PerfectHash.build(a, b)
    assert sorted(mph.slots(a, b).tolist()) == list(range(n))
    again = TF.PerfectHash(mph.sizes, mph.packed())
    assert (again.slots(a, b) == mph.slots(a, b)).all()


@pytest.mark.parametrize("seed", range(20))
def test_pieces_keep_the_ids(seed):
    rng = random.Random(seed)
    alphabet = ["a", "Word", "é", " ", "  ", "\n", " ", "'s", "9", "42", "!", "<|endoftext|>", "中", "́", "_", "\t", " \n"]
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    parts = TF.pieces(text, 50)
    assert "".join(parts) == text and len(parts) > 5
    assert [i for p in parts for i in encode(p)[:-1]] == encode(text)[:-1]


@pytest.mark.parametrize("seed", range(40))
def test_words_keep_the_ids(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(TF, "WORDS", rng.choice([3, 1000]))
    words = ["a", "Word", "été", "don't", "'s", "9", "42nd", "!", "x.", "y,", "!,", "9.", ".", ",", "<|endoftext|>", "中文", "é\u0301", "_", "\u00a0", "a\tb", "\x1c", "I'll."]
    gaps = [" ", " ", " ", "\n"] + (["  ", "\n\n", " \n", "\t"] if seed % 4 == 0 else [])
    text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(400))
    text = text.strip() if seed % 4 else text
    for t in (text, text[:50], "", " ", "\n", "one", " lead", "trail "):
        assert np.frombuffer(TF.FileTokenizer(TOKENIZER_FILE).encode(t), "<u2").tolist() == encode(t)[:-1]


def test_long_texts_keep_the_ids():
    rng = random.Random(5)
    text = "".join(rng.choice(["some", "wörds.", "9", "a\nb", "x"]) + rng.choice([" ", "\n", "  " if rng.random() < 0.001 else " "]) for _ in range(250_000))
    assert len(TF.pieces(text)) > 3
    assert np.frombuffer(TF.FileTokenizer(TOKENIZER_FILE).encode(text), "<u2").tolist() == encode(text)[:-1]
