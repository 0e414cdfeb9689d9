import hashlib
import zlib

import numpy as np
import pytest

from meshlark.llm import bpe, token_store
from meshlark.llm.common import shared_path

SCHEMA = "doc_id bigint, text string, start string, n_tokens string"
TEXTS = [
    None, "", " ", "\n\n", "a", "Hello, world's  end \n\n\tx ", "naïve café ÉÀ ß ﬁ", "x\x1cy z\x0bq", "a  b   c", "tail  ",
    "<|endoftext|> a <|startoftext|>b  <|endoftext|>", "word" * 700, "aB9_" * 300 + " " + "é" * 900 + "日本語" * 200, "=" * 3000, "á ́b é", "emoji 👩‍👩‍👧 " * 50,
    "1234567890" * 90, "don't they'll I've", "x" * 65 + "y" * 66, "\r\n a\r\n", "the same", "the same",
]


def library(name):
    return bpe.load(bpe.tokenizer_path(name))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(TEXTS)], SCHEMA)


def test_tree_encoder_equals_the_library():
    enc, lib = bpe.TreeEncoder(bpe.tokenizer_path("byte_bpe_50k.json"), leaf=8), library("byte_bpe_50k.json")
    rng = np.random.default_rng(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list("abcdeté日_-='1 \n"), size=n)) for n in rng.integers(1, 900, size=150)] + ["".join(rng.choice(list("thean"), size=2000)) for _ in range(20)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids, t[:50]
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_texts_are_joined_from_their_halves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 5)
    monkeypatch.setattr(bpe.halves, "__defaults__", (5,))
    enc, lib = bpe.TreeEncoder(bpe.tokenizer_path("byte_bpe_50k.json"), leaf=8), library("byte_bpe_50k.json")
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(["a", "th", "e", " ", "  ", "\n", "\t", "'s", "1", "\u00e9", ", "], size=n)) for n in rng.integers(1, 400, size=200)]
    for t, (ids, back) in zip(texts, enc.encode_texts(texts), strict=True):
        assert ids == ",".join(map(str, lib.encode(t, add_special_tokens=False).ids)), t
        assert back.decode() == t
    assert enc.joins > 2000 and enc.token_joins > 100


def test_the_tables_texts_take_the_tree():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    enc, lib = bpe.TreeEncoder(bpe.tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    got = enc.encode_texts(texts)
    assert [x for x, _ in got] == [",".join(map(str, e.ids)) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert enc.joins == sum(len(bpe.halves(t)) - 1 for t in texts if not bpe.OTHER_SPACE.search(t) and len(t) > bpe.LEAF_CHARS) > 50


def test_op10_against_the_library(spark, docs):
    lib = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.op10_bpe(spark, docs.limit(0)).count() == 0


def test_op3_against_the_library(spark, docs):
    lib, rows = library("word_bpe_49k.json"), [(None, "no key"), *((i, t) for i, t in enumerate(TEXTS)), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in reversed(rows)], SCHEMA)
    got = sorted(token_store.op3_tokens(spark, df).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.op3_tokens(spark, df.limit(0)).count() == 0


def test_counts_and_ids_whatever_the_cache(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_WORDS", 40)
    enc, lib = token_store.WordEncoder(bpe.tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    rng = np.random.default_rng(8)
    texts = [t or "" for t in TEXTS] + [" ".join(rng.choice(["the", "The", "cat's", "a,b", "x1y2", "''s", "don't!", "\u00c9t\u00e9", "\u65e5\u672c", "co-op", "###", "w" * 300, "a\x01b", "\x7f"], size=n)) for n in rng.integers(1, 60, size=80)]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        want = [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in part]
        assert enc.encode_batch(part) == [np.array(w, enc.dtype).tobytes() for w in want]
        assert enc.count_batch(part) == [len(w) for w in want]


def test_small_shards_and_lookup(spark, docs):
    token_store.write_tokens(docs, path := shared_path(spark, "t"), bpe.tokenizer_path("word_bpe_49k.json"), shard_ids=50)
    lib = library("word_bpe_49k.json")
    index = token_store.TokenIndex(spark, path)
    assert index.manifest.count() > 3
    for k, t in enumerate(TEXTS):
        assert index.get(k) == [[*lib.encode(t or "", add_special_tokens=False).ids, 1]]
    assert index.get(999) == index.get(-5) == [] and token_store.lookup(spark, path, 5) == index.get(5)
    assert token_store.read_tokens(spark, path).count() == len(TEXTS)


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, size=20000).astype(np.uint64)
    keys = np.unique(keys)
    assert sorted(token_store.MinimalPerfectHash.build(keys).slots(keys)) == list(range(len(keys)))


def test_rare_spaces_and_pieces_over_a_leaf_take_the_tree(monkeypatch):
    enc, lib = bpe.TreeEncoder(bpe.tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    seen = []
    monkeypatch.setattr(enc, "long_pretoken", lambda data, f=enc.long_pretoken: seen.append(len(data)) or f(data))
    run = "thean" * 400
    for t in (f"a\u00a0b {run}\u200b x", f"<|endoftext|> {run}<|startoftext|>b\u00a0{run} <|endoftext|>", f"<|none {run}|>", "x" * 100 + " y", "\u00a0" * 300 + " z", "\u65e5\u672c" * 90 + "\u3000a"):
        seen.clear()
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids, t[:30]
        assert seen and max(seen) > 64, t[:30]
    rng = np.random.default_rng(9)
    for n in rng.integers(1, 600, size=200):
        t = "".join(rng.choice(["a", "th", "e", " ", "\u00a0", "\u200b", "\n", "<|", "<|endoftext|>", "\u3000", "\x0b", "1", "'s"], size=n, p=[0.2, 0.2, 0.2, 0.05, 0.05, 0.04, 0.04, 0.02, 0.02, 0.03, 0.05, 0.05, 0.05]))
        assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids, t
