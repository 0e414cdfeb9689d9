"""Token-id output: shards of raw ids, each with a minimal perfect hash index from document keys to offsets.

A shard holds, in this order: magic, header (JSON), keys, offsets, the bit levels of the hash, per slot a 16-bit fingerprint
and the first record and count of its key, then the raw ids (16 bits each while the vocabulary fits, else 32).
``MinimalPerfectHash`` takes a key to its slot in expected constant time; a fingerprint that differs means that the
key isn't there. ``Shard.get`` gives the records of a key without reading any other.

Shards are written by Spark's text writer, one row and file for each (the row's bytes and one line feed), so that
any Hadoop file system serves. Documents are range-partitioned and sorted by doc_id, nulls first, ties by text.

Defined results: null text is empty and has the end id alone; a null doc_id sorts first and is reached by position only; rows that
repeat a doc_id are records of one key. A very long text is one record, encoded whole in one task, in a shard of its own if it fills one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.llm.bpe import LONG_PIECE, byte_table, load, tokenizer_path
from meshlark.llm.common import enter, held, holds, materialize, shared_path

MAGIC, END_ID, SHARD_IDS, CACHE_WORDS = b"MLTOKEN1", 1, 4_000_000, 400_000
SEPARATORS = re.compile("[\x1c-\x1f]")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
# Fixed value: the pre-token pattern of the word BPE vocabulary.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Levels of bits: a key's bit is set on the first level where no other key left has the same place; its slot is the bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of uint8 0/1
        counts = [int(x.sum()) for x in levels]
        self.before = [sum(counts[:k]) for k in range(len(counts))]
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> MinimalPerfectHash:
        left, levels = np.unique(keys), []
        while len(left):
            size = max(8, int(gamma * len(left)))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where no level has a bit for the key."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = (mix(keys[open_], k) % np.uint64(len(level))).astype(np.int64)
            hit = level[at] == 1
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 7919) >> np.uint64(48)).astype("<u2")


def write_shard(keys: list[int | None], ids: list[bytes], item: int, part: int, seq: int) -> bytes:
    """``ids``: the raw ids of each record, little-endian, ``item`` bytes each. Records come in ascending key order, nulls first."""
    nulls = sum(k is None for k in keys)
    k = np.array([x for x in keys if x is not None], dtype="<i8")
    lengths = np.array([len(x) // item for x in ids], dtype="<u8")
    offsets = np.concatenate([np.zeros(1, dtype="<u8"), np.cumsum(lengths, dtype="<u8")])
    distinct, first, count = np.unique(k, return_index=True, return_counts=True)
    mph = MinimalPerfectHash.build(k.view(np.uint64))
    slots = mph.slots(distinct.view(np.uint64))
    prints, firsts, counts = np.zeros(len(distinct), "<u2"), np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slots], firsts[slots], counts[slots] = fingerprints(distinct.view(np.uint64)), first + nulls, count
    head = json.dumps({"part": part, "seq": seq, "records": len(keys), "nulls": nulls, "distinct": len(distinct), "item": item, "levels": [len(x) for x in mph.levels]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, k.tobytes(), offsets.astype("<u8").tobytes(), *(np.packbits(x).tobytes() for x in mph.levels), prints.tobytes(), firsts.tobytes(), counts.tobytes(), *ids])


class Shard:
    def __init__(self, data: bytes):
        if not data.startswith(MAGIC):
            raise ValueError("not a token shard")
        n = int.from_bytes(data[8:12], "little")
        self.head = h = json.loads(data[12 : 12 + n])
        at = 12 + n

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, dtype=dtype, count=count, offset=at)
            at += x.nbytes
            return x

        self.keys = take("<i8", h["records"] - h["nulls"])
        self.offsets = take("<u8", h["records"] + 1)
        self.mph = MinimalPerfectHash([np.unpackbits(take("u1", -(-size // 8)))[:size] for size in h["levels"]])
        self.prints, self.firsts, self.counts = take("<u2", h["distinct"]), take("<u4", h["distinct"]), take("<u4", h["distinct"])
        self.data, self.at = data, at

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records where the fingerprint says it isn't here."""
        slots = self.mph.slots(keys.view(np.uint64))
        safe = np.maximum(slots, 0)
        there = (slots >= 0) & (self.prints[safe] == fingerprints(keys.view(np.uint64))) if len(self.prints) else np.zeros(len(keys), bool)
        return self.firsts[safe].astype(np.int64) if len(self.prints) else safe, np.where(there, self.counts[safe], 0) if len(self.prints) else np.zeros(len(keys), np.int64)

    def record(self, k: int) -> np.ndarray:
        a, b, item = int(self.offsets[k]), int(self.offsets[k + 1]), self.head["item"]
        return np.frombuffer(self.data, dtype="<u2" if item == 2 else "<u4", count=b - a, offset=self.at + a * item)

    def get(self, key: int) -> list[np.ndarray]:
        first, count = self.locate(np.array([key], dtype="<i8"))
        return [self.record(int(first[0]) + j) for j in range(int(count[0]))]


class WordEncoder:
    """Raw ids, or their number, of texts by a word BPE, whose pre-tokens never cross white space: words and pre-tokens are encoded once each and kept in bounded caches.

    Latin words (to U+024F, where composed and decomposed forms do not differ) are lower-cased and cut by the vocabulary's own pattern, others
    go to the library. So does a whole text with added tokens' marks or the four separators that only Python counts as white space.
    """

    def __init__(self, path: str):
        self.whole = load(path)
        n = self.whole.get_vocab_size()
        self.item = 2 if n <= 65536 else 4
        self.dtype = "<u2" if self.item == 2 else "<u4"
        raw = [i.to_bytes(self.item, "little") for i in range(n)]
        self.raw = lambda ids: b"".join(map(raw.__getitem__, ids))
        self.bytes = _Words(self.whole, self.raw, b"".join)
        self.counts = _Words(self.whole, len, sum)

    def _values(self, texts: list[str], words: _Words, more) -> list:
        get, join, whole = words.__getitem__, words.join, self.whole
        return [(words.value(whole.encode(t, add_special_tokens=False).ids) if "<|" in t or SEPARATORS.search(t) else join(map(get, t.split()))) + more for t in texts]

    def encode_batch(self, texts: list[str], end: int | None = END_ID) -> list[bytes]:
        self.bytes = self.bytes.aged()
        return self._values(texts, self.bytes, b"" if end is None else self.raw([end]))

    def count_batch(self, texts: list[str], end: int | None = END_ID) -> list[int]:
        """How many ids ``encode_batch`` has for each text."""
        self.counts = self.counts.aged()
        return self._values(texts, self.counts, 0 if end is None else 1)


class _Words(dict):
    """word -> value(ids); ``join`` makes one value of several. A full cache is kept as the old one, from which what is asked for again moves over."""

    def __init__(self, whole, value, join):
        self.whole, self.value, self.join, self.old = whole, value, join, {}
        self.tokenize = whole.model.tokenize
        self.stand = {b: c for c, b in byte_table().items()}

    def aged(self) -> _Words:
        """Itself, or a new one whose old one it is, once it is full."""
        if len(self) <= CACHE_WORDS:
            return self
        new = _Words(self.whole, self.value, self.join)
        new.old, self.old = self, {}
        return new

    def __missing__(self, w: str):
        if (x := self.old.get(w)) is None:
            if w.isascii() and w.isprintable():
                low = w.lower()
                x = self._piece(low, low) if low.isalpha() else self.join([self._piece(p, p) for p in PRETOKENS.findall(low)])  # a pre-token is a word, too
            elif BEYOND_LATIN.search(w):
                x = self.value(self.whole.encode(w, add_special_tokens=False).ids)
            else:
                x = self.join([self._piece(p, "".join([self.stand[b] for b in p.encode()])) for p in PRETOKENS.findall(w.lower())])
        if len(w) <= LONG_PIECE:
            self[w] = x
        return x

    def _piece(self, p: str, stand: str):
        """``stand``: the piece in the stand-ins of its bytes; visible ASCII stands for itself."""
        if (x := self.get(p)) is None:
            if (x := self.old.get(p)) is None:
                x = self.value([t.id for t in self.tokenize(stand)])
            if len(p) <= LONG_PIECE:
                self[p] = x
        return x


_ENCODERS: dict[str, WordEncoder] = {}
holds("words", _ENCODERS.clear)


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _shards(path: str, shard_ids: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("words")
        enc, part = word_encoder(path), TaskContext.get().partitionId()
        keys, ids, size, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_shard(keys, ids, enc.item, part, seq)], pa.binary())], ["shard"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                for key, raw in zip(piece.column(0).to_pylist(), enc.encode_batch([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    if ids and size + len(raw) // enc.item > shard_ids:
                        yield flush()
                        keys, ids, size, seq = [], [], 0, seq + 1
                    keys.append(key)
                    ids.append(raw)
                    size += len(raw) // enc.item
        if ids:
            yield flush()

    return shards


def write_tokens(documents: DataFrame, folder: str, path: str, shard_ids: int = SHARD_IDS) -> None:
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = documents.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    s = d.mapInArrow(_shards(path, shard_ids), "shard binary")
    with held(documents.sparkSession):
        s.select(F.col("shard").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            s = Shard(content.as_py()[:-1])
            nulls = s.head["nulls"]
            distinct = np.unique(s.keys)
            first, count = s.locate(distinct)  # every key goes through the index
            if int(count.sum()) != len(s.keys):
                raise ValueError("the index of a shard does not find all its keys")
            rows = [(None, k) for k in range(nulls)] + [(int(key), int(f) + j) for key, f, c in zip(distinct, first, count, strict=True) for j in range(int(c))]
            out = [(s.head["part"], s.head["seq"], key, int(s.offsets[k]), int(s.offsets[k + 1] - s.offsets[k]), zlib.crc32(s.record(k).astype("<u4").tobytes())) for key, k in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the shards through their indexes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("content")
    r = materialize(files.mapInArrow(_records, "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"), "tokens", True)
    shards = r.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    # Two levels: one row per range partition in a single window, then the shards within each partition.
    parts = shards.groupBy("part").agg(F.sum("n").alias("n_part"))
    parts = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before"))
    base = shards.select("part", "seq", (F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("within")).join(parts, "part")
    return r.join(base, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _index_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = Shard(content.as_py()[:-1])
            if len(s.keys):
                rows.append((path, int(s.keys[0]), int(s.keys[-1]), s.at))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 3), strict=True)], ["path", "low", "high", "index_bytes"])


class TokenIndex:
    """Keyed access to a folder of shards. A manifest (path, least and greatest key, bytes of the index) is made once and kept beside the folder; a key reads the index of the
    shards whose range it is in, which it keeps, and then the bytes of its own ids alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.shards = spark, {}
        path = f"{folder.rstrip('/')}-manifest"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
            files.mapInArrow(_index_sizes, "path string, low bigint, high bigint, index_bytes bigint").write.parquet(path)
        self.manifest = spark.read.schema("path string, low bigint, high bigint, index_bytes bigint").parquet(path)

    def _read(self, path: str, at: int, n: int) -> bytes:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(p)
        try:
            stream.seek(at)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def get(self, key: int) -> list[list[int]]:
        """The ids of each record of the key."""
        out = []
        for r in self.manifest.where((F.col("low") <= key) & (F.col("high") >= key)).orderBy("low", "path").collect():  # ranges meet at their ends only
            if r.path not in self.shards:
                self.shards[r.path] = Shard(self._read(r.path, 0, r.index_bytes))
            s = self.shards[r.path]
            first, count = s.locate(np.array([key], dtype="<i8"))
            for k in range(int(first[0]), int(first[0]) + int(count[0])):
                if int(s.keys[k - s.head["nulls"]]) != key:  # another key with the same fingerprint
                    break
                at, n = int(s.offsets[k]) * s.head["item"], int(s.offsets[k + 1] - s.offsets[k]) * s.head["item"]
                out.append(np.frombuffer(self._read(r.path, s.at + at, n), dtype="<u2" if s.head["item"] == 2 else "<u4").tolist())
        return out


def lookup(spark: SparkSession, folder: str, key: int) -> list[list[int]]:
    """The ids of each record of one key."""
    return TokenIndex(spark, folder).get(key)


def op3_tokens(spark: SparkSession, documents: DataFrame, path: str | None = None) -> DataFrame:
    write_tokens(documents, folder := shared_path(spark, "tokens"), path or tokenizer_path("word_bpe_49k.json"))
    return read_tokens(spark, folder)
