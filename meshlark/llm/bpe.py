"""Byte-level BPE encoding and decoding by tree concatenation.

``TreeEncoder`` gives the ids of the tokenizers library for a byte-level BPE. A text is cut into halves, wherever they fall, until the leaves have ``LEAF_CHARS`` characters at
most; the leaves of many texts are encoded in one batch, and joined from the leaves up: at each join a window of pieces is encoded anew and grown until its
first piece is the left side's and its last piece the right side's. Pieces begin at runs of white space, where the library's pre-tokenizer always cuts; they are
encoded once each and kept in a bounded cache. A piece of over ``leaf`` bytes goes the same way one level lower: its pre-tokens are split into halves of bytes
again and again, and at each join a window of tokens is re-encoded and grown until its first token equals the left side's and its last token the right
side's. BPE is fixed by adjacent pairs of tokens: when both ends agree all adjacent pairs are ones that an encoding holds, so the joined ids are exactly the ids of the whole.

The cutting rule is proven only for blank, tab, line feed and carriage return. Texts with other white space, or with added tokens' marks, are
cut at the added tokens and then by the library's own pre-tokenizer, and their long pre-tokens are encoded by halves too; those without a
run that could be longer than ``leaf`` bytes go to the library whole, which is what their leaves would do.

Defined results: null text is empty; an empty text has no ids; very long texts are only more leaves; repeated rows are encoded each and give equal rows; a null doc_id stays null. An empty table
gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import enter, holds

OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]|<\|")
PIECES = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
CACHE_ENTRIES, LEAF_BYTES, LEAF_CHARS, LONG_PIECE = 700_000, 64, 2048, 200


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF_BYTES):
        from tokenizers import pre_tokenizers

        self.whole, self.leaf = load(path), leaf
        self.raw = load(path)  # one pre-token per call: no pattern
        self.raw.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.raw.encode_special_tokens = True
        of, n = byte_table(), self.whole.get_vocab_size()
        special = {int(i): t.content for i, t in self.whole.get_added_tokens_decoder().items()}
        self.stand = {b: c for c, b in of.items()}
        self.bytes = [special[i].encode() if i in special else bytes(of[c] for c in self.whole.id_to_token(i)) for i in range(n)]
        self.decimal, self.sizes = [str(i) for i in range(n)], np.array([len(b) for b in self.bytes])
        added = self.whole.get_added_tokens_decoder().values()
        self.added = {t.content: self.whole.token_to_id(t.content) for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else re.compile("((?!))")
        self.plain = self.whole.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.run = re.compile(rf"\S{{{leaf // 4 + 1},}}|\s{{{leaf // 4 + 1},}}")  # characters have 4 bytes at most
        self.cache: dict[str, str] = {}  # piece -> its decimal ids, joined by commas
        self.odd: set[str] = set()  # pieces that their ids do not give back
        self.joins = self.token_joins = 0

    def _raw(self, parts: list[bytes]) -> list[list[int]]:
        """Encodes byte strings as one pre-token each; they may break characters."""
        return [self._bytes_ids(p) for p in parts] if any(not _is_text(p) for p in parts) else [e.ids for e in self.raw.encode_batch([p.decode() for p in parts], add_special_tokens=False)]

    def _bytes_ids(self, part: bytes) -> list[int]:
        return [] if not part else [t.id for t in self.whole.model.tokenize("".join(self.stand[b] for b in part))]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        self.token_joins += 1
        w = 2
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            mid = self._bytes_ids(b"".join([self.bytes[i] for i in left[-a:] + right[:b]]))
            agree_left = a == len(left) or mid[0] == left[-a]
            agree_right = b == len(right) or mid[-1] == right[b - 1]
            if agree_left and agree_right:
                return left[:-a] + mid + right[b:]
            w *= 2

    def long_pretoken(self, data: bytes) -> list[int]:
        """Halves again and again, leaves in one batch, then joins from the leaves up."""
        cuts = [0, len(data)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]) if b - a > self.leaf)})
        cuts = sorted({_boundary(data, c) for c in cuts})
        level = self._raw([data[a:b] for a, b in zip(cuts, cuts[1:])])
        while len(level) > 1:
            level = [self._join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def long_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for token, _ in self.whole.pre_tokenizer.pre_tokenize_str(piece):
            ids += self.long_pretoken(bytes(_FROM_STAND[c] for c in token)) if len(token) > self.leaf else [t.id for t in self.whole.model.tokenize(token)]
        return ids

    def rare(self, text: str) -> list[int]:
        """A text that PIECES may not cut."""
        if not self.plain or not self.run.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for part in self.cut.split(text):
            if part:
                ids += [self.added[part]] if part in self.added else self.long_piece(part)
        return ids

    def _batch(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece. Those that begin with white space and end with none are strung together, as the library cuts there; token lengths tell them apart."""
        space = " \t\n\r"
        plain = [p[0] in space and p[-1] not in space for p in pieces]
        own = iter([e.ids for e in self.whole.encode_batch_fast([p for p, x in zip(pieces, plain, strict=True) if not x], add_special_tokens=False)])
        strung = [p for p, x in zip(pieces, plain, strict=True) if x]
        found: list[list[int]] = []
        for at in range(0, len(strung), 1000):
            part = strung[at : at + 1000]
            ids = self.whole.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids
            ends, want = np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in part])
            cut = np.searchsorted(ends, want)
            if not np.array_equal(ends[cut], want):
                raise RuntimeError("a token crosses two pieces")
            cut = (cut + 1).tolist()
            found += [ids[i:j] for i, j in zip([0, *cut], cut, strict=False)]
        strung_ids = iter(found)
        return [next(strung_ids) if x else next(own) for x in plain]

    def _learn(self, pieces: set[str]) -> dict[str, str]:
        """Encodes pieces into the cache; those that are too large for it are returned."""
        new = [p for p in pieces if p not in self.cache]
        short = [p for p in new if 4 * len(p) <= self.leaf or len(p.encode()) <= self.leaf]
        ids = self._batch(short)
        if len(short) < len(new):
            long = [*(set(new) - set(short))]
            short += long
            ids += [self.long_piece(p) for p in long]
        decimal, byte = self.decimal.__getitem__, self.bytes.__getitem__
        text = [",".join(map(decimal, x)) for x in ids]
        self.odd.update(p for p, x in zip(short, ids, strict=True) if b"".join(map(byte, x)) != p.encode())
        large = {p: x for p, x in zip(short, text, strict=True) if len(p) > LONG_PIECE}
        self.cache.update(zip(short, text, strict=True))
        for p in large:
            del self.cache[p]
        return large

    def _meet(self, left: list[str], right: list[str]) -> list[str]:
        """The pieces of two texts' concatenation; the window's pieces replace those at the join."""
        w = 1
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            mid = PIECES.findall("".join(left[-a:] + right[:b]))
            if (a == len(left) or mid[0] == left[-a] and len(mid) > 1) and (b == len(right) or mid[-1] == right[b - 1] and len(mid) > 1):
                self.joins += 1
                self.fresh.update(mid)
                return left[:-a] + mid + right[b:]
            w *= 2

    def tree(self, leaves: list[list[str]]) -> list[str]:
        """The pieces of a text from those of its leaves."""
        while len(leaves) > 1:
            leaves = [self._meet(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def encode_texts(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its decimal ids, joined by commas, and the bytes that they decode to."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.odd = {}, set()
        split = [None if OTHER_SPACE.search(t) else [PIECES.findall(leaf) for leaf in halves(t)] for t in texts]
        large = self._learn({p for leaves in split if leaves for leaf in leaves for p in leaf})
        self.fresh: set[str] = set()
        pieces = [leaves and self.tree(leaves) for leaves in split]
        large |= self._learn(self.fresh)
        get, out = (lambda p: self.cache[p] if p in self.cache else large[p]) if large else self.cache.__getitem__, []
        for t, own in zip(texts, pieces, strict=True):
            if own is None:
                ids = self.rare(t)
                out.append((",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])))
            else:
                ids = ",".join(map(get, own))
                same = not self.odd or self.odd.isdisjoint(own)
                out.append((ids, t.encode() if same else b"".join([self.bytes[int(i)] for i in ids.split(",")])))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_texts([text])[0][0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


_FROM_STAND = byte_table()


def halves(text: str, most: int = LEAF_CHARS) -> list[str]:
    """The leaves of a text: halves of halves, in order."""
    n = 1
    while n * most < len(text):
        n *= 2
    return [text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n)] if text else []


def _is_text(p: bytes) -> bool:
    try:
        p.decode()
    except UnicodeDecodeError:
        return False
    return True


def _boundary(data: bytes, at: int) -> int:
    """The next start of a character."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


_ENCODERS: dict[str, TreeEncoder] = {}
holds("bpe", _ENCODERS.clear)


def encoder(path: str) -> TreeEncoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TreeEncoder(path)
    return _ENCODERS[path]


def _digests(path: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, ids, decoded = [], [], []
                for x, back in enc.encode_texts([t or "" for t in part.column(1).to_pylist()]):
                    n.append(x.count(",") + 1 if x else 0)
                    ids.append(hashlib.sha256(x.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _encode_column(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [[int(i) for i in x.split(",")] if x else [] for x, _ in enc.encode_texts([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encode


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>."""
    return documents.select("doc_id", "text").mapInArrow(_encode_column(path), "doc_id bigint, ids array<int>")


def op10_bpe(spark: SparkSession, documents: DataFrame, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path("byte_bpe_50k.json")
    return documents.select("doc_id", "text").mapInArrow(_digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
