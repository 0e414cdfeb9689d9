"""Scoring texts by a hashed maximum-entropy language model, beside smoothed counts of single tokens.

The model's symbols are the most frequent training tokens, the end of a text, and one symbol for all other tokens. A symbol has a class (its place by frequency, in equal
classes) and a place in it: P(symbol | context) = P(class | context) P(symbol | class, context), both a softmax over the sum of a context-free weight and the hashed weights of three
features of the context: the symbol before (bigram), the one before that (skip), and both (trigram). A token outside the symbols has the rare symbol's probability times its
smoothed share of all rare tokens, so probabilities of all tokens sum to 1.

Training: the features look at two symbols, so counts of (context, symbol), aggregated over all training texts, hold all that the gradient needs (``context_counts``). A round sends
each task the weights; tasks return what their contexts have seen and what the model expected there, by weight, which Spark adds: their difference is the gradient. Three features change a
probability by at most exp(3 step), so the step by weight that balances the gradient with that bound and a Gaussian prior never lowers the likelihood less the prior. Weights are a table of fixed size (``Shape``). Contexts and the symbols after them grow with the texts up to the square and cube of the number of symbols.

Token counts are exact: tokens of more than a ``HOT_SHARE``-th of all tokens (fewer than that many) go to the tasks; all others, none of which is hot, are joined.

Defined results: a null or empty text has its end alone. A null doc_id counts as the empty string where texts are held out. Repeated rows are scored, and teach, each. Without training texts
all tokens are unknown, the base score is 0 and the model's weights are those of an even choice. A very long text is encoded in one task, its tokens are joined and summed in many.
Clashing and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import discard, held, materialize

TOKEN = re.compile(rb"[^\x20\x09-\x0d]+")  # of lower-cased UTF-8 bytes
FOLDS, HELD = 7, 2
HOT_SHARE, COUNTED_TOKENS, SLICE_ROWS, TASK_PAIRS = 1 << 20, 300_000, 256, 100_000
RARE, END = 0, 1
BLOCK = 256  # rows of weights that are summed as one
ENCODED = "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, base_log double, rare_log double, n_known bigint, n_rare bigint, ids binary, tail array<binary>"


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: ``classes`` x ``members`` symbols (the last one begins texts), rows of hashed weights, rounds, and the prior's strength."""

    classes: int = 32
    members: int = 32
    rows: int = 1 << 15
    rounds: int = 8
    prior: float = 4.0

    @property
    def symbols(self) -> int:
        return self.classes * self.members

    @property
    def begin(self) -> int:
        return self.symbols - 1

    @property
    def width(self) -> int:
        return max(self.classes, self.members)


# Tokens ---------------------------------------------------------------------------------------------------------------


def tokens(text: bytes | None) -> list[bytes]:
    return TOKEN.findall((text or b"").lower())  # bytes: only A-Z have another case


def prepared(documents: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    return documents.select("doc_id", out.alias("held_out"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("words"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (Counter(), Counter())

    def rows(train: bool) -> pa.RecordBatch:
        c = found[train]
        out = pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64()), pa.array([train] * len(c))], ["token", "n", "train"])
        c.clear()
        return out

    for b in batches:
        for held, text in zip(b.column(1), b.column(2), strict=True):
            train = not held.as_py()
            found[train].update(tokens(text.as_py()))
            if len(found[train]) > COUNTED_TOKENS:
                yield rows(train)
    yield from (rows(t) for t in (False, True) if found[t])


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c (in training texts), total."""
    x = docs.mapInArrow(_counted, "token binary, n bigint, train boolean")
    return x.groupBy("token").agg(F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("total"))


@dataclass(frozen=True)
class Lexicon:
    """The hot tokens: log10(c + 1), whether known, and symbol of each; the last entries are for tokens that are not hot. And sums over all training tokens."""

    tokens: tuple[bytes, ...]
    log: np.ndarray
    known: np.ndarray
    symbol: np.ndarray
    symbol_counts: np.ndarray
    train_tokens: int
    distinct: int
    ends: int
    rare_mass: int

    @property
    def base_total(self) -> float:
        return math.log10(self.train_tokens + self.distinct + 1)

    @property
    def rare_total(self) -> float:
        return math.log10(self.rare_mass)


def lexicon(counts: DataFrame, ends: int, shape: Shape) -> tuple[Lexicon, int]:
    """The lexicon and the greatest total of tokens that aren't in it."""
    s = counts.agg(F.sum("c").alias("c"), F.sum("total").alias("total"), F.count_if(F.col("c") > 0).alias("known")).first()
    c, total, known = s.c or 0, s.total or 0, s.known or 0
    most = total // HOT_SHARE
    hot = sorted(((r.c, bytes(r.token)) for r in counts.where(F.col("total") > most).select("token", "c").collect()), key=lambda r: (-r[0], r[1]))
    n = sum(1 for r in hot[: shape.symbols - 3] if r[0])  # the other three are the rare symbol, the end and the beginning
    named = np.zeros(len(hot) + 1, dtype=np.int64)
    named[:n] = np.arange(2, n + 2)
    size = np.array([*(r[0] for r in hot), 0], dtype=np.int64)
    own = int(size[:n].sum())
    by = np.zeros(shape.symbols)
    by[RARE], by[END], by[2 : n + 2] = c - own, ends, size[:n]
    lex = Lexicon(tuple(r[1] for r in hot), np.log10(size + 1.0), (size > 0).astype(np.int64), named, by, c + ends, known + (ends > 0), ends, (c - own) + (known - n) + 1)
    return lex, most


def _encoded(lex: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, task, n = lex.value, TaskContext.get().partitionId() << 33, 0
        place, outside = {t: k for k, t in enumerate(x.tokens)}, len(x.tokens)
        names = [c.split(" ")[0] for c in ENCODED.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                ids, tails, ends, tail_ends = [], [], [0], [0]
                for text in b.column(2):
                    w = tokens(text.as_py())
                    ids.append(k := np.fromiter(map(place.get, w, repeat(outside)), dtype=np.int64, count=len(w)))
                    tails += [w[i] for i in np.flatnonzero(k == outside)]
                    ends.append(ends[-1] + len(w))
                    tail_ends.append(len(tails))
                k, ends = np.concatenate([*ids, [outside]]), np.array(ends)
                sums = lambda v: np.concatenate([[0], np.cumsum(v)])[ends[1:]] - np.concatenate([[0], np.cumsum(v)])[ends[:-1]]  # noqa: E731, B023
                log, symbol = x.log[k], x.symbol[k]
                rare = symbol == RARE
                exact = [float(np.sum(log[a:z])) for a, z in zip(ends[:-1], ends[1:], strict=True)]
                rest = [float(np.sum(log[a:z][rare[a:z]])) for a, z in zip(ends[:-1], ends[1:], strict=True)]
                held = [np.append(symbol[a:z], END).astype("<u4" if len(x.symbol_counts) > 1 << 16 else "<u2").tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), pa.array(tails, pa.binary()))
                cols = [pa.array(np.arange(task + n, task + n + b.num_rows)), b.column(0), b.column(1), pa.array(np.diff(ends) + 1), pa.array(exact), pa.array(rest), pa.array(sums(x.known[k])), pa.array(sums(rare.astype(np.int64))), pa.array(held, pa.binary()), lists]
                n += b.num_rows
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


# The model ------------------------------------------------------------------------------------------------------------


def _rows(kind: int, context: np.ndarray, part: np.ndarray | int, rows: int) -> np.ndarray:
    """Rows of weights of a feature (kind, context) for the classes (part 0) or for the members of class ``part`` - 1: a multiplicative hash."""
    h = (context.astype(np.uint64) * np.uint64(4096) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ np.asarray(part, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(rows)).astype(np.int64)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _places(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``size`` in order, and each one's place among them, without a sort."""
    seen = np.zeros(size, dtype=bool)
    seen[x] = True
    values = np.flatnonzero(seen)
    at = np.empty(size, dtype=np.int32)
    at[values] = np.arange(len(values), dtype=np.int32)
    return values, at[x]


@dataclass(frozen=True)
class Weights:
    """Context-free logits of classes and of the members of each class, and rows of hashed weights."""

    classes: np.ndarray
    members: np.ndarray
    hashed: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, shape: Shape) -> Weights:
        """The logarithms of smoothed shares; the beginning is no symbol that follows."""
        c = (counts + 0.5).reshape(shape.classes, shape.members)
        c[-1, -1] = 1e-30
        return cls(np.log(c.sum(axis=1) / c.sum()).astype(np.float32), np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32), np.zeros((shape.rows, shape.width), dtype=np.float32))


def _features(context: np.ndarray, part: np.ndarray | int, shape: Shape) -> np.ndarray:
    """3 x n rows: bigram, skip and trigram features of contexts (the symbol two back times the number of symbols, plus the last one)."""
    n = shape.symbols
    return np.stack([_rows(k, c, part, shape.rows) for k, c in enumerate((context % n, context // n, context))])


def class_logs(context: np.ndarray, w: Weights, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    rows = _features(context, 0, shape)
    return _log_softmax(w.classes + w.hashed[rows, : shape.classes].sum(axis=0)), rows


def member_logs(context: np.ndarray, cls: np.ndarray, w: Weights, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    rows = _features(context, cls + 1, shape)
    return _log_softmax(w.members[cls] + w.hashed[rows, : shape.members].sum(axis=0)), rows


def contexts_of(ids: np.ndarray, first: np.ndarray, shape: Shape) -> np.ndarray:
    """The context of each symbol; ``first`` marks where texts begin."""
    begins = np.zeros(len(ids), dtype=bool)
    begins[first] = True
    last = np.concatenate([[shape.begin], ids[:-1]])
    last[begins] = shape.begin
    back = np.concatenate([[shape.begin, shape.begin], ids[:-2]])[: len(ids)]
    back[begins] = shape.begin
    second = first + 1
    back[second[second < len(ids)]] = shape.begin
    return back * shape.symbols + last


def log_probabilities(ids: np.ndarray, first: np.ndarray, w: Weights, shape: Shape) -> np.ndarray:
    """Natural logarithms of P(symbol | context) for texts one after another; equal contexts, and classes in them, are worked out once."""
    contexts, at = _places(contexts_of(ids, first, shape), shape.symbols**2) if shape.symbols <= 1 << 11 else np.unique(contexts_of(ids, first, shape), return_inverse=True)
    cls, member = ids // shape.members, ids % shape.members
    by_class, _ = class_logs(contexts, w, shape)
    pairs, pair_at = _places(at.astype(np.int64) * shape.classes + cls, len(contexts) * shape.classes)
    by_member, _ = member_logs(contexts[pairs // shape.classes], pairs % shape.classes, w, shape)
    return by_class[at, cls].astype(np.float64) + by_member[pair_at, member]


def _flat(b: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts one after another, where each begins, and how many each has (at least its end)."""
    held = [np.frombuffer(x.as_buffer(), dtype="<u4" if shape.symbols > 1 << 16 else "<u2") for x in b]
    size = np.array([len(x) for x in held], dtype=np.int64)
    return np.concatenate(held).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]), size


def _context_counts(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shape.symbols
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS * 4):
                ids, first, _ = _flat(whole.column(0).slice(at, SLICE_ROWS * 4), shape)
                found, k = np.unique(contexts_of(ids, first, shape) * n + ids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found // n), pa.array((found % n).astype(np.int32)), pa.array(k)], ["context", "symbol", "n"])

    return run


def context_counts(encoded: DataFrame, shape: Shape) -> DataFrame:
    """context, symbols, counts: what follows each context in the training texts; at most as many entries a row as there are symbols."""
    x = encoded.where("not held_out").select("ids").mapInArrow(_context_counts(shape), "context bigint, symbol int, n bigint")
    x = x.groupBy("context", "symbol").agg(F.sum("n").alias("n")).groupBy("context").agg(F.sort_array(F.collect_list(F.struct("symbol", "n"))).alias("f"))
    return x.select("context", F.col("f.symbol").alias("symbols"), F.col("f.n").alias("counts"))


def _spread(rows: np.ndarray, g: np.ndarray, into: np.ndarray, touched: np.ndarray) -> None:
    """Add the rows of ``g`` (once for each of the three features) to the rows of ``into`` that ``rows`` names."""
    for r in rows:
        order = np.argsort(r, kind="stable")
        r = r[order]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        into[r[starts], : g.shape[1]] += np.add.reduceat(g[order], starts, axis=0)
        touched[r[starts]] = True


def gradient(context: np.ndarray, owner: np.ndarray, symbol: np.ndarray, n: np.ndarray, w: Weights, shape: Shape, found: np.ndarray, wanted: np.ndarray, touched: np.ndarray) -> float:
    """Adds how often each weight's feature and class (or member) were found together, and how often the model expects it; returns the log likelihood (natural)."""
    total = 0.0
    cls, member, n = symbol // shape.members, symbol % shape.members, n.astype(np.float64)
    pairs, pair_at = np.unique(owner * shape.classes + cls, return_inverse=True)
    for where, width, logs, cell in (
        (owner, shape.classes, lambda: class_logs(context, w, shape), cls),
        (pair_at, shape.members, lambda: member_logs(context[pairs // shape.classes], pairs % shape.classes, w, shape), member),
    ):
        log, rows = logs()
        seen = np.bincount(where * width + cell, weights=n, minlength=log.size).reshape(log.shape)
        total += float((seen * log).sum())
        p, size = np.exp(log), seen.sum(axis=1, keepdims=True)
        _spread(rows, seen, found, touched)
        _spread(rows, size * p, wanted, touched)
    return total


def _gradients(shape: Shape, weights: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = weights.value, 0.0
        found, wanted = np.zeros((2, shape.rows, shape.width))
        touched = np.zeros(shape.rows, dtype=bool)
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())])
            symbol, n = (b.column(c).flatten().to_numpy().astype(np.int64) for c in (1, 2))
            total += gradient(b.column(0).to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(ends)), symbol, n, w, shape, found, wanted, touched)
        rows = np.flatnonzero(touched)
        for k in np.unique(rows // BLOCK):
            r = rows[rows // BLOCK == k]
            cols = ([int(k)], [r.astype("<i4").tobytes()], [np.stack([found[r], wanted[r]]).astype(np.float32).tobytes()], [0.0])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.float64()), strict=True)], ["block", "rows", "sums", "log"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""]), pa.array([b""]), pa.array([total])], ["block", "rows", "sums", "log"])

    return run


def _added(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a block's rows, one batch after another."""
        sums, log, block = np.zeros((2, BLOCK, shape.width)), 0.0, -1
        for b in batches:
            for k in range(b.num_rows):
                block = b.column(0)[k].as_py()
                log += b.column(3)[k].as_py()
                if block >= 0:
                    r = np.frombuffer(b.column(1)[k].as_py(), dtype="<i4") - block * BLOCK
                    sums[:, r] += np.frombuffer(b.column(2)[k].as_py(), dtype=np.float32).reshape(2, len(r), shape.width)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums.tobytes()]), pa.array([log])], ["block", "sums", "log"])

    return run


def step(found: np.ndarray, wanted: np.ndarray, weight: np.ndarray, prior: float) -> np.ndarray:
    """x with found - wanted exp(3 x) - prior (weight + x) = 0: Newton's method from above the root, where it only falls."""
    wanted = np.maximum(wanted, 1e-6)
    top = np.log(np.maximum((found + prior * np.maximum(-weight, 0)) / wanted, 1e-12)) / 3
    x = np.minimum(np.maximum(top, 0), found / prior - weight)
    for _ in range(20):
        e = wanted * np.exp(np.minimum(3 * x, 60))
        x = x + (found - e - prior * (weight + x)) / (3 * e + prior)
    return x


def train(contexts: DataFrame, counts: np.ndarray, shape: Shape) -> tuple[Weights, list[float]]:
    """Weights, and the log likelihood of the training symbols before each round. A round's sums have the size of the weights, whatever the number of texts."""
    spark, w, trace = contexts.sparkSession, Weights.of_counts(counts, shape), []
    added = _added(shape)
    for _ in range(shape.rounds):
        sent = spark.sparkContext.broadcast(w)
        sums = contexts.mapInArrow(_gradients(shape, sent), "block int, rows binary, sums binary, log double").groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(list(added(iter(t.to_batches())))), "block int, sums binary, log double")
        hashed, log = w.hashed.copy(), 0.0
        with held(spark):
            rows = sums.collect()  # as large as the weights
        for r in rows:
            log += r.log
            if r.block >= 0:
                found, wanted = np.frombuffer(r.sums).reshape(2, BLOCK, shape.width)[:, : shape.rows - r.block * BLOCK]
                own = hashed[r.block * BLOCK : (r.block + 1) * BLOCK]
                own += step(found, wanted, own.astype(np.float64), shape.prior)
        trace.append(log)
        w = Weights(w.classes, w.members, hashed)
        sent.destroy()
    return w, trace


def _scored(shape: Shape, weights: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS * 4):
                b = whole.slice(at, SLICE_ROWS * 4)
                ids, first, _ = _flat(b.column(1), shape)
                logs = np.add.reduceat(log_probabilities(ids, first, w, shape), first) / math.log(10)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logs)], ["key", "model_log"])

    return run


def score(documents: DataFrame, shape: Shape | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of each text under the counts and under the model."""
    shape, spark = shape or Shape(), documents.sparkSession
    docs = prepared(documents)
    counts = materialize(token_counts(docs), "token-counts", True)
    lex, most = lexicon(counts, docs.where("not held_out").count(), shape)
    sent = spark.sparkContext.broadcast(lex)
    encoded = materialize(docs.mapInArrow(_encoded(sent), ENCODED), "encoded", True)
    tail = counts.where(F.col("total") <= most).select("token", F.log10(F.col("c") + 1.0).alias("log"), (F.col("c") > 0).cast("bigint").alias("known"))
    rest = encoded.select("key", F.explode("tail").alias("token")).join(tail, "token").groupBy("key").agg(F.sum("log").alias("tail_log"), F.sum("known").alias("tail_known"))
    contexts = context_counts(encoded, shape)
    contexts = materialize(contexts, "contexts", True)
    pairs = contexts.agg(F.coalesce(F.sum(F.size("symbols")), F.lit(0))).first()[0]
    weights, _ = train(contexts.coalesce(-(-pairs // TASK_PAIRS) or 1), lex.symbol_counts, shape)
    model = spark.sparkContext.broadcast(weights)
    logs = encoded.select("key", "ids").mapInArrow(_scored(shape, model), "key bigint, model_log double")
    x = encoded.drop("ids", "tail").join(logs, "key").join(rest, "key", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    out = x.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(lex.ends > 0))).alias("n_known"),
        F.lit(lex.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + tail_log + F.lit(math.log10(lex.ends + 1.0)) - F.col("n_tokens") * F.lit(lex.base_total)).alias("base_score"),
        (F.col("model_log") + F.col("rare_log") + tail_log - F.col("n_rare") * F.lit(lex.rare_total)).alias("score"),
    )
    out = materialize(out, "scores", True)
    discard(encoded, counts, contexts)
    return out


def op13_lm(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return score(documents)
