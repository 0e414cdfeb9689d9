"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document is the set of its distinct word n-grams (as 64-bit hashes); equal sets are one content from the start. Two sets of sizes a and b with
Jaccard similarity at least num/den differ in at most k = (a + b)(den - num)/(den + num) features. Sizes are cut into bands; a set is put into its own band's
instance and, if it can pair with the next band's sizes, into that one too. An instance parts the feature domain into n1 first-level
parts, each into n2 = 2 second-level parts, and signs the set's content of every choice of n2 - 1 of them. Each difference spoils one signature on either side
at most, so linked sets share 2 n1 - k of them: ``need``, and ``weak`` ones that may be empty. Sets with more than ``weak`` empty choices sign those too,
so linked sets share ``need`` signatures of features in any case. One shared signature would do; asking for ``need`` tells linked sets from
strangers that meet by chance, and costs ``need`` signatures, not a multiple of all.

Signatures meet in hash buckets (numpy, one shuffle of packed 56-bit words). Groups of up to ``MEET_GROUP`` contents count for each of
their pairs; each member of a larger group counts for itself, and is tied to the group's smallest member, or to the signature itself where very many have it. Pairs whose counts, with the lesser of its members'
counts in large groups, reach ``need`` are candidates. So are the ties of members whose counts in large groups reach it, but for the weakest ones of each, which make up less than
half of ``need``: what two linked sets share is more than both can leave out. Components of candidates are clusters, and those of bounded size are joined exactly by one matrix product each.

Passages that many documents share can chain strangers into a large cluster, so its sets are first parted anew: linked sets share one of the first features of both, the
rarest in the cluster coming first (prefix filter), and components by such features are clusters again. One that is still large is taken relative to a
reference set p (features of most of a few of its sets; any p gives right results): the residual of x is R = x xor p, and
with w = (den + num)|R| - (den - num)|x| two sets are linked exactly if w(x) + w(y) <= 2 (den + num) |R(x) & R(y)|. So whatever is linked without a shared residual feature
is linked with the set of the least w, the centre, and sets that are linked with the centre need not be paired with each other. What remains has an end
far from the centre and shares a residual feature among the first of both sides: smaller groups by such a
feature are pairs to check, others clusters of about half the size at most. No group is expanded into all its pairs.

Defined results: words and text as in ``shingles``; an empty set is linked with nothing, not even another empty set. A doc_id that
repeats is one document with several texts: it is linked by any of them, and each row has its own n_shingles. A null doc_id
is linked with nothing and has a null component_id. Very long texts are sets like others. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.llm.common import discard, enter, holds, join_counted, materialize, trim
from meshlark.operators.components import components

MEET_GROUP, HOT_GROUP, CACHE_WORDS, BATCH_DOCS, BATCH_CHARS = 6, 64, 200_000, 2048, 6 << 20
CLUSTER_SETS, CLUSTER_FEATURES, PAIR_GROUP, SALT_SETS, REFERENCE_SETS = 2048, 1_500_000, 16, 1024, 64
M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
SIG, INST, OWN = np.uint64((1 << 38) - 1), np.uint64(12), np.uint64(2047)  # a word: 38 bits of signature, 6 of instance, 1 if many share it, 11 of its owner in the batch


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()
holds("ngrams", _WORDS.clear)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the text with A-Z lower-cased; the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and white space is 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = _mix((out * M3) ^ h[j : len(h) - width + 1 + j])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def content_key(s: np.ndarray) -> int:
    """Names a set of features, as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


class PartEnum:
    """Signatures for Jaccard similarity num/den."""

    def __init__(self, num: int, den: int, growth: float = 1.25):
        self.num, self.den = num, den
        self.growth = max(growth, den / num)
        self.bands: list[tuple[int, int]] = []

    def band(self, size: int) -> int:
        while not self.bands or self.bands[-1][1] < size + size:  # one more is looked at
            low = self.bands[-1][1] + 1 if self.bands else 1
            self.bands.append((low, max(low, int(low * self.growth))))
        lo, hi = 0, len(self.bands) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.bands[mid][1] >= size else (mid + 1, hi)
        return lo

    def instances(self, size: int) -> list[int]:
        i = self.band(size)
        return [i, i + 1] if self.den * size >= self.num * self.bands[i + 1][0] else [i]

    def plan(self, i: int) -> tuple[int, int, int]:
        """Second-level parts in all (0: no difference is allowed), how many of them may be empty in a set that leaves empty choices out, and the signatures that linked sets share at least."""
        k = 2 * self.bands[i][1] * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 0, 0, 1
        need, weak = 2 + k // 6, 0 if k < 6 else 3 + k // 12
        n1 = -(-(k + need + weak) // 2)
        return 2 * n1, weak, 2 * n1 - k - weak

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, place of its set, instance) of many sets at once."""
        by: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            for i in self.instances(len(s)):
                by.setdefault(i, []).append(k)
        out, owner, inst = [], [], []
        for i, at in sorted(by.items()):
            parts, weak, _ = self.plan(i)
            sizes = np.array([len(sets[k]) for k in at])
            h = _mix(np.concatenate([sets[k] for k in at]) + np.uint64((i + 1) * int(M3) % 2**64))
            own = np.repeat(np.arange(len(at)), sizes)
            width = max(parts, 1)  # 0: the set itself
            where = own * width + (h % np.uint64(width)).astype(np.int64)
            sums = np.zeros(len(at) * width, dtype=np.uint64)
            np.add.at(sums, where, _mix(h ^ M2))
            held = (np.bincount(where, minlength=len(sums)) > 0).reshape(len(at), width)
            held[(~held).sum(axis=1) > weak] = True
            place = np.arange(width, dtype=np.uint64) + np.uint64((i + 1) << 32)
            sigs = _mix(sums.reshape(len(at), width) + place[None, :])
            out.append(sigs[held])
            owner.append(np.repeat(np.array(at), held.sum(axis=1)))
            inst.append(np.full(len(out[-1]), i, dtype=np.uint64))
        return np.concatenate(out), np.concatenate(owner), np.concatenate(inst)


ints = lambda v: np.frombuffer(v, dtype="<i8")
_bytes = lambda x: np.array(x, dtype="<i8").tobytes()


def _node(bucket: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """A signature that very many share, as a vertex of the graph of candidates."""
    return _mix((bucket.astype(np.uint64) << np.uint64(38)) | sig).view(np.int64)


def _signed(n: int, num: int, den: int, buckets: int):
    """Per batch: rows of documents (bucket -1: doc_id, content, hash of the text, size, null or not), ties of contents to a signature that over HOT_GROUP of the batch have (-2), and for each
    bucket the packed signatures of the contents; such a signature is sent once, marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngrams")
        enum = PartEnum(num, den)

        def emit(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            rows, sets, seen = [], [], {}
            for doc_id, text in zip(ids, texts, strict=True):
                s = shingles(text, n)
                key = content_key(s) if len(s) else 0
                th = int(np.int64(np.uint64(xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), seed=42))))
                rows.append((0 if doc_id is None else doc_id, key, th, len(s), int(doc_id is None)))
                if doc_id is not None and len(s) and key not in seen:
                    seen[key] = len(sets)
                    sets.append(s)
            out = [(-1, np.array(rows, dtype="<i8").tobytes(), b"")]
            if sets:
                keys = np.array(list(seen), dtype="<i8")
                sig, owner, inst = enum.sign(sets)
                del sets
                order = np.argsort(sig)
                sig, owner, inst = sig[order], owner[order], inst[order]
                start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                size = np.diff(np.append(start, len(sig)))
                hot, bucket = np.zeros(len(sig), dtype=np.uint64), ((sig >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
                if (size > HOT_GROUP).any():
                    many = np.repeat(size > HOT_GROUP, size)
                    out.append((-2, np.stack([keys[owner[many]], _node(bucket[many], sig[many] & SIG), inst[many].astype("<i8")], axis=1).astype("<i8").tobytes(), b""))
                    hot[many] = 1
                    keep = ~many
                    keep[start[size > HOT_GROUP]] = True
                    sig, owner, inst, hot, bucket = sig[keep], owner[keep], inst[keep], hot[keep], bucket[keep]
                words = ((sig & SIG) << np.uint64(18)) | ((inst & np.uint64(63)) << INST) | (hot << np.uint64(11)) | owner.astype(np.uint64)
                words = words.astype("<u8").view("u1").reshape(-1, 8)[:, :7]
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                name = keys.tobytes()
                for b in range(buckets):
                    if ends[b] < ends[b + 1]:
                        part = owner[ends[b] : ends[b + 1]]
                        there = np.zeros(len(keys), dtype=bool)
                        there[part] = True
                        if there.all():
                            out.append((b, words[ends[b] : ends[b + 1]].tobytes(), name))
                        else:  # only the owners that are there: with many buckets most have no word in one, and all names would be many times the words
                            used, local = np.flatnonzero(there), (np.cumsum(there) - 1)[part]
                            w = words[ends[b] : ends[b + 1]].copy()
                            w[:, 0] = local & 255
                            w[:, 1] = (w[:, 1] & 0xF8) | (local >> 8)
                            out.append((b, w.tobytes(), keys[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "x", "y"])

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if len(ids) >= BATCH_DOCS or size > BATCH_CHARS:
                    yield from emit(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from emit(ids, texts)
        _WORDS.clear()
        trim()

    return run


MEET = "kind int, a bigint, b bigint, n int, need int, th bigint"


def _meet(num: int, den: int):
    """Rows of one bucket -> (kind, a, b, n, need, th): 0 a document, its content, size and hash of its text; 3 the size of a row without doc_id; 2 a content tied to another n times; 4 two contents that
    share n signatures. They are linked only if they share ``need``."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []

        def add(kind, a, b, n, need, th=None) -> None:
            fill = lambda v: np.full(len(a), v, dtype=np.int32) if np.isscalar(v) else v.astype(np.int32)
            out.append((fill(kind), a, b, fill(n), fill(need), np.zeros(len(a), np.int64) if th is None else th))

        enum = PartEnum(num, den)
        enum.band(2**22)  # instances past the 64th, of sets of millions, are named as the first ones are, which ask for less: more candidates, no link lost
        needs = np.array([enum.plan(i)[2] for i in range(min(64, len(enum.bands)))], dtype=np.int64)
        words, owners = [], []
        for bucket, x, y in zip(*(table.column(i) for i in range(3)), strict=True):
            x, y, bucket = x.as_py(), y.as_py(), bucket.as_py()
            if bucket == -1:
                r = ints(x).reshape(-1, 5)
                add(np.where(r[:, 4] == 1, 3, 0), r[:, 0], r[:, 1], r[:, 3], 0, r[:, 2])
            elif bucket == -2:
                r = ints(x).reshape(-1, 3)
                add(2, r[:, 0], r[:, 1], 1, needs[r[:, 2] & 63])
            else:
                here = np.uint64(bucket)
                w = np.zeros((len(x) // 7, 8), dtype="u1")
                w[:, :7] = np.frombuffer(x, dtype="u1").reshape(-1, 7)
                w = w.view("<u8").ravel()
                words.append(w >> np.uint64(11))
                owners.append(ints(y)[(w & OWN).astype(np.int64)])
        if words:
            word, own = np.concatenate(words), np.concatenate(owners)
            words, owners = [], []
            order = np.argsort(word >> np.uint64(1))
            word, own = word[order], own[order]
            sig, hot = word >> np.uint64(1), (word & np.uint64(1)).astype(bool)
            same = sig[1:] == sig[:-1]
            met = hot.copy()
            met[1:] |= same
            met[:-1] |= same
            sig, own, hot = sig[met], own[met], hot[met]
            order = np.lexsort((~hot, own, sig))
            sig, own, hot = sig[order], own[order], hot[order]
            if len(sig):
                once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])  # a marked word stays before others of its owner
                sig, own, hot = sig[once], own[once], hot[once]
                start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                size = np.diff(np.append(start, len(sig)))
                need = needs[(sig & np.uint64(63)).astype(np.int64)]
                marked = np.logical_or.reduceat(hot, start)
                large = (size > MEET_GROUP) | marked
                many = np.repeat(large, size) & ~hot  # who sent a marked word is tied already
                if many.any():
                    low = np.repeat(np.where(marked, _node(np.full(len(start), here), sig[start] >> np.uint64(6)), own[start]), size)[many]
                    ties, count = np.unique(np.stack([own[many], low, need[many]], axis=1), axis=0, return_counts=True)
                    add(2, ties[:, 0], ties[:, 1], count, ties[:, 2])
                left, right, req = [], [], []
                for m in range(2, MEET_GROUP + 1):
                    at = start[(size == m) & ~large]
                    for i, j in combinations(range(m), 2):
                        left.append(own[at + i])
                        right.append(own[at + j])
                        req.append(need[at])
                pairs, count = np.unique(np.stack([np.concatenate(right), np.concatenate(left), np.concatenate(req)], axis=1), axis=0, return_counts=True)
                add(4, pairs[:, 0], pairs[:, 1], count, pairs[:, 2])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0)] * 6
        return pa.table({f.split()[0]: pa.array(c, pa.int32() if f.endswith(" int") else pa.int64()) for f, c in zip(MEET.split(", "), cols, strict=True)})

    return run


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The place of the first set of each set's component; overlaps are counted exactly, some columns at a time."""
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        inter = int(np.intersect1d(*sets, assume_unique=True).size)
        return np.array([0, int(not (inter and den * inter >= num * (int(sizes.sum()) - inter)))])
    rows = np.repeat(np.arange(m), sizes)
    _, cols, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[cols] > 1
    rows, cols = rows[shared], cols[shared]
    _, cols = np.unique(cols, return_inverse=True)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    top = int(cols.max(initial=-1)) + 1
    inter, width = np.zeros((m, m), dtype=np.float32), max(1, min(4096, top))
    for lo in range(0, top, width):
        a, b = np.searchsorted(cols, [lo, lo + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[rows[a:b], cols[a:b] - lo] = 1
        inter += x @ x.T  # counts below 2**24 are exact
    root = np.full(m, -1)
    for k in range(m):
        if root[k] < 0:
            root[k], todo = k, [k]
            while todo:
                at = todo.pop()
                i = np.rint(inter[at]).astype(np.int64)
                new = np.flatnonzero((den * i >= num * (sizes[at] + sizes - i)) & (i > 0) & (root < 0))
                root[new] = k
                todo += new.tolist()
    return root


def _cluster_links(read, num: int, den: int):
    """Rows (cl, content, what ``read`` makes a set of) sorted by cl -> links that connect the linked contents of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                keys, root = list(sets), linked(list(sets.values()), num, den)
                found = [(keys[k], keys[r]) for k, r in enumerate(root) if r != k]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        at, sets = None, {}
        for b in batches:
            for cl, content, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if cl != at:
                    yield from close(sets)
                    at, sets = cl, {}
                if content not in sets:
                    sets[content] = read(text)
        yield from close(sets)
        _WORDS.clear()
        trim()

    return run


def _exact(clusters: DataFrame, read, num: int, den: int) -> DataFrame:
    """Links of clusters of bounded size: ``clusters`` (cl, content, text or set)."""
    return clusters.repartition("cl").sortWithinPartitions("cl").mapInArrow(_cluster_links(read, num, den), "a bigint, b bigint")


def _as_set(x) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _as_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                sets = [shingles(t.as_py(), n).view(np.int64) for t in p.column(3)]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), p.column(2), p.column(2), pa.array(sets, pa.list_(pa.int64()))], ["cl", "m", "id", "g", "s"])

    return run


def _reference(table: pa.Table) -> pa.Table:
    """Features that more than half of the given sets have."""
    f, c = np.unique(table.column("s").combine_chunks().flatten().to_numpy(), return_counts=True)
    return pa.table({"cl": table.column("cl")[:1], "m": table.column("m")[:1], "p": pa.array([f[2 * c > table.num_rows]], pa.list_(pa.int64()))})


def _bounded() -> Column:
    return (F.col("m") <= CLUSTER_SETS) & (F.col("features") <= CLUSTER_FEATURES)


def _parted(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The same sets in the components by their first features (cl, m, features, id, g, s)."""
    total = sets.agg(F.sum(F.size("s")).alias("n")).first()["n"] or 0
    e = sets.select("cl", "id", F.size("s").alias("n"), F.explode("s").alias("f"))
    df = e.groupBy("cl", "f").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("cl", "f", "count", F.col("count").alias("df"))
    fs = join_counted(e, df, ["cl", "f"], total).groupBy("cl", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("fs"))
    # Features that no other set has take the first places of the prefix.
    room = F.size("fs") - F.ceil(F.lit(num) * F.col("n") / den - 1e-9).cast("int") + 1
    first = materialize(fs.select("cl", "id", F.explode(F.slice("fs", 1, F.greatest(room, F.lit(0)))).alias("x")).select("cl", "id", "x.f"), "prefixes", True)
    low = first.groupBy("cl", "f").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("count")).where("count > 1")
    ties = join_counted(first, low, ["cl", "f"], total).where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    parts = components(ties)
    discard(first)
    new = materialize(sets.select("id", "g", "s").join(parts, "id").select(F.col("component").alias("cl"), "id", "g", "s"), "sets", True)
    size = new.groupBy("cl").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("s")).alias("features")).withColumn("count", F.col("m"))
    out = materialize(join_counted(new, size, ["cl"], total), "sets", True)
    discard(new)
    return out


def _large_links(sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links (a, b) that connect all linked sets of each cluster of ``sets`` (cl, m: its sets, id, g: sets of one g are connected already, s)."""
    up, down, out, round_ = den + num, den - num, None, 0
    salt = F.pmod(F.xxhash64("id"), F.floor(F.col("m") / SALT_SETS) + 1)
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("m") / SALT_SETS)))).drop("m")
    xor = lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a))
    while not sets.isEmpty():
        first = Window.partitionBy("cl").orderBy(F.xxhash64("id", F.lit(round_)))
        p = sets.withColumn("k", F.row_number().over(first)).where(F.col("k") <= REFERENCE_SETS).select("cl", "m", "s").groupBy("cl").applyInArrow(_reference, "cl bigint, m bigint, p array<bigint>")
        x = sets.withColumn("salt", salt).join(spread(p), ["cl", "salt"]).select("cl", "m", "id", "g", "salt", F.size("s").alias("n"), xor(F.col("s"), F.col("p")).alias("r"))
        x = materialize(x.withColumn("w", F.lit(up) * F.size("r") - F.lit(down) * F.col("n").cast("bigint")), "residuals", True)
        c = x.groupBy("cl", "m").agg(F.min_by(F.struct("id", "g", "w", "n", "r"), F.struct("w", "id")).alias("c"))
        y = x.join(spread(c), ["cl", "salt"]).withColumn("near", F.lit(up) * F.size(xor(F.col("r"), F.col("c.r"))) <= F.lit(down) * (F.col("n") + F.col("c.n")).cast("bigint"))
        y = materialize(y.select("cl", "m", "id", "salt", "n", "w", "r", "near", F.when(F.col("near"), F.col("c.g")).otherwise(F.col("g")).alias("g"), F.col("c.id").alias("c"), F.col("c.w").alias("wc")), "near", True)
        discard(x)
        links = y.where("near and id <> c").select(F.col("id").alias("a"), F.col("c").alias("b"))
        far = y.where("not near").groupBy("cl", "m").agg(F.min("w").alias("wf"))
        z = y.join(spread(far), ["cl", "salt"])
        # Features of far sets that another set has; the rarest come first, and those that no other set has before all.
        e = materialize(z.select("cl", "id", "g", "near", "n", F.greatest(F.lit(1), F.ceil((F.col("w") + F.when(F.col("near"), F.col("wf")).otherwise(F.col("wc"))) / (2 * up))).cast("int").alias("o"), F.explode("r").alias("f")), "residual-features", True)
        df = e.groupBy("cl", "f").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("near")).alias("far")).where("count > 1 and far > 0").select("cl", "f", "count", F.col("count").alias("df"))
        known = join_counted(e, df, ["cl", "f"], e.count())
        fs = known.groupBy("cl", "id", "g", "near", "n", "o").agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("fs"))
        e2 = materialize(fs.select("cl", "id", "g", "near", "n", F.explode(F.slice("fs", 1, F.greatest(F.size("fs") - F.col("o") + 1, F.lit(0)))).alias("x")).select("cl", "id", "g", "near", "n", "x.f"), "prefixes", True)
        discard(e)
        group = e2.groupBy("cl", "f").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("near")).alias("far"), F.min("g").alias("g0"), F.max("g").alias("g1"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("features"))
        group = group.where("count > 1 and far > 0 and g0 <> g1").groupBy("cl", "who", "low", "high", "count", "features").agg(F.min("f").alias("f"))  # the same group through several features
        small = e2.join(group.where(F.col("count") <= PAIR_GROUP).select("cl", "f"), ["cl", "f"])
        pairs = small.alias("l").join(small.alias("r"), ["cl", "f"]).where("l.id < r.id and l.g <> r.g and not (l.near and r.near)").select("cl", F.col("l.id").alias("i"), F.col("r.id").alias("j")).distinct()
        l, r = (y.select("cl", F.col("id").alias(i), F.struct("n", "r").alias(s)) for i, s in (("i", "l"), ("j", "r")))
        found = pairs.join(l, ["cl", "i"]).join(r, ["cl", "j"]).where(F.lit(up) * F.size(xor(F.col("l.r"), F.col("r.r"))) <= F.lit(down) * (F.col("l.n") + F.col("r.n")).cast("bigint"))
        links = links.union(found.select(F.col("i").alias("a"), F.col("j").alias("b")))
        # Larger groups are clusters again.
        big = group.where(F.col("count") > PAIR_GROUP).select("cl", "f", "count", F.col("count").alias("size"), "features", F.xxhash64("cl", "f", F.lit(round_)).alias("next"))
        to = join_counted(e2, big, ["cl", "f"], e2.count()).select("cl", "id", "g", "size", "features", "next")
        new = materialize(to.join(sets.select("cl", "id", "s"), ["cl", "id"]).select(F.col("next").alias("cl"), F.col("size").alias("m"), "features", "id", "g", "s"), "sets", True)
        links = materialize(links.union(_exact(new.where(_bounded()).select("cl", "id", "s"), _as_set, num, den)), "links", True)
        out = links if out is None else out.union(links)
        discard(sets, y, e2)
        sets, round_ = new.where(~_bounded()), round_ + 1
    return out


def links(documents: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, content) of every row, and edges (a, b) of contents whose components are those of all links. Rows without doc_id or words have a null content."""
    spark = documents.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = documents.select("doc_id", "text").mapInArrow(_signed(n, num, den, buckets), "bucket int, x binary, y binary")
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("x"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    met = materialize(met.groupBy(spread.alias("b")).applyInArrow(_meet(num, den), MEET), "met", True)
    rows = met.where("kind in (0, 3)").select(F.when(F.col("kind") == 0, F.col("a")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when((F.col("kind") == 0) & (F.col("n") > 0), F.col("b")).alias("content"), "th")
    ties = materialize(met.where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")), "ties", True)
    large = ties.groupBy("a").agg(F.sum("n").alias("large"), F.min("need").alias("need"))
    often = met.where("kind = 4").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    la, lb = large.select("a", F.col("large").alias("large_a")), large.select(F.col("a").alias("b"), F.col("large").alias("large_b"))
    often = often.join(la, "a", "left").join(lb, "b", "left").where(F.col("n") + F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0))) >= F.col("need")).select("a", "b")
    # Of each member's ties the weakest are left out, less than half of ``need`` in all.
    up = Window.partitionBy("a").orderBy("n", F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("a")
    stars = ties.select("a", "b", F.sum("n").over(up).alias("sum"), F.sum("n").over(every).alias("large"), F.min("need").over(every).alias("need")).where("large >= need and 2 * sum > need - 1 and a <> b").select("a", "b")
    candidates = materialize(often.union(stars), "candidates", True)
    cl = materialize(components(candidates).select(F.col("id").alias("content"), F.col("component").alias("cl")), "clusters", True)
    discard(candidates, ties)
    text_of = rows.where("content is not null").groupBy("content").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.first("n_shingles").alias("n"))
    members = materialize(cl.join(text_of, "content").select("cl", "content", "n", "at.doc_id", "at.th"), "members", True)
    discard(cl)
    size = members.groupBy("cl").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("features"))
    size = size.select("cl", "count", F.col("count").alias("m"), ((F.col("count") > CLUSTER_SETS) | (F.col("features") > CLUSTER_FEATURES)).alias("big"))
    sized = join_counted(members, size, ["cl"], members.count())
    t = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    found = materialize(sized.join(t, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("cl", "m", "big", "content", "text"), "texts", True)
    discard(members)
    edges = _exact(found.where("not big").select("cl", "content", "text"), lambda t: shingles(t.as_py(), n), num, den)
    if not (big := found.where("big")).isEmpty():
        sets = materialize(big.select("cl", "m", "content", "text").mapInArrow(_as_sets(n), "cl bigint, m bigint, id bigint, g bigint, s array<bigint>"), "sets", True)
        parts = _parted(sets, num, den)
        discard(sets)
        edges = edges.union(_exact(parts.where(_bounded()).select("cl", "id", "s"), _as_set, num, den))
        if (more := _large_links(parts.where(~_bounded()).drop("features"), num, den)) is not None:
            edges = edges.union(more)
    edges = materialize(edges, "links", True)
    discard(found)
    return rows, edges


def near_duplicates(documents: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, edges = links(documents, n, num, den)
    known = rows.where("content is not null")
    # A doc_id that repeats ties its contents together.
    again = known.groupBy("doc_id").agg(F.min("content").alias("b"), F.max("content").alias("c")).where("b <> c").select("doc_id", "b")
    again = known.join(again, "doc_id").where("content <> b").select(F.col("content").alias("a"), "b")
    group = components(edges.union(again)).withColumnRenamed("id", "content")
    least = known.groupBy("content").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("count"))
    least = materialize(least.join(group, "content", "left").withColumn("component", F.coalesce("component", "content")), "contents", True)
    first = least.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("count"))
    of = join_counted(least.select("content", "component", F.col("count").alias("rows")), first, ["component"], least.count()).select("content", F.col("rows").alias("count"), "component_id")
    # A doc_id whose rows have no words but once is in the component of its other texts.
    named = join_counted(known, of, ["content"], known.count()).select("doc_id", "n_shingles", "component_id")
    bare = rows.where("content is null").join(named.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    return named.union(bare.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id")))


def deduplicate(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row of the smallest doc_id of each component, and all rows without links; all columns as they are, whatever their names.

    Rows are joined by a key of doc_id and text, so rows that repeat a doc_id with other texts are documents of their own. Of rows that
    repeat both one stays. Rows without doc_id or words stay.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.length("text"), "text"))
    rows, edges = links(documents.select(key.alias("doc_id"), "text"), n, num, den)
    group = components(edges).withColumnRenamed("id", "content")
    ids = documents.select(key.alias("key"), "doc_id").where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    known = rows.where("content is not null").select(F.col("doc_id").alias("key"), "content").distinct().join(ids, "key").join(group, "content", "left")
    known = materialize(known.select("key", "copies", F.coalesce("component", "content").alias("component"), F.struct("doc_id", "key").alias("at")), "linked", True)
    # Only the least doc_id of a component stays, once.
    first = known.groupBy("component").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    drop = join_counted(known, first, ["component"], known.count()).select("key", "copies", (F.col("at") != F.col("first")).alias("drop")).where("drop or copies > 1")
    drop = materialize(drop, "verdicts", True)
    discard(known)
    judged = documents.select(key.alias("key"), F.struct(*documents.columns).alias("row")).join(drop, "key", "left")
    once = judged.where("copies > 1 and not drop").groupBy("key").agg(F.first("row").alias("row"))
    return judged.where("drop is null").select("row.*").union(once.select("row.*"))


def op1_jaccard(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
n AS (SELECT r, doc_id, len(sh) AS n FROM s),
u AS (SELECT r, unnest(sh) AS x FROM s),
p AS (SELECT a.r AS r1, b.r AS r2, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p JOIN n a ON a.r = r1 JOIN n b ON b.r = r2 WHERE 100 * i >= 90 * (a.n + b.n - i)),
c AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n LEFT JOIN m ON n.doc_id = m.doc_id
"""
