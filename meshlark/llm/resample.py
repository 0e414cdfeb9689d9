"""Importance resampling to a target distribution, over hashed word n-grams.

A text's features are its runs of 1 to ``longest`` consecutive words, hashed to buckets. A bucket's gain is the smoothed log ratio of its shares in the target and in the raw
texts, a document's weight the mean gain of its features, and the draw takes the highest weights after Gumbel noise that depends on doc_id alone.

Texts are skewed, so long ones (over ``LONG_CHARS``) are cut at word boundaries into chunks of ``CHUNK_WORDS`` words, which are dealt to tasks anew. A chunk owns the
features that begin at its words and carries the ``longest`` - 1 words after them, so every feature is counted once; counts and gains are then summed by document.

Defined results: a null or empty text has no features and weight 0. A null doc_id is hashed as the empty string and comes last among equal scores. Rows that repeat a doc_id and its text
are drawn each, with ranks of their own; rows that repeat a doc_id with other texts are documents of their own. An empty target or corpus counts 0 of 0. Clashing and
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.llm.common import discard, materialize

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8 bytes
BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
LONG_CHARS, CHUNK_WORDS, CACHED_WORDS, BATCH_ROWS = 32_768, 4096, 400_000, 256
PIECE = "doc_id bigint, digest binary, piece int, own int, words binary"
FEATURED = "doc_id bigint, digest binary, piece int, n_words bigint, n_features bigint, buckets array<int>"


class _Buckets(dict):
    """Buckets of features that have been met, a bounded number of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def _words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())  # bytes: only A-Z have another case


def cut(text: bytes, size: int, carry: int) -> Iterator[tuple[int, bytes]]:
    """(words owned, chunk) of a text: ``size`` words each, and up to ``carry`` words of the next chunk after them; one empty chunk if there is no word."""
    text, n, given, starts = text.lower(), 0, 0, []
    for m in WORD.finditer(text):
        if n % size == 0:
            starts.append(m.start())
        n += 1
        if n == (given + 1) * size + carry:
            yield size, text[starts.pop(0) : m.end()]
            given += 1
    if not n:
        yield 0, b""
    for k, at in enumerate(starts, given):
        yield min(size, n - k * size), text[at:]


def _cut_rows(size: int, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                doc, digest, held = b.column(0).slice(k, 1), b.column(1).slice(k, 1), []
                text = b.column(2)[k].as_py() or b""
                for piece, (own, words) in enumerate(cut(text, size, carry)):
                    held.append((piece, own, words))
                    if len(held) == 64:
                        yield _pieces(doc, digest, held)
                        held = []
                if held:
                    yield _pieces(doc, digest, held)

    return run


def _pieces(doc: pa.Array, digest: pa.Array, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, (piece, own, words) = len(held), zip(*held, strict=True)
    same = pa.array(np.zeros(n, dtype=np.int64))
    return pa.RecordBatch.from_arrays([doc.take(same), digest.take(same), pa.array(piece, pa.int32()), pa.array(own, pa.int32()), pa.array(words, pa.binary())], [c.split(" ")[0] for c in PIECE.split(", ")])


def _bucketed(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Buckets(buckets)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                n_words, ends, found = [], [0], []
                for own, text in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                    w = _words(text.as_py())
                    own = len(w) if own is None else own
                    size = 0
                    for k in range(1, longest + 1):
                        feats = w[:own] if k == 1 else [b" ".join(w[i : i + k]) for i in range(min(own, len(w) - k + 1))]
                        found.append(np.fromiter(map(place.__getitem__, feats), dtype=np.int32, count=len(feats)))
                        size += len(feats)
                    n_words.append(own)
                    ends.append(ends[-1] + size)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array(n_words, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), lists], [c.split(" ")[0] for c in FEATURED.split(", ")])

    return run


def features(documents: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, digest (of the text), piece (0 for the first or only chunk), n_words, n_features, buckets: one row for each text or, if it is long, chunk."""
    if not 1 <= longest <= CHUNK_WORDS:
        raise ValueError("runs have at least one word and at most those of a chunk")
    t = F.coalesce("text", F.lit(""))
    d = documents.select("doc_id", F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("t"))
    long = F.length("t") > LONG_CHARS
    short = d.where(~long).select("doc_id", "digest", F.lit(0).alias("piece"), F.lit(None).cast("int").alias("own"), F.encode("t", "utf-8").alias("words"))
    chunks = d.where(long).select("doc_id", "digest", F.encode("t", "utf-8").alias("t")).mapInArrow(_cut_rows(CHUNK_WORDS, longest - 1), PIECE).repartition("digest", "piece")
    run = _bucketed(longest, buckets)
    return short.mapInArrow(run, FEATURED).unionByName(chunks.mapInArrow(run, FEATURED))


def counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has: one row a bucket reaches the driver."""
    out = np.zeros(buckets)
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of each bucket's smoothed shares."""
    m = len(raw)
    return np.floor(1000 * np.log((target + 1) * (raw.sum() + m) / ((raw + 1) * (target.sum() + m)))).astype(np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(5)
            total = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(b.column(4).to_numpy())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(total[ends[1:]] - total[ends[:-1]])], ["doc_id", "digest", "piece", "n_words", "n_features", "gain"])

    return run


def weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, digest, copies (rows with this doc_id and text), n_words, n_features, weight. Chunks and copies are summed together and divided by the number of copies."""
    x = featured.mapInArrow(_weighed(gain), "doc_id bigint, digest binary, piece int, n_words bigint, n_features bigint, gain bigint")
    s = x.groupBy("doc_id", "digest").agg(F.count_if(F.col("piece") == 0).alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    s = s.select("doc_id", "digest", "copies", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "gain")))
    floor = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return s.select("doc_id", "digest", "copies", "n_words", "n_features", F.when(F.col("n_features") > 0, floor).otherwise(0).alias("weight"))


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank, a row for each copy. Scores are sorted in ranges; the ranges' sizes, a row each, give the ranks before them."""
    able = F.col("n_words") >= min_words
    draw = (scored.where(able).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] * percent) // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest")]
    x = materialize(scored.where(able).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges", True)
    size = x.groupBy("part").agg(F.sum("copies").alias("size"))
    before = size.alias("a").join(F.broadcast(size.alias("b")), F.col("a.part") > F.col("b.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))  # a row for each range
    upto = F.sum("copies").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("upto", F.coalesce(upto, F.lit(0))).join(F.broadcast(before), "part").withColumn("first", F.col("before") + F.col("upto") + 1)
    each = lambda df, at: df.select("doc_id", "n_features", "weight", "score", F.explode(F.sequence(at, at + F.col("copies") - 1)).alias("rank"))
    place = F.when(F.col("rank") <= draw, F.col("rank"))
    out = each(x, F.col("first")).withColumn("rank", place)
    return out.unionByName(each(scored.where(~able), F.lit(1).cast("long")).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null if not drawn) of each row of ``documents``; ``target`` has texts."""
    featured = materialize(features(documents, longest, buckets), "features", True)
    wanted = counts(features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), longest, buckets), buckets)
    scored = materialize(with_scores(weights(featured, gains(counts(featured, buckets), wanted)), seed), "scores", True)
    discard(featured)
    return ranked(scored, min_words, percent)


def op12_resample(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(documents, benchmark)


# DuckDB has no crc32: its table of 256 rows comes from the polynomial, and each distinct word is folded over it.
ORACLE_SQL = r"""
WITH RECURSIVE step(b, k, c) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
f AS (SELECT row, unnest(w) AS w FROM d),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM q)),
crc AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT)), lambda a, x: xor(tab.t[(xor(a, x) & 255) + 1], a >> 8))) % 10000 AS b FROM v, tab),
s AS (SELECT b, count(*) AS n FROM f JOIN crc USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM q JOIN crc USING (w) GROUP BY b),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
m AS (SELECT row, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN crc USING (w) JOIN g USING (b) GROUP BY row),
x AS (SELECT d.row, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (row)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (row)
"""
