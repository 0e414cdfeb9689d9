"""Secret scans: three fixed patterns, and character Markov models of random strings against ordinary identifiers.

``train`` fits two first-order Markov chains over characters to labelled samples (token, is_random) and a threshold on
the mean log-likelihood ratio, half-way between the two classes' inner quantiles; so too for each length from ``SHORT`` to below ``MIN_TOKEN``,
over samples cut to that length. Tokens without a digit have to reach the low quantile of random letters instead, as words are nearer to those.
Tokens of ``SHORT`` or more characters that hold a letter and score above the threshold of their length add spans of kind ``model``; they never
replace the patterns' spans, and what such spans leave of a token is scored for itself.

Defined results: null and empty texts have no spans; a span is the whole match, in code points, end exclusive.
An empty table gives no rows and trains on generated samples alone. Repeated rows are scanned alike. A null doc_id is scanned but does not teach. A very long text is scanned whole, in one task.
``scan`` ignores other columns; ``redact`` keeps all columns and rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import enter

# The base patterns and their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
MASK = "[SECRET]"

SHORT, MIN_TOKEN = 12, 20
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORT},}}")
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_RANDOM = 1000, 20_000, 20_000
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def _place(c: str) -> int:
    return ord(c) if c < "\x80" else 127


@dataclass(frozen=True)
class MarkovRatio:
    """log P(next | this) under the random chain less that under the ordinary one, as a 128 x 128 table; row 0 starts a token."""

    table: tuple[tuple[float, ...], ...]
    threshold: float
    short: tuple[float, ...] = ()  # thresholds of lengths from SHORT to below MIN_TOKEN
    letters: tuple[float, ...] = ()  # of tokens without a digit, from SHORT to MIN_TOKEN and above

    def score(self, token: str) -> float:
        at, total, table = 0, 0.0, self.table
        for c in token:
            n = _place(c)
            total += table[at][n]
            at = n
        return total / max(1, len(token))

    def is_secret(self, token: str) -> bool:
        if len(token) < SHORT or not any(c.isalpha() for c in token):
            return False
        if any(c.isdigit() for c in token):
            least = self.threshold if len(token) >= MIN_TOKEN else self.short[len(token) - SHORT]
        else:
            least = self.letters[min(len(token), MIN_TOKEN) - SHORT]
        return self.score(token) > least


def _chain(tokens: list[str]) -> list[list[float]]:
    counts = [[0.1] * 128 for _ in range(128)]
    for t in tokens:
        at = 0
        for c in t:
            n = _place(c)
            counts[at][n] += 1.0
            at = n
    return [[math.log(x / total) for x in row] for row in counts for total in [sum(row)]]


def train(samples: list[tuple[str, bool]]) -> MarkovRatio:
    """Fits the chains on four fifths of the labelled samples and the threshold on the rest."""
    held = [x for k, x in enumerate(samples) if k % 5 == 0]
    fit = [x for k, x in enumerate(samples) if k % 5]
    rand, word = _chain([t for t, r in fit if r]), _chain([t for t, r in fit if not r])
    model = MarkovRatio(tuple(tuple(a - b for a, b in zip(x, y, strict=True)) for x, y in zip(rand, word, strict=True)), 0.0)
    low = sorted(model.score(t) for t, r in held if r and len(t) >= MIN_TOKEN) or [1.0]
    high = sorted(model.score(t) for t, r in held if not r and len(t) >= MIN_TOKEN // 2) or [0.0]
    half = (low[len(low) // 100] + high[-1 - len(high) // 1000]) / 2
    short, letters, only = [], [], [re.sub("[^A-Za-z]", "", t) for t, r in held if r]
    for n in range(SHORT, MIN_TOKEN + 1):
        x = sorted(model.score(t[:n]) for t, r in held if r and len(t) >= n) or [1.0]
        y = sorted(model.score(t[:n]) for t, r in held if not r and len(t) >= n) or [0.0]
        z = sorted(model.score(t[:n]) for t in only if len(t) >= n) or [1.0]
        short.append((x[len(x) // 100] + y[-1 - len(y) // 1000]) / 2)
        letters.append(max(z[len(z) // 20], half if n == MIN_TOKEN else short[-1]))
    return MarkovRatio(model.table, half, tuple(short[:-1]), tuple(letters))


def random_samples(n: int, seed: int = 17) -> list[tuple[str, bool]]:
    rng, kinds = random.Random(seed), list(ALPHABETS.values())
    return [("".join(rng.choices(kinds[k % len(kinds)], k=rng.randint(MIN_TOKEN, 64))), True) for k in range(n)]


def ordinary_samples(words: list[str], n: int, seed: int = 23) -> list[tuple[str, bool]]:
    """Identifiers of one to five words in the usual spellings, some with a number."""
    rng, words = random.Random(seed), sorted(w for w in words if w.isascii()) or ["value", "index", "count", "name"]
    out = []
    for _ in range(n):
        parts = rng.choices(words, k=rng.randint(1, 5))
        style = rng.randrange(5)
        t = "_".join(parts) if style == 0 else "-".join(parts) if style == 1 else "".join(p.capitalize() for p in parts) if style == 2 else "/".join(parts) if style == 3 else "_".join(parts).upper()
        out.append((t + rng.choice(["", "", "_2", "404", "-v1", "2024", "_01"]), False))
    return out


def corpus_samples(documents: DataFrame, docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS, rand: int = SAMPLE_RANDOM) -> list[tuple[str, bool]]:
    """Labelled samples: identifiers made of distinct words of a bounded sample of documents (by hash of doc_id), and generated random strings."""
    ids = documents.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs).distinct()
    w = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    w = w.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,24}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    found = [r.w for r in w.orderBy(F.xxhash64("w"), "w").limit(words).collect()]
    mixed = random_samples(rand) + ordinary_samples(found, rand)
    random.Random(5).shuffle(mixed)
    return mixed


def spans(text: str | None, model: MarkovRatio | None) -> list[tuple[int, int, str, int]]:
    """(start, kind's place, end, start of the secret itself), in order."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    longest = max(map(len, text.split()), default=0)
    if longest >= 32:
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    if model and longest >= SHORT:
        taken = sorted((a, b) for a, _, b, _ in out)
        for m in TOKEN.finditer(text):
            at = m.start()
            for a, b in [*((a, b) for a, b in taken if a < m.end() and m.start() < b), (m.end(), m.end())]:
                if a - at >= SHORT and model.is_secret(text[at:a]):
                    out.append((at, 3, a, at))
                at = max(at, b)
    return sorted(out)


def _text(found: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


def _digests(model: MarkovRatio):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                found = spans(t.as_py(), model)
                base = [x for x in found if x[1] < 3]
                n = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(_text(base).encode()).hexdigest(), _text(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return digests


def scan(documents: DataFrame, model: MarkovRatio) -> DataFrame:
    return documents.select("doc_id", "text").mapInArrow(_digests(model), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def mask(text: str | None, model: MarkovRatio) -> str | None:
    """The text with each secret replaced; a keyword before it stays."""
    cuts, at, out = sorted((s, b) for _, _, b, s in spans(text, model)), 0, []
    for a, b in cuts:
        if b > at:
            out += [text[at:a], MASK] if a >= at else []
            at = b
    return "".join(out) + text[at:] if out else text


def redact(documents: DataFrame, model: MarkovRatio) -> DataFrame:
    """The same rows and columns with secrets masked in ``text`` and ``n_chars`` (if there) brought up to date."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets")
        for b in batches:
            texts = [mask(t.as_py(), model) for t in b.column(at)]
            cols = [pa.array(texts, b.column(at).type) if k == at else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out


def op9_secrets(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return scan(documents, train(corpus_samples(documents)))
