"""Filter audit, importance resampling and the language model against second versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from meshlark.llm import filter_audit, maxent, resample

DOCS = "doc_id bigint, text string, lang string, part string, score string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "y", "z") for i, t, g in rows], DOCS)


def some_rows(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["AB", "Cde", "é", "x$", "#", "10%"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice((0, 3, 40, 99, 100, 130, 260)))), rng.choice(("en", "de", "", None))) for k in range(60)]
    rows += [(100 + k, rows[5][1], "en") for k in range(4)] + [(100, rows[5][1], "de"), (2, rows[5][1], "fr")]
    rows += [(200, None, "en"), (201, "", "en"), (None, rows[5][1], "en"), (None, None, None), (202, "A" * 30, "en"), (203, "  \x0b\x1c a", "en"), (204, "long word " * 9000, "en")]
    return rows


# Filter audit ----------------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    quality, toxic = ({i for i, q, x in labels if (q if k == 0 else x) == 1 and i is not None} for k in (0, 1))
    found = []
    for i, t, g in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found.append((g or "", i, {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}))
    out = {}
    for part in {g for g, *_ in found}:
        own = [x for x in found if x[0] == part]
        for p in permutations("ABCDE"):
            left = own
            for k, f in enumerate(p):
                here, gone = [x for x in left if x[2][f]], [x for x in own if x[2][f] and any(x[2][q] for q in p[:k])]
                left = [x for x in left if not x[2][f]]
                only = [x for x in own if x[2][f] and sum(x[2].values()) == 1]
                out[part, "".join(p), k + 1] = [len(left), len(here), len(gone), len(only), sum(x[1] in quality for x in here), sum(x[1] in toxic for x in here)]
        for f in "ABCDE":
            keys = [(part, "".join(p), p.index(f) + 1) for p in permutations("ABCDE")]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def test_audit_equals_brute_force(spark):
    rows = some_rows()
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 110, 2)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (999, 1, 1), (7, None, None)]
    got = filter_audit.audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == brute_audit(rows, labels)
    assert len(got) == len({r.part for r in got}) * 600


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), none).collect() == []
    got = filter_audit.audit(docs(spark, [(1, "a b", None)]), none).collect()
    assert len(got) == 600
    assert {(r.part, r.good_lost, r.toxic_lost) for r in got} == {("", 0, 0)}


# Importance resampling -------------------------------------------------------------------------------------------------


def brute_resample(rows, target, longest, buckets, min_words, percent, seed):
    def feats(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    f = [(i, hashlib.sha256((t or "").encode()).digest(), *feats(t)) for i, t, _ in rows]
    raw, want = Counter(b for x in f for b in x[3]), Counter(b for t in target for b in feats(t)[1])
    S, T = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets)))) for b in raw}
    out = []
    for i, digest, n, x in f:
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, digest, n, len(x), weight))
    able = sorted((x for x in out if x[3] >= min_words), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    drawn = able[: len(able) * percent // 100]
    return Counter((x[1], x[4], x[5], x[0], k) for k, x in enumerate(drawn, 1)) + Counter((x[1], x[4], x[5], x[0], None) for x in able[len(drawn) :] + [x for x in out if x[3] < min_words])


@pytest.mark.parametrize(("longest", "long_chars", "percent"), [(1, 100, 10), (3, 100, 60), (2, 10**9, 100)])
def test_resample_equals_brute_force(spark, monkeypatch, longest, long_chars, percent):
    monkeypatch.setattr(resample, "LONG_CHARS", long_chars)
    monkeypatch.setattr(resample, "CHUNK_WORDS", 37)
    rows = some_rows() + [(204, "long word " * 9000, "en"), (204, "long word " * 8, "en")]
    target = ["w1 w2 w3 é", None, "", "w1 w2 unknown words"]
    t = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(target)], "item_id bigint, text string, buckets string")
    got = resample.resample(docs(spark, rows), t, longest, 50, 20, percent).collect()
    assert Counter(map(tuple, got)) == brute_resample(rows, target, longest, 50, 20, percent, 2024)


def test_chunks_own_each_word_once():
    for size, carry in ((4, 0), (4, 1), (4, 3), (1, 0), (7, 2)):
        for n in range(40):
            w = [b"w%d" % k for k in range(n)]
            got, at = list(resample.cut(b"  " + b" ,".join(w) + b"!", size, carry)), 0
            for own, chunk in got:
                assert resample.WORD.findall(chunk) == w[at : at + own + carry]
                at += own
            assert at == n and got


def test_resample_of_nothing(spark):
    none = docs(spark, [])
    assert resample.resample(none, none).collect() == []
    got = resample.resample(docs(spark, [(1, "a", "en"), (2, None, None)]), none).collect()
    assert {(r.doc_id, r.n_features, r.rank) for r in got} == {(1, 1, None), (2, 0, None)}


# Language model --------------------------------------------------------------------------------------------------------

SMALL = maxent.Shape(classes=4, members=4, rows=64, rounds=5, prior=1.0)


def brute_base(rows):
    tok = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) + ["end"]) for i, t, _ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, x in tok if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for i, x in tok]


@pytest.mark.parametrize("share", [1 << 20, 40])
def test_base_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(maxent, "HOT_SHARE", share)  # 40: most tokens are joined
    monkeypatch.setattr(maxent, "COUNTED_TOKENS", 5)
    rows = some_rows()
    got = maxent.score(docs(spark, rows), SMALL).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(brute_base(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def dense_log(model, ids, shape):
    """log P of each symbol, one at a time and with no shared work."""
    back, last, out = shape.begin, shape.begin, []
    for s in ids:
        c = np.array([back * shape.symbols + last])
        rows = maxent._features(c, 0, shape)[:, 0]
        x = model.classes.astype(float) + sum(model.hashed[r, : shape.classes].astype(float) for r in rows)
        k, m = divmod(s, shape.members)
        rows = maxent._features(c, k + 1, shape)[:, 0]
        y = model.members[k].astype(float) + sum(model.hashed[r, : shape.members].astype(float) for r in rows)
        out.append(x[k] - math.log(np.exp(x).sum()) + y[m] - math.log(np.exp(y).sum()))
        back, last = last, s
    return out


def test_batches_equal_one_at_a_time_and_probabilities_sum_to_one():
    shape, rng = SMALL, np.random.default_rng(2)
    w = maxent.Weights.of_counts(rng.integers(0, 9, shape.symbols).astype(float), shape)
    w = maxent.Weights(w.classes, w.members, rng.normal(size=w.hashed.shape).astype(np.float32))
    texts = [rng.integers(0, shape.symbols - 1, n) for n in (1, 2, 3, 40, 1, 7)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    got = maxent.log_probabilities(np.concatenate(texts), first, w, shape)
    assert np.allclose(got, np.concatenate([dense_log(w, t, shape) for t in texts]), atol=1e-4)
    each = [math.exp(maxent.log_probabilities(np.array([3, 5, s]), np.array([0]), w, shape)[2]) for s in range(shape.symbols)]
    assert math.isclose(sum(each), 1.0, rel_tol=1e-4)


def test_sums_by_weight_are_the_gradient():
    """Found less expected sums against differences of the log likelihood."""
    shape, rng = maxent.Shape(classes=3, members=3, rows=16), np.random.default_rng(4)
    context, owner, symbol, n = np.array([4, 17, 80]), np.array([0, 0, 1, 2, 2]), np.array([0, 5, 7, 1, 2]), np.array([3, 1, 2, 5, 4])
    hashed = rng.normal(size=(16, 3))

    def run(h):
        w = maxent.Weights(np.zeros(3), np.zeros((3, 3)), h)
        found, wanted = np.zeros((2, 16, 3))
        return maxent.gradient(context, owner, symbol, n, w, shape, found, wanted, np.zeros(16, dtype=bool)), found - wanted

    _, g = run(hashed)
    for r in range(16):
        for c in range(3):
            up, down = hashed.copy(), hashed.copy()
            up[r, c] += 1e-5
            down[r, c] -= 1e-5
            assert math.isclose((run(up)[0] - run(down)[0]) / 2e-5, g[r, c], abs_tol=1e-4)


def test_steps_balance_the_bound():
    rng = np.random.default_rng(1)
    found, wanted = rng.choice([0, 1, 50, 1e5], 4000) * rng.random(4000), rng.choice([1e-5, 1e-2, 1, 1e5], 4000) * rng.random(4000) + 1e-6
    weight = rng.normal(size=4000)
    x = maxent.step(found, wanted, weight, 4.0)
    assert np.abs((found - wanted * np.exp(3 * x) - 4 * (weight + x)) / (found + wanted + 4)).max() < 1e-9


def test_training_raises_the_likelihood_and_beats_counts_on_held_out_texts(spark):
    """Texts from a chain of words: what follows a word depends on it."""
    rng = random.Random(6)
    follow = {k: rng.sample(range(40), 3) for k in range(40)}

    def text():
        at, out = rng.randrange(40), []
        for _ in range(80):
            out.append(f"t{at}")
            at = rng.choice(follow[at])
        return " ".join(out)

    d = docs(spark, [(k, text(), "en") for k in range(150)])
    shape = maxent.Shape(classes=8, members=8, rows=4096, rounds=6)
    got = [r for r in maxent.score(d, shape).collect() if r.held_out]
    assert len(got) > 10
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)  # both are negative
    lex, _ = maxent.lexicon(maxent.token_counts(maxent.prepared(d)), 100, shape)
    enc = maxent.prepared(d).mapInArrow(maxent._encoded(spark.sparkContext.broadcast(lex)), maxent.ENCODED)
    _, trace = maxent.train(maxent.context_counts(enc, shape), lex.symbol_counts, shape)
    assert all(b > a for a, b in zip(trace, trace[1:], strict=False))


def test_scores_of_nothing_and_of_held_out_texts_alone(spark):
    assert maxent.score(docs(spark, []), SMALL).collect() == []
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    (r,) = maxent.score(docs(spark, [(held, "a b", None)]), SMALL).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(r.score)


def test_queries_meet_their_sql(spark):
    from meshlark.llm import queries

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        try:
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        except duckdb.IOException:
            pytest.skip("no test tables here")
    for name in ("op11_audit", "op12_resample"):
        got = queries.QUERIES[name](spark, sf)
        r = duck.execute(queries.ORACLE_SQL[name])
        cols = [c[0] for c in r.description]
        assert Counter(map(tuple, got.select(*cols).collect())) == Counter(map(tuple, r.fetchall()))
