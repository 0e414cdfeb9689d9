"""Quality rules: learned decision lists over text statistics, in DataFrame operations only.

``features`` computes the statistics of each whole text within its row. ``learn`` fits a decision list by sequential covering: a
rule is a conjunction of thresholds, grown by information gain on two thirds of the labelled rows, pruned on the rest, and kept if it is
precise there; the rows it covers are then set aside. All counts are Spark aggregates over all labelled rows (one row per feature and
bin reaches the driver). ``DecisionList.reject`` is the ordered conditional expression that Spark evaluates.

Defined results: a null or empty text has no words and fails the base rule; labels without a quality or for unknown documents are left out;
without labels the list is empty and the base rule alone decides. A doc_id's several labels count as its largest. Repeated rows are judged alike.
A null doc_id has no label but is judged. Other columns, clashing names included, pass through ``keep``. A very long text is judged whole, as one row's work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_upper", "n_marks")
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "mean_word_chars": "word_chars / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / n_words",
}
BINS, MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 24, 8, 4, 5, 0.9


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words in three-word windows that are found twice or more; the windows' hashes are sorted only where two are equal."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            at = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(at))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(order, count))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(windows, covered))


def features(documents: DataFrame, *others: str) -> DataFrame:
    """doc_id, the counts, and the named other columns."""
    t = F.coalesce("text", F.lit(""))
    gone = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    as_long = lambda c: c.cast("long")
    w = _let(words, lambda w: F.struct(as_long(F.size(w)).alias("n"), as_long(_repeated(w)).alias("r"), as_long(F.size(F.array_distinct(w))).alias("u")))
    x = _let(lines, lambda x: F.struct(as_long(F.size(x)).alias("n"), as_long(F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    d = documents.select(
        "doc_id", *others, w.alias("_w"), x.alias("_l"), F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        gone(r"[#*$%&|<>]").alias("n_symbols"), gone("[A-Z]").alias("n_upper"), gone("[!?]").alias("n_marks"),
    )
    named = {"n_words": "_w.n", "n_dup_lines": "_l.d", "n_repeat_words": "_w.r", "n_lines": "_l.n", "n_distinct_words": "_w.u"}
    return d.select("doc_id", *others, *(F.col(named.get(c, c)).alias(c) for c in (*COUNTS, *MORE)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expr(self) -> str:
        """Text counts of at least one word are assumed: others have failed the base rule."""
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self) -> Column:
        """The place of the first rule that holds, from 1; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules):
            holds = F.expr("n_words > 0 AND " + " AND ".join(c.expr() for c in rule))
            out = F.when(holds, F.lit(k + 1)) if out is None else out.when(holds, F.lit(k + 1))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def reject(self) -> Column:
        return self.verdict() > 0

    def __str__(self) -> str:
        return "\n".join(f"{'if' if k == 0 else 'else if'} {' and '.join(f'{c.feature} {">" if c.above else "<="} {c.threshold:.4g}' for c in r)}: reject" for k, r in enumerate(self.rules)) + "\nelse: keep"


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, seed: int = 1) -> DecisionList:
    """``labelled``: the counts of ``features`` and ``bad`` (boolean). Only rows that pass the base rule teach."""
    names = list(FEATURES)
    x = labelled.where(~base_failed() & F.col("bad").isNotNull()).select("bad", "n_words", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(3)).alias("part"), *(F.expr(FEATURES[f]).alias(f) for f in names))
    cuts_at = [k / (BINS + 1) for k in range(1, BINS + 1)]
    got = x.agg(*(F.percentile_approx(f, cuts_at, 10_000).alias(f"{f}_all") for f in names), *(F.percentile_approx(F.when(F.col("bad"), F.col(f)), cuts_at, 10_000).alias(f"{f}_bad") for f in names)).first()
    cuts = {f: sorted({*(got[f"{f}_all"] or []), *(got[f"{f}_bad"] or [])}) for f in names}
    # A row is its bins; equal rows are counted together.
    bins = F.array(*(sum((F.when(F.col(f) > F.lit(c), 1).otherwise(0) for c in cuts[f]), F.lit(0)).cast("int") for f in names))
    rows = x.select(bins.alias("bins"), (F.col("part") == 0).alias("held"), "bad").groupBy("bins", "held").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    rows = materialize(rows, "bins")

    def covers(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, at in rule:  # bin > at: the value is above the cut of that place
            b = F.get("bins", F.lit(f))
            out = out & (b > at if above else b <= at)
        return out

    rules: list[list[tuple[int, bool, int]]] = []
    while len(rules) < MAX_RULES:
        left = rows
        for r in rules:
            left = left.where(~covers(r))
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < MAX_CONDITIONS:
            grown = left.where(~F.col("held")).where(covers(rule)).select(F.posexplode("bins").alias("f", "b"), "p", "n").groupBy("f", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
            by: dict[int, dict[int, tuple[int, int]]] = {}
            for r in grown:
                by.setdefault(r.f, {})[r.b] = (r.p, r.n)
            if not by:
                break
            p0, n0 = (sum(v[k] for v in by[0].values()) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f, hist in sorted(by.items()):
                p, n = 0, 0
                for at in range(len(cuts[names[f]])):
                    p, n = p + hist.get(at, (0, 0))[0], n + hist.get(at, (0, 0))[1]
                    for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                        if a >= MIN_COVER and (g := _gain(a, b, p0, n0)) > best[0] + 1e-9:
                            best = (g, (f, above, at))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Pruning: the prefix of conditions that does best on the held rows.
        counts = left.where("held").agg(*(F.sum(F.when(covers(rule[:k]), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c in "pn")).first()
        score = [((counts[f"p{k}"] or 0), (counts[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in score]
        k = max(range(len(rule)), key=lambda j: (worth[j], -j))
        p, n = score[k]
        if p < 1 or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule[: k + 1])
    # A threshold lies half-way between its cut, which is a value of the data, and the next greater value.
    used = sorted({(f, at) for r in rules for f, _, at in r})
    above = x.agg(*(F.min(F.when(F.col(names[f]) > F.lit(cuts[names[f]][at]), F.col(names[f]))).alias(f"t{k}") for k, (f, at) in enumerate(used))).first() if used else []
    middle = {(f, at): (cuts[names[f]][at] + (cuts[names[f]][at] if v is None else v)) / 2 for (f, at), v in zip(used, above, strict=True)}
    return DecisionList(tuple(tuple(Condition(names[f], up, float(middle[f, at])) for f, up, at in r) for r in rules))


def fit(counts: DataFrame, labels: DataFrame) -> DecisionList:
    """A list that rejects what the labels call quality 0."""
    bad = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    return learn(counts.join(bad, "doc_id"))


def judge(documents: DataFrame, labels: DataFrame, *others: str) -> DataFrame:
    """doc_id, the counts, base_failed, rule (0: none) and kept; and the named other columns."""
    counts = materialize(features(documents, *others), "counts")
    return counts.withColumn("base_failed", base_failed()).withColumn("rule", fit(counts, labels).verdict()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op7_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents, labels).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def keep(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep, all columns as they are."""
    d = materialize(features(documents.withColumn("_row", F.struct(*documents.columns)), "_row"), "counts")
    model = fit(d.drop("_row"), labels)
    return d.where(~base_failed() & ~model.reject()).select("_row.*")
