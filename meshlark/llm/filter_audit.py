"""Filter interaction audit: what each of five filters removes, and what others had removed or would have removed, in every order of them.

A document is a mask of the filters that it fails, and a part's documents are counts by mask (``cells``), so the orders are evaluated on at most 32
cells a part. ``evaluate`` unpivots the cells against the steps of all orders; a running bit-or over the steps says whether an earlier filter has
removed a cell, conditional sums give a step's figures, and the total over a filter's rows of all orders gives its Shapley sum.

Defined results: a null text is the empty one, a null lang the part of the empty string. A null doc_id has no label, and neither makes a copy nor is one; rows that repeat
a doc_id and its text are each counted, and none of them is a copy of the other. A doc_id has a label if any of its label rows has it. A very long text is one row's work.
Clashing and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.llm.common import materialize

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
COPY = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone (A to D)."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    n = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("own"))), F.lit(0))
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))

    def bits(n: Column) -> Column:
        fails = (n["all"] < 100, 100 * n["own"] < 80 * n["all"], 100 * capitals > 10 * F.length(t), t.rlike(r"[#$%&*|]"))
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    return F.get(F.transform(F.array(n), bits), F.lit(0))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: counts of documents by the filters that they fail.

    Equal texts meet as counts by (text, part, labels), never as rows, so a text with a third of all documents is no hot group.
    """
    t = F.coalesce("text", F.lit(""))
    d = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("digest"), text_mask(F.col("text")).alias("mask"))
    d = materialize(d.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks", True)
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    known = d.where("doc_id is not null").join(marks, "doc_id", "left").select(*d.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")))
    every = known.unionByName(d.where("doc_id is null").withColumns({c: F.lit(False) for c in ("quality", "toxic")}))
    g = every.groupBy("digest", "mask", "part", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))  # a few rows a text: its parts and labels
    g = g.withColumn("own", F.col("loose") + F.when(first, F.col("at_least")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("m"), F.col("own").alias("k")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("m"), (F.col("n") - F.col("own")).alias("k")))
    x = g.select("part", "quality", "toxic", F.explode(both).alias("c")).where("c.k > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("c.k")).otherwise(0))
    return x.groupBy("part", F.col("c.m").alias("mask")).agg(F.sum("c.k").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def evaluate(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, for all orders of the filters and their steps."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    x = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)"))
    x = x.withColumn("here", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("earlier", F.coalesce(F.bit_or("here").over(before), F.lit(0)))
    fails, gone = F.col("here") != 0, F.col("earlier") != 0
    total = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    out = x.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone, "n").alias("kept"),
        total(fails & ~gone, "n").alias("removed"),
        total(fails & gone, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all orders, for each part of ``documents`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic)."""
    return evaluate(materialize(cells(documents, labels), "cells", True))


def op11_audit(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(documents, labels)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
 coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
x AS (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails FROM f),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
g AS (SELECT part, fails, n_fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM x GROUP BY ALL),
y AS (SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS filter, fails[filter_order[step]] AS here, n, n_fails, good, toxic,
 coalesce(list_bool_or([fails[z] FOR z IN string_split(filter_order[1:step - 1], '') IF z <> '']), false) AS gone FROM g, o, generate_series(1, 5) s(step)),
r AS (SELECT part, filter_order, step, filter, sum(n * (NOT here AND NOT gone)::INT)::BIGINT AS kept, sum(n * (here AND NOT gone)::INT)::BIGINT AS removed, sum(n * (here AND gone)::INT)::BIGINT AS redundant,
 sum(n * (here AND n_fails = 1)::INT)::BIGINT AS unique_fails, sum(good * (here AND NOT gone)::INT)::BIGINT AS good_lost, sum(toxic * (here AND NOT gone)::INT)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
