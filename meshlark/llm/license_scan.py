"""License scans: fixed phrases by their places, and license templates by an exact set-similarity join; DataFrame operations only.

A text block is a line, or for each template any run of words, across lines, that is ``SLACK`` longer than the template (notices are
wrapped). A template is found in a block that holds at least ``CONTAINMENT`` of its distinct words. The join
is exact: words of all templates are ranked by how many documents have them (rarest first, counted over the whole corpus), and a block
meets a template only if (length) it has enough template words, (prefix) one of the template's rarest words, and (position) enough words left
after the first common one on both sides; what remains is counted. Runs of words are counted only for templates that the whole text could hold by
the same filters (candidates come from an inverted map of prefix words), from each word of the template on (a run that starts with another word has no more of them). Templates are a fixed list, so each row meets them within itself, without a shuffle.

Defined results: a null or empty text has no words, no places (null first and last), empty labels and score 0. An empty
table gives no rows; repeated rows are scanned alike; other columns are ignored. A very long text is scanned whole, as one row's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT, SLACK = 0.9, 0.25

# Base phrases and their labels, then notices that licenses ask for and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _let(x: Column, f) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def lowered() -> Column:
    """Lower case as far as words of ASCII letters can tell: the Kelvin sign, which would become a plain k, is set aside."""
    return F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def template_words() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def ranks(documents: DataFrame) -> dict[str, int]:
    """The rank of each template word, rarest first: documents that have it, over the whole corpus."""
    vocabulary = F.array(*map(F.lit, template_words()))
    n = documents.select(F.explode(F.array_intersect(vocabulary, words(lowered()))).alias("w")).groupBy("w").count().collect()  # at most one row per template word
    count = {r.w: r["count"] for r in n}
    return {w: k for k, w in enumerate(sorted(template_words(), key=lambda w: (count.get(w, 0), w)))}


def _inverted(prefixes: list[list], key=lambda x: x) -> Column:
    """Prefix token -> places of the templates that have it in their prefix."""
    of: dict = {}
    for k, prefix in enumerate(prefixes):
        for x in prefix:
            of.setdefault(key(x), []).append(k)
    return F.create_map(*(c for x, ks in of.items() for c in (F.lit(x), F.array(*map(F.lit, ks)))))


def _candidates(tokens: Column, inverted: Column, templates: Column) -> Column:
    """The templates that share a prefix token with the tokens; no other template is looked at."""
    places = F.flatten(F.transform(tokens, lambda x: F.coalesce(F.element_at(inverted, x), F.array().cast("array<int>"))))
    return F.transform(F.array_distinct(places), lambda k: F.get(templates, k))


def _found(text: Column, rank: dict[str, int], containment: float) -> Column:
    """Array of (label, share) of the templates met by the text's blocks."""
    items = []
    for label, t in TEMPLATES:
        own = sorted(rank[w] for w in set(t.split()))
        need = math.ceil(round(containment * len(own), 9))
        items.append((label, own, need, own[: len(own) - need + 1]))
    templates = F.array(*(F.struct(F.lit(a).alias("label"), F.array(*map(F.lit, own)).alias("own"), F.lit(need).alias("need"), F.array(*map(F.lit, prefix)).alias("prefix")) for a, own, need, prefix in items))
    inverted, least = _inverted([i[3] for i in items]), min(i[2] for i in items)
    vocabulary, place = F.array(*(F.lit(w) for w in rank)), F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    block = lambda line: F.sort_array(F.transform(F.array_intersect(vocabulary, words(line)), lambda w: F.element_at(place, w)))
    blocks = F.filter(F.transform(F.split(text, "\n"), block), lambda r: F.size(r) >= least)

    def meets(r: Column, t: Column) -> Column:
        first = lambda: F.get(F.array_intersect(t["prefix"], r), F.lit(0))  # noqa: E731  the rarest common word
        left_t = F.size(t["own"]) - F.array_position(t["own"], first())
        left_r = F.size(r) - F.array_position(r, first())
        return (F.size(r) >= t["need"]) & (1 + F.least(left_t, left_r) >= t["need"]) & (F.size(F.array_intersect(t["own"], r)) >= t["need"])

    share = lambda r, t: F.size(F.array_intersect(t["own"], r)).cast("double") / F.size(t["own"])
    lines = F.flatten(F.transform(blocks, lambda r: F.transform(F.filter(_candidates(r, inverted, templates), lambda t: meets(r, t)), lambda t: F.struct(t["label"].alias("label"), share(r, t).alias("share")))))
    return F.concat(lines, _let(words(text), lambda w: _in_runs(w, rank, containment)))


def _in_runs(w: Column, rank: dict[str, int], containment: float) -> Column:
    """Array of (label, share) of the templates met by runs of the words, across lines."""
    items = []
    for label, t in TEMPLATES:
        own = sorted(set(t.split()), key=rank.__getitem__)
        need = math.ceil(round(containment * len(own), 9))
        items.append((label, own, need, own[: len(own) - need + 1], math.ceil((1 + SLACK) * len(t.split()))))
    templates = F.array(*(F.struct(F.lit(a).alias("label"), F.array(*map(F.lit, own)).alias("own"), F.lit(need).alias("need"), F.array(*map(F.lit, prefix)).alias("prefix"), F.lit(n).alias("n")) for a, own, need, prefix, n in items))
    inverted = _inverted([i[3] for i in items])
    could = lambda r, t: F.size(F.array_intersect(t["own"], r)) >= t["need"]
    starts = lambda t: F.filter(F.sequence(F.lit(1), F.size(w)), lambda k: F.array_contains(t["own"], F.get(w, k - 1)))
    most = lambda t: F.array_max(F.transform(starts(t), lambda k: F.size(F.array_intersect(t["own"], F.slice(w, k, t["n"])))))
    met = _let(F.array_intersect(F.array(*(F.lit(x) for x in rank)), w), lambda r: F.filter(_candidates(r, inverted, templates), lambda t: could(r, t)))
    runs = F.transform(met, lambda t: F.struct(t["label"].alias("label"), t["own"].alias("own"), t["need"].alias("need"), most(t).alias("most")))
    return F.transform(F.filter(runs, lambda t: t["most"] >= t["need"]), lambda t: F.struct(t["label"].alias("label"), (t["most"].cast("double") / F.size(t["own"])).alias("share")))


def scan(documents: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    rank = ranks(documents)
    rare = sorted({w for _, t in TEMPLATES for own in [sorted(set(t.split()), key=rank.__getitem__)] for w in own[: len(own) - math.ceil(round(containment * len(own), 9)) + 1]})

    def places(w: Column) -> Column:
        def here(i: Column) -> Column:
            out = F.lit(False)
            for phrase in PHRASES:
                one = F.lit(True)
                for k, x in enumerate(phrase.split()):
                    one = one & (F.get(w, i + k) == x)
                out = out | one
            return F.coalesce(out, F.lit(False))

        gate = F.arrays_overlap(w, F.array(*(F.lit(p.split()[0] if p == "cc by" else p.split()[-1]) for p in PHRASES)))
        return F.when(gate, F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)).otherwise(F.array().cast("array<int>"))

    def names(w: Column, at: Column) -> Column:
        of = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            of = F.when(F.lit(phrase.split()[0]) == w, F.lit(label)).otherwise(of)
        return of

    none = F.array().cast("array<struct<label:string,share:double>>")
    base = lambda w: _let(places(w), lambda p: F.struct(p.alias("at"), F.array_sort(F.array_distinct(F.transform(p, lambda i: names(F.get(w, i), i)))).alias("labels")))
    x = _let(words(F.col("_t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), base(w).alias("base"), F.arrays_overlap(w, F.array(*map(F.lit, rare))).alias("maybe")))
    d = documents.select("doc_id", lowered().alias("_t")).select("doc_id", "_t", x.alias("_x"))
    d = d.select("doc_id", F.col("_x.n").alias("n_words"), F.col("_x.base.at").alias("_at"), F.col("_x.base.labels").alias("_base"), F.when(F.col("_x.maybe"), _found(F.col("_t"), rank, containment)).otherwise(none).alias("_found"))
    return d.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"), F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.col("_found.label")))), ",").alias("labels"),
        F.greatest(F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.col("_found.share")), F.lit(0.0))).alias("score"),
    )


def op8_license(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return scan(documents)


def oracle_sql(containment: float = CONTAINMENT) -> str:
    """Brute force: every line against every template."""
    rows = ", ".join(f"('{a}', '{t}')" for a, t in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    here = " OR ".join("(" + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
x AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
b AS (SELECT *, list_filter(range(0, len(w)), lambda i: coalesce({here}, false)) AS pos FROM x),
c AS (SELECT *, list_sort(list_distinct(list_transform(pos, lambda i: CASE w[i + 1] WHEN 'cc' THEN 'cc-by' WHEN 'general' THEN 'gpl' ELSE 'reserved' END))) AS base FROM b),
tp AS (SELECT label, list_distinct(string_split(t, ' ')) AS own FROM (VALUES {rows}) v(label, t)),
ln AS (SELECT r, list_distinct(regexp_extract_all(line, '{word}')) AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT r, label, len(list_intersect(own, lw)) / CAST(len(own) AS DOUBLE) AS share, len(list_intersect(own, lw)) AS n, len(own) AS m FROM ln, tp),
g AS (SELECT r, list(DISTINCT label) AS found, max(share) AS best FROM f WHERE n >= ceil(round({containment} * m, 9)) GROUP BY r)
SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(pos) AS BIGINT) AS n_base, list_min(pos) AS first_word, list_max(pos) AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
       greatest(CASE WHEN len(pos) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(best, 0.0)) AS score
FROM c LEFT JOIN g USING (r)
"""
